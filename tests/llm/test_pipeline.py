"""The pipeline's stages on their own input."""

import corpus_pipeline
from methgrid.llm.common import DOC_COLUMNS, written

from ..conftest import TESTDATA
from .test_operators import _classes, words

SF = f"{TESTDATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secrets", "mix", "bpe"]
    known = written(stages["language_id"](spark, docs, SF), "t")
    assert known.columns == DOC_COLUMNS and {r.doc_id for r in known.collect()} == {i for i, r in seen.items() if any(c.isalpha() for c in r.text)}
    single = written(stages["near_dedup"](spark, known, SF), "t")
    want = _classes([(r.doc_id, r.text) for r in known.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(want.values()))
    masked = written(stages["secrets"](spark, single, SF), "t")
    assert masked.columns == DOC_COLUMNS and masked.count() == single.count()
    mixed = written(stages["mix"](spark, masked, SF), "t")
    total = sum(len(words(r.text)) for r in masked.collect())
    assert mixed.columns == DOC_COLUMNS and abs(sum(len(words(r.text)) for r in mixed.collect()) - total) < 0.1 * total
    last = stages["bpe"](spark, mixed, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == mixed.count()
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, n_tokens long"


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    text = "der Hund läuft über die Straße und bellt laut im Regen"
    rows = [(1, text, "de", "a", 1, 1, "x", 1), (1, text, "de", "a", 1, 1, "x", 1), (None, text + " heute", None, None, 1, 1, "x", 1), (None, None, None, None, None, None, None, None), (2, "", "de", "b", 0, 1, "x", 1), (3, "123 !!", "en", None, 1, 1, "x", 1), (4, "the dog runs over the street password: hunter22x ok", "en", "b", 1, 1, "x", 1)]
    docs = written(spark.createDataFrame(rows, SCHEMA), "t")
    stages = dict(corpus_pipeline.STAGES)
    got = {name: written(stages[name](spark, docs, SF), "t") for name in stages}
    assert all(got[n].columns == DOC_COLUMNS for n in ("language_id", "near_dedup", "secrets", "mix"))
    ids = lambda n: sorted(str(r.doc_id) for r in got[n].collect())
    assert set(ids("language_id")) <= {"1", "4", "None"} and len(ids("language_id")) <= 4
    # The third row is a near copy of the first two; the null text stays.
    assert ids("near_dedup") == ["1", "2", "3", "4", "None"]
    assert ids("secrets") == sorted(str(r[0]) for r in rows) and not any("hunter22x" in (r.text or "") for r in got["secrets"].collect())
    assert set(ids("mix")) <= {str(r[0]) for r in rows}
    assert ids("bpe") == sorted(str(r[0]) for r in rows)


def test_stages_of_an_empty_table(spark):
    docs = written(spark.createDataFrame([], SCHEMA), "t")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_corpus_without_languages_is_kept(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of all", None, "a", 1) for i in range(20)] + [(20, "12 34", None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF).count() == 20

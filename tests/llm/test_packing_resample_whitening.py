"""Packing, resampling and whitening against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from methgrid.llm import packing, resample, whitening

from ..conftest import TESTDATA

DOCS = "doc_id long, text string, length long, score long, _row string, bucket int"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghABé1") for _ in range(rng.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 5, 19, 20, 21, 60, 300, 900, 1500, 4000)]
    texts += [None, "", "  \n\t ", "x" * 3000, "It's  a\n\n test—déjà vu 漢字かな 😀!! 'tis 12 345", "tail blanks   ", "\x1c\x1d a\x85b   c d <|endoftext|>", prose(rng, 60_000)]
    texts += [texts[6]] * 40
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[7], 1, 2, "x", 3), (None, texts[7], 1, 2, "x", 3), (6, texts[8], 1, 2, "x", 3)]
    out = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, texts[6][:900]), (2, None), (3, "A b. C"), (3, "A b. C")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def bins_needed(lengths, capacity=1024):
    """A lower bound: the words' volume, and pieces beyond half a sequence."""
    return max(-(-sum(lengths) // capacity), sum(n > capacity // 2 for n in lengths))


def tokens(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return [[*e.ids, 2] for e in whole.encode_batch(texts, add_special_tokens=False)]


def check_packing(got, rows, slack):
    """``got``: packed pieces of ``rows`` of (doc_id, text)."""
    want = collections.Counter()
    for (doc_id, _), ids in zip(rows, tokens([t or "" for _, t in rows]), strict=True):
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            want[doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 1024
    assert len(by) <= bins_needed([r.length for r in got]) * (1 + slack) + 1


def test_packing(spark, folder):
    out, rows = folder
    check_packing(packing.op11_minimum_slack(spark, out).collect(), [r[:2] for r in rows], 0.05)


def test_packing_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check_packing(packing.op11_minimum_slack(spark, f"{TESTDATA}/sf0.01").collect(), rows, 0.005)


def test_encoder_forgets_and_cuts(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    monkeypatch.setattr(packing, "SLICE", 300)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = random.Random(5)
    alphabet = "ab Z19 '\n\t.,-’—é漢😀  \x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 2000))) for _ in range(60)] + [prose(rng, 800)]
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read(), PATTERN)
    assert [ids.tolist() for ids in encoder.encode(texts)] == [ids[:-1] for ids in tokens(texts)]
    assert len(encoder.number) < 1000
    assert "".join(packing.slices(texts[-1])) == texts[-1] and len(list(packing.slices(texts[-1]))) > 5


@pytest.mark.parametrize("seed", range(6))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    room = rng.randrange(5, 40)
    left = [0] + [rng.randrange(0, 4) * rng.randrange(0, 2) for _ in range(room)]
    sums = {0}
    for length, n in enumerate(left):
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    got = packing.fullest(left, room)
    assert sum(a * b for a, b in got) == max(sums) and all(left[a] >= b > 0 for a, b in got)


def test_combinations_of_any_count():
    counts = {length: 10**9 + length for length in range(1, 1025)}
    rows = packing.combinations(counts)
    assert sum(length * (high - low) for length, low, high, *_ in rows) == sum(k * n for k, n in counts.items()) and len(rows) < 50_000


@pytest.mark.parametrize("seed", range(4))
def test_combinations_take_each_piece_once(seed):
    rng = random.Random(seed)
    counts = {length: rng.choice([1, 2, 7, 50]) for length in rng.sample(range(1, 1025), 200)}
    rows = packing.combinations(counts)
    by = collections.defaultdict(list)
    for length, low, high, *_ in rows:
        by[length].append((low, high))
    assert {k: v[-1][1] for k, v in by.items()} == counts
    assert all(v[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(v)) for v in by.values())
    sequences = max(s + t for *_, t, s, _ in rows)
    # Never worse than best fit by falling length.
    free = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(free, length)
        bisect.insort(free, (free.pop(at) if at < len(free) else 1024) - length)
    assert sequences <= len(free)


def brute_resample(docs, target):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own = [features(t) for _, t in docs]
    s = collections.Counter(itertools.chain.from_iterable(f for _, f in own))
    t = collections.Counter(itertools.chain.from_iterable(features(x)[1] for x in target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(long[: 5 * len(long) // 100]):
        r[4] = i + 1
    return rows


def as_counts(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_resample(spark, folder):
    out, rows = folder
    target = [r.text for r in spark.read.parquet(f"{out}/benchmark.parquet").collect()]
    want = as_counts(brute_resample([r[:2] for r in rows], target))
    assert as_counts(resample.op12_translate_split(spark, out).collect()) == want
    assert sum(n for r, n in want.items() if r[4]) == 2


def test_resample_of_all_documents(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert as_counts(resample.op12_translate_split(spark, folder).collect()) == as_counts(brute_resample(docs, target))


def test_resample_in_sql(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder[0]}/{name}.parquet/*.parquet'")
    got = resample.op12_translate_split(spark, folder[0])
    assert as_counts(con.sql(resample.OP12_SQL).select(", ".join(got.columns)).fetchall()) == as_counts(got.collect())


def test_runs_by_slices(monkeypatch):
    rng = random.Random(1)
    text = prose(rng, 500).encode() + b"   . " + b"Z" * 400
    whole = [h for _, found in resample.runs(text) for h in found]
    monkeypatch.setattr(resample, "SLICE", 37)
    parts = list(resample.runs(text))
    assert len(parts) > 50 and sorted(h for _, found in parts for h in found) == sorted(whole) and sum(n for n, _ in parts) == 501


def test_many_equal_rows_are_drawn_in_part(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e " * 5).alias("text"))
    got = resample.resample(docs, docs.limit(1)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 51)) and len(got) == 1000


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    for query in (packing.op11_minimum_slack, resample.op12_translate_split, whitening.op13_jacobi_davidson):
        assert query(spark, folder).count() == 0


def check_whitening(got, vectors):
    """``vectors``: list of (vec_id, entries)."""
    dim = max(len(v) for _, v in vectors)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dim - len(v)) for _, v in vectors], object)
    n, s = len(x), x.sum(0)
    exact = n * x - s
    c = (exact / n).astype(float)
    cov = c.T @ c / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(cov))
    k = min(8, dim)
    deviation = collections.Counter(((i, d) for (i, _), d in zip(vectors, (exact**2).sum(1), strict=True)))
    assert collections.Counter((r.vec_id, r.deviation) for r in got) == collections.Counter({a: b * k for a, b in deviation.items()})
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    for j in range(k):
        mine = [r for r in got if r.component == j + 1]
        assert mine[0].explained == pytest.approx(values[j] / np.trace(cov), rel=1e-9, abs=1e-12)
        assert mine[0].residual <= 1e-13 * values[0] and mine[0].identity_error <= 1e-8
        if values[j] > 1e-9 * values[0]:
            gap = min([abs(values[j] - v) for i, v in enumerate(values) if i != j], default=1)
            if gap > 1e-3 * values[0]:
                z = c @ axes[:, j] / math.sqrt(values[j])
                want = sorted(zip([i is not None for i, _ in vectors], [i or 0 for i, _ in vectors], z, strict=True))
                for sign in (1, -1):
                    have = sorted((r.vec_id is not None, r.vec_id or 0, sign * r.whitened) for r in mine)
                    if np.allclose([a[2] for a in have], [a[2] for a in want], atol=1e-9, rtol=1e-9):
                        break
                else:
                    raise AssertionError(f"component {j + 1}")
        else:
            assert all(r.whitened is None for r in mine)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(base)]
    sound = [*rows, rows[5], rows[5], (None, rows[7][1], "y", 2), (7, rows[9][1][:4], "y", 2)]
    bad = [(900, None, "z", 1), (901, [1.0, None], "z", 1), (902, [float("nan")] * 12, "z", 1), (903, [float("inf")] * 12, "z", 1)]
    table = spark.createDataFrame(sound + bad, "vec_id long, embedding array<double>, kind string, component int").repartition(5)
    check_whitening(whitening.whiten(table).collect(), [r[:2] for r in sound])


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 15 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in got)
    pair = [(1, [0.0, 1.0, 5.0, 1.0]), (2, [3.0, 1.0, 2.0, 1.0])]
    check_whitening(whitening.whiten(spark.createDataFrame(pair, "vec_id long, embedding array<double>")).collect(), pair)


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(math.isfinite(r.whitened) for r in got if r.component == 1) and {r.deviation for r in got if r.vec_id == 1} == {None}


def test_whitening_of_all_embeddings(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.op13_jacobi_davidson(spark, f"{TESTDATA}/sf0.01").collect(), vectors)

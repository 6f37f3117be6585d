"""Mixing of repeated rows, and language identification with any number of labels."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from methgrid.llm import language, mixing, windows
from methgrid.llm.common import written

from .test_operators import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_takes_part_of_equal_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "ten words that are the same in all these rows", None, "d", 1)] * 1000
    rows += [(5, f"{i} " + "same id other text " * (i % 7 + 1), None, "c", 1) for i in range(400)]
    rows += [(7, "both are the same " * 20, None, "b", 1)] * 500
    rows += [(100 + i, "word " * rng.randrange(1, 60), None, "a", 1) for i in range(700)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    again = mixing.mix(docs.repartition(3), keep=["doc_id", "source"]).collect()
    as_counts = lambda rs: collections.Counter((r.doc_id, r.source, r.mix_size, r.mix_copies) for r in rs)
    assert as_counts(got) == as_counts(again) and len(got) == len(rows)
    taken, target, largest = collections.Counter(), {}, {}
    for r in got:
        assert r.mix_copies <= 3
        taken[r.source] += r.mix_size * r.mix_copies
        target[r.source] = r.mix_target
    for s in "abcd":
        largest[s] = max(len(words(t)) for _, t, _, src, _ in rows if src == s)
        assert abs(taken[s] - target[s]) <= largest[s], s
    assert min(target["c"], target["d"]) > 0 and any(0 < target[s] % largest[s] for s in "bd")
    stage = mixing.mix_stage(spark, docs, folder)
    assert stage.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    spread = collections.Counter()
    for r in stage.collect():
        spread[r.source] += len(words(r.text))
    assert spread == taken


@pytest.mark.parametrize("labels,sample", [(5000, 2000), (600, 2000)])
def test_any_number_of_labels(spark, labels, sample):
    rows = [(i, f"text of label {i % labels} in row {i} çé", f"l{i % labels}", "s", 1) for i in range(2 * labels)]
    docs = spark.createDataFrame(rows, DOCS)
    chosen = language.sampled(docs, sample)
    known = docs.where(~language.held_out(F.col("doc_id"))).select("lang").distinct().count()
    assert chosen.count() <= sample and chosen.select("lang").distinct().count() == min(known, sample)


def test_prediction_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 5)
    rows = [(i, f"text of label {i % 5000} in row {i}", f"l{i % 5000}", "s", 1) for i in range(10_000)]
    docs = spark.createDataFrame(rows, DOCS)
    net = language.learn(docs)
    assert len(net.languages) == language.SAMPLE
    got = language.predict(docs.limit(50), net, ["doc_id"]).collect()
    assert len(got) == 50 and all(r.lang_pred in set(net.languages) and 0 <= r.score <= 1 for r in got)


def test_every_window_is_learned_from(spark):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, "x" * 1000 + " deutsch " * 200, "de", "s", 1), (b, "english " * 50, "en", "s", 1)], DOCS)
    chosen = {r.lang: r.text for r in language.sampled(docs).collect()}
    assert chosen == {"de": "x" * 1000 + " deutsch " * 200, "en": "english " * 50}


def test_links_of_frequent_keys_are_the_same_in_one_task_and_in_many(spark):
    rng = random.Random(12)
    rows = []
    for key in (8 * 5 + 1, 8 * 77 + 3, -8 * 9 + 2):
        sides = [rng.getrandbits(16) for _ in range(3)]
        for doc in range(60):
            near = 0
            for _ in range(4):
                near = near << 16 | rng.choice(sides)
            c = rng.randrange(60, 90)
            rows.append((key, doc * 3 + rng.randrange(2), c, c - rng.randrange(60), c + rng.randrange(60), near - (1 << 64) if near >> 63 else near))
    rows = [next(g) for _, g in itertools.groupby(sorted(rows), key=lambda r: r[:2] + r[5:])]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = set()
    for own in by.values():
        columns = {n: np.array(v, np.int64) for n, v in zip(("key", "doc_id", "c", "l", "r", "near"), zip(*sorted(own), strict=True), strict=True)}
        want |= set(zip(*[x.tolist() for x in windows._led(columns)], strict=True))
    frame = written(spark.createDataFrame(rows, "key long, doc_id long, c int, l int, r int, near long"), "t")
    assert {tuple(r) for r in windows.across(frame).collect()} == want and len(want) > 100


def test_passages_of_frequent_keys_have_an_exact_way(spark, monkeypatch):
    """Pairs of texts with two words changed beside a stretch of 44 words that all texts share."""
    rng = random.Random(5)
    docs, want = [], set()
    for g in range(20):
        left, right = ([f"{side}{g}x{i}" for i in range(28)] for side in "lr")
        changed = left[:26] + ["new"] + left[27:], right[:1] + ["new"] + right[2:]
        for n, (a, b) in enumerate(((left, right), changed)):
            docs.append((2 * g + n, " ".join([*(f"o{rng.random()}" for _ in range(20)), *a, *(f"core{i}" for i in range(44)), *b])))
        want.add((2 * g + 1, 2 * g))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(windows.every_pair, "__defaults__", (7,))
    assert {(r.doc_id, r.other_id) for r in windows.near_duplicate_passages(frame, exact=True).collect()} == want


def test_all_pairs_of_windows(spark, monkeypatch):
    """Leads lose links of frequent keys; the exact way has all, whatever the tasks and blocks."""
    rng = random.Random(6)
    rows = [(rng.randrange(90), rng.choice([8, 8, 16, 25, *range(32, 64)]), c := rng.randrange(100), max(0, c - rng.randrange(60)), c + rng.randrange(60), rng.randrange(1 << 60)) for _ in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, key long, c int, l int, r int, near long").select("key", "doc_id", "c", "l", "r", "near")
    want = []
    for a in rows:
        for b in rows:
            lo, hi = max(a[3], b[3] + a[2] - b[2]), min(a[4], b[4] + a[2] - b[2])
            if a[1] == b[1] and a[0] > b[0] and hi - lo >= windows.GRID - 1:
                want.append((a[0], b[0], a[1] & 7, lo, hi, a[2] - b[2]))
    monkeypatch.setattr(windows, "STEP_ROWS", 100)

    def links(exact, rest):
        out = windows.linked(frame, exact)
        return sorted(map(tuple, out.where("o_id is not null").select("doc_id", "o_id", "k", "lo", "hi", "diagonal").unionByName(rest(out.where("o_id is null").select("doc_id", "key", "c", "l", "r", "near"))).collect()))

    assert links(True, lambda x: windows.every_pair(x, 20)) == sorted(want)
    assert 0 < len(links(False, windows.across)) < len(want) / 2

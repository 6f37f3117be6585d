"""Operators against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from methgrid.llm import bpe, language, licenses, minhash, mixing, secrets, sharding, shingles, spotsigs, topk, windows

from ..conftest import TESTDATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, class_id long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows with nulls, repeats, copies, near copies, a long text, secrets and columns that clash with internal names."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 40, 120, 260, 700)]
    edited = base[3].split()
    edited[100] = "changed"
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    texts = [
        *base,
        base[2],
        base[3],
        " ".join(edited),
        None,
        "",
        " \n\t ",
        long,
        prose(rng, 80) + " " + passage + " " + prose(rng, 50),
        prose(rng, 20) + " " + passage + " " + prose(rng, 90),
        'é😀 Token= "' + "0123456789abcdef" * 3 + '" password: token: abcdefgh1 end',
        "pass: hunter2 at https://db.example.com:99 and user: bob",
        "pass: hunter2 alone",
        "Licensed under the Apache License, Version 2.0.",
        "12345 !!",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "é"][i % 4], 1, 5, "n", 9) for i, t in enumerate(texts)]
    rows += [rows[2], (None, base[1], "en", "b", 1, 5, "n", 9), (None, "only here", "en", "b", 1, 5, "n", 9)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("query", [mixing.op1_entropy_mix, windows.op2_compact_windows, topk.op3_score_at_a_time, sharding.op4_virtual_slots, language.op5_byte_conv, licenses.op6_conditional_compression, bpe.op7_merge_replay, secrets.op8_linked_secrets, spotsigs.op9_spot_signatures, minhash.op10_bag_minhash])
def test_empty_tables(spark, nothing, query):
    assert query(spark, nothing).count() == 0


def test_mix(spark, corpus):
    folder, rows = corpus
    got = mixing.op1_entropy_mix(spark, folder).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.op1_entropy_mix(spark, folder).collect()))
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(s for s in size if s is not None) + [None]
    weight = dict(zip(order, itertools.cycle([5, 2, 1])))
    full, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 3 * size[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * size[s] if s in full else level * weight[s] for s in order}
    taken = collections.Counter()
    by_id = {r[0]: r for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        if r.doc_id is not None:
            s = by_id[r.doc_id][3]
            assert r["size"] == len(words(by_id[r.doc_id][1])) and r.source_size == size[s] and r.target == pytest.approx(target[s])
            taken[s] += r.taken
        else:
            taken["b"] += r.taken
    largest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_balance_of_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 80.0), ("b", "y", 70.0)], "s string, l string, words double")
    s = spark.createDataFrame([("a", 120.0), ("b", 180.0)], "s string, target double")
    l = spark.createDataFrame([("x", 200.0), ("y", 100.0)], "l string, target double")  # noqa: E741
    got = mixing.balance(cells, {"s": s, "l": l}, tolerance=1e-6).collect()
    for column, key, want in (("s", "a", 120), ("s", "b", 180), ("l", "x", 200), ("l", "y", 100)):
        assert sum(r.words * r.rate for r in got if r[column] == key) == pytest.approx(want, rel=1e-5)


def test_compact_windows_cover_all_subsequences():
    v = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    offsets = np.array([0, 150, 150, 160, 400])
    got = set(zip(*(x.tolist() for x in windows.compact_windows(v, offsets, 20))))
    want = set()
    for a, b in itertools.pairwise(offsets.tolist()):
        for i in range(a, b):
            for j in range(i + 19, b):
                c = i + int(v[i : j + 1].argmin())
                inside = [w for w in got if w[0] <= i and j <= w[2] and w[0] <= w[1] <= w[2] and i <= w[1] <= j]
                assert len(inside) == 1 and inside[0][1] == c
                want.add(c)
    assert {w[1] for w in got} == want


def shingle_bag(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def alike(a, b):
    x, y = shingle_bag(a), shingle_bag(b)
    return (x & y).total() / (x | y).total()


def test_passages(spark, corpus):
    folder, rows = corpus
    got = windows.op2_compact_windows(spark, folder).collect()
    text = {r[0]: words(r[1]) for r in rows if r[0] is not None}
    pairs = {(r.doc_id, r.other_id) for r in got}
    assert {(5, 2), (6, 3), (13, 12), (7, 3)} <= pairs
    assert {x for p in pairs for x in p} == {2, 3, 5, 6, 7, 12, 13}
    for r in got:
        a, b = text[r.doc_id][r.start : r.end], text[r.other_id][r.other_start : r.other_end]
        assert len(a) >= 50 and len(b) >= 50
        assert alike(a, b) == pytest.approx(r.similarity) and r.similarity >= 0.8


def edited(rng, passage, kinds):
    out = list(passage)
    for i, kind in reversed(list(enumerate(kinds))):
        at = int((i + 0.5) * len(passage) / len(kinds)) + rng.randrange(-3, 4)
        out[at : at + (kind != "ins")] = [] if kind == "del" else [f"x{rng.random()}"]
    return out


def test_near_passages_are_found(spark):
    rng = random.Random(1)
    docs, planted = [], []

    def put(*parts):
        docs.append((len(docs), " ".join(p if isinstance(p, str) else " ".join(p) for p in parts)))
        return len(docs) - 1

    for n, kinds in ((50, []), (55, ["sub"]), (60, ["sub"]), (60, ["ins"]), (60, ["del"]), (100, ["sub", "sub"]), (100, ["ins", "del"]), (200, ["sub", "ins", "del", "sub"])):
        for _ in range(25):
            one = prose(rng, n).split()
            two = edited(rng, one, kinds)
            if alike(one, two) >= 0.8:
                a = put(prose(rng, rng.randrange(150)), one, prose(rng, rng.randrange(150)))
                planted.append((a, put(prose(rng, rng.randrange(150)), two, prose(rng, rng.randrange(150))), n, 0.8))
    for _ in range(25):
        # A third, earlier text shares 35 of the 60 words.
        one = prose(rng, 60).split()
        put(prose(rng, 50), one[10:45], prose(rng, 50))
        planted.append((put(prose(rng, 80), one), put(prose(rng, 30), one, prose(rng, 50)), 60, 1.0))
    for n in (27, 45):
        # A phrase below 50 words is in hundreds of texts; few of them share more about it.
        phrase = prose(rng, n)
        for _ in range(200):
            put(prose(rng, 60), phrase, prose(rng, 60))
        for _ in range(20):
            cut = rng.randrange(61 - n)
            left, right = prose(rng, cut), prose(rng, 60 - n - cut)
            planted.append((put(prose(rng, 60), left, phrase, right, prose(rng, 60)), put(prose(rng, 90), left, phrase, right, prose(rng, 40)), 60, 1.0))
    frequent = prose(rng, 55)
    first = put(prose(rng, 30), frequent, prose(rng, 30))
    members = [put(prose(rng, 30), frequent, prose(rng, 30)) for _ in range(400)]
    got = windows.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    text = dict(docs)
    for r in got:
        a, b = words(text[r.doc_id])[r.start : r.end], words(text[r.other_id])[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and alike(a, b) == pytest.approx(r.similarity) and r.similarity >= 0.8
    found = {(r.other_id, r.doc_id) for r in got}
    exact = [(a, b) for a, b, _, s in planted if s == 1]
    near = [(a, b) for a, b, _, s in planted if s < 1]
    assert sum(p in found for p in exact) >= 0.97 * len(exact) and sum(p in found for p in near) >= 0.97 * len(near)
    assert {(first, m) for m in members} <= found
    assert {x for p in found for x in p} <= {x for a, b, *_ in planted for x in (a, b)} | {first, *members}


def test_passages_do_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    want = sorted(map(tuple, windows.near_duplicate_passages(docs).collect()))
    monkeypatch.setattr(windows, "STEP_ROWS", 500)
    monkeypatch.setattr(windows, "TASK_ROWS", 3000)
    assert sorted(map(tuple, windows.near_duplicate_passages(docs.repartition(9, "lang")).collect())) == want


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (700, 16))
    vectors[100:400] = vectors[100]
    vectors[500, 3], vectors[501, 3], vectors[520, 3] = 20000.0, -3e6, 3e7
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [float("nan")] * 16), (2040, [None] * 16), (None, [1.0] * 16), (2060, [0.5] * 3), (2060, [0.25] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = np.zeros(16, np.int64)
            q[: len(v)] = np.floor(64 * np.float32(v).astype(np.float64)).astype(np.int64)
            table.setdefault(i, []).append(q)
    got = collections.defaultdict(list)
    for r in topk.op3_score_at_a_time(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    # Of the vectors with one query id the least asks.
    assert set(got) == {i for i in table if i % 20 == 0}
    for q in got:
        own = min(table[q], key=lambda v: v.tolist())
        scored = sorted((-int(own @ v), i) for i, vs in table.items() if i != q for v in vs)[:20]
        assert got[q] == [(i, -s) for s, i in scored]


def test_shards(spark, corpus, tmp_path):
    folder, rows = corpus
    got = sharding.op4_virtual_slots(spark, folder).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.rebalanced_shard in (r.shard, 40) and r.law == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    records = sharding.records(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet"))
    loads = sharding.slot_loads(records)
    first = sharding.first_map(loads, 8)
    per = [r[1] for r in first.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect()]
    assert max(per) - min(per) <= loads.agg(F.max("bytes")).first()[0]
    sharding.store_map(first, str(tmp_path / "map"))
    sharding.store_map(sharding.add_shard(first, loads, 8), str(tmp_path / "map"))
    second = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    assert all(second[s] in (old[s], 8) for s in old) and 8 in second.values() and len(old) == sharding.SLOTS


def test_language(spark, corpus):
    folder, rows = corpus
    got = language.op5_byte_conv(spark, folder).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id] or ""))


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    got = language.op5_byte_conv(spark, f"{TESTDATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_each_language_has_its_part_of_the_sample(spark, monkeypatch):
    many = [(i, f"text {i} of l{i % 5}", f"l{i % 5}") for i in range(10_000)]
    rare = [(20_000 + i, f"rare text {i}", "rare") for i in range(150)]
    docs = spark.createDataFrame(many + rare + rare[:50], "doc_id long, text string, lang string")
    learned = []
    monkeypatch.setattr(language.ByteConv, "train", lambda net, windows, labels: learned.extend(net.languages[y] for y in labels))
    language.learn(docs, 600)
    assert collections.Counter(learned) == {**{f"l{k}": 100 for k in range(5)}, "rare": min(100, sum(zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in rare))}


def test_licenses(spark, corpus):
    folder, _ = corpus
    assert [(r.doc_id, r.start, r.end, r.license) for r in licenses.op6_conditional_compression(spark, folder).collect()] == [(17, 0, 46, "Apache-2.0")]
    scan = licenses.Scanner().scan
    found = lambda text: [x[2] for x in scan(text)]
    for name, forms in licenses.NAMES.items():
        for lead in licenses.LEADS:
            assert found(f"Some prose. {lead} {forms[0]}.\nMore prose.") == [name], (lead, forms[0])
    for name, texts in licenses.TEXTS.items():
        for text in texts:
            assert found(f"Copyright 2020 X\n\n{text}\n\nmore") == [name], text
        long = max(texts, key=len)
        if len(licenses.norm(long)) > 25:
            assert found(long.replace("this", "that", 1)) == [name]
    assert found("My driver's license is new. The license plate too. In the public domain of thought.") == []
    assert found("Licensed under the Foo License, Version 7.0.") == []
    assert found("It is licensed under the MIT license and the code is released under Apache 2.0.") == ["MIT", "Apache-2.0"]
    assert found("Licensed under the MIT License or Licensed under the Apache License, Version 2.0") == ["MIT", "Apache-2.0"]
    rng = random.Random(2)
    for n in (5, 60, 400):
        for name, names in licenses.NAMES.items():
            assert found(f"{prose(rng, n)} Licensed under {names[0]} {prose(rng, n)}") == [name], (n, name)


def test_ranking_loses_no_template():
    """Every form of every template among random words, against a scan that confirms all templates whatever their rank."""
    ranked, every, rng = licenses.Scanner(), licenses.Scanner(), random.Random(6)
    every.rank = lambda words: [(1.0, k) for k in every.names]
    for k, fs in ranked.forms.items():
        for form in fs:
            text = f"{prose(rng, rng.randrange(15))} {' '.join(form)} {prose(rng, rng.randrange(15))}"
            got, want = ([x[:3] for x in s.scan(text)] for s in (ranked, every))
            assert got == want and [x[2] for x in got] == [k], (k, form)


def test_bpe(spark, corpus):
    import public_tokenizers as P
    import tiktoken

    folder, rows = corpus
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, bpe.op7_merge_replay(spark, folder).collect())) == want
    docs = spark.createDataFrame([(1, "é x<|endoftext|>")], "doc_id long, text string")
    full = bpe.encode_decode(docs, *bpe._public(), with_ids=True).first()
    assert full.decoded == "é x<|endoftext|>" and full.ids == enc.encode_ordinary(full.decoded)
    model = bpe.MergeReplay(ranks, P.PATTERN)
    model.prepare()
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 3000, "=" * 3001, " " * 999, *["".join(rng.choice("abcdeft hin,\n€ß") for _ in range(300)) for _ in range(100)], *["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(200)) for _ in range(50)]]
    for text, (ids, n, data) in zip(texts, model.blocks(texts), strict=True):
        assert ids == " ".join(map(str, enc.encode_ordinary(text))) and data == text.encode()


def test_bpe_with_merges_out_of_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 310, b"cd": 290}
    model = bpe.MergeReplay(ranks, r".+")
    model.prepare()

    def brute(data):
        parts = [bytes([b]) for b in data]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    data = [b"abcd", b"abcabc", b"bcd", b"aabbccdd" * 5]
    ids, sizes = model.merge(data)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [brute(d) for d in data]


def test_bpe_forgets_words(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK", 2000)
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = bpe.MergeReplay(ranks, P.PATTERN)
    model.prepare()
    rng = random.Random(5)
    alphabet = "abcdefgh ²³ªÀß\x85\xa0\n'st9\x1c€"
    texts = [prose(rng, 60) + "".join(rng.choice(alphabet if i % 2 else alphabet[:-1]) for _ in range(100)) for i in range(120)]
    for text, (ids, n, data) in zip(texts, model.blocks(texts), strict=True):
        want = enc.encode_ordinary(text)
        assert ids == " ".join(map(str, want)) and n == len(want) and data == text.encode()
    assert len(model.number) <= 300 + 2 * 2000


BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def test_secrets(spark, corpus):
    folder, rows = corpus
    want = collections.Counter()
    for r in rows:
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(r[1] or "") if len(m.group(g)) >= n)
        want[(r[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())] += 1
    got = secrets.op8_linked_secrets(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert {s.split(":")[0] for s in spans[15].split(",")} == {"pass", "endpoint", "user"} and spans[16] == ""
    kept = {r.doc_id: r.text for r in secrets.redact_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect() if r.doc_id is not None}
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(kept[i] == text[i] for i in text if i not in (14, 15))
    assert "0123456789abcdef" not in kept[14] and kept[14].startswith("é😀 [secret]") and "hunter2" not in kept[15] and "db.example.com" in kept[15]


def test_links_only_within_scope(spark):
    far = "pass: hunter2 " + "x " * 300 + "user: bob"
    docs = spark.createDataFrame([(1, far), (2, "pass: hunter2 " + "x " * 150 + "user: bob"), (3, "user: a1b https://x.example.com")], "doc_id long, text string")
    assert {r.doc_id: len(r.linked) for r in secrets.find_secrets(docs).collect()} == {1: 0, 2: 2, 3: 0}


def test_fingerprints(spark, corpus):
    folder, rows = corpus
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(spotsigs.op9_spot_signatures(spark, folder).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows] and [r.n_chars for r in got][2:] == [len(r[1] or "") for r in rows][2:]
    by_text = collections.defaultdict(set)
    for r, (i, text, *_) in zip(got, rows, strict=True):
        if i is not None and i != 2:
            by_text[text].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())


def test_edited_texts_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 7)
    texts = [t for (t,) in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spotsigs.op9_spot_signatures(spark, str(tmp_path)).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        k = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in got]) > 0.5 > 0.05 > np.mean([r.near_next for r in got])


def test_near_pairs_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text")
    pairs, members = spotsigs.near_pairs(docs, 0.8)
    sets = {r.doc_id: frozenset(r.sigs) for r in spotsigs.fingerprints(docs).collect()}
    ids = {r.doc_id: r.fingerprint_id for r in members.collect()}
    distinct = {ids[d]: s for d, s in sets.items() if s}
    want = {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(distinct.items(), 2) if len(x & y) >= 0.8 * len(x | y)}
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(3):
        f = rng.integers(0, 2**63, 60).astype(np.uint64)
        a = rng.integers(0, 12, 60)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 12, 60))
        s = minhash.bag_minhash(np.concatenate((f[a > 0], f[b > 0])), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate((a[a > 0], b[b > 0])), 2, 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def _classes(rows):
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()
    at = collections.defaultdict(set)
    for i, c in bags.items():
        for k in c:
            at[k].add(i)
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, c in bags.items():
        for j in {j for k in c for j in at[k] if j < i}:
            if (c & bags[j]).total() >= 0.8 * (c | bags[j]).total():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    want = _classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.class_id for r in minhash.op10_bag_minhash(spark, f"{TESTDATA}/sf0.01").collect()} == want


def test_large_groups_and_edge_rows(spark, corpus):
    folder, rows = corpus
    got = {r.doc_id: r.class_id for r in minhash.op10_bag_minhash(spark, folder).collect() if r.doc_id is not None}
    want = _classes([(r[0], r[1]) for r in rows if r[0] is not None])
    assert got == want
    rng = random.Random(4)
    base = prose(rng, 200).split()
    near = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(200)] = f"w{i}"
        near.append((i, " ".join(w)))
    docs = spark.createDataFrame([*near, (1000, prose(rng, 200))], "doc_id long, text string")
    assert {r.class_id for r in minhash.classes(docs).where("doc_id < 1000").collect()} == {0}


def test_null_and_repeated_ids_in_linear_rows(spark):
    rng = random.Random(9)
    base = [prose(rng, 60).split() for _ in range(40)]
    rows = []
    for i in range(2500):
        w = list(base[i % 40])
        w[rng.randrange(60)] = f"w{i % 90}"
        rows.append((None if i % 2 else 7, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = minhash.signed(docs)
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")).select(F.monotonically_increasing_id().alias("nid"), "node", "rep.doc_id", "rep.text_key")
    sets = minhash.multisets(docs, nodes.withColumnRenamed("doc_id", "rep"))
    assert nodes.count() <= sets.count() <= len(rows)
    got = minhash.classes(docs).select("text_key", "class_id").distinct()
    assert minhash.classes(docs).count() == len(rows) and got.count() == len({t for _, t in rows})


def test_pairs_among_texts_of_one_template(spark):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(120)]
    texts = []
    # Fillings are values of polynomials: two texts have two of six slots in common at most, and each filling is in hundreds.
    for c in itertools.product(range(17), repeat=3):
        w = list(template)
        for x in range(6):
            w[20 + 15 * x] = f"f{x}v{(c[0] + c[1] * x + c[2] * x * x) % 17}"
        texts.append(w)
    n = len(texts)
    for i in rng.sample(range(n), 200):
        w = list(texts[i])
        w[rng.randrange(5, 10)], w[112] = f"g{i}", f"h{i}"
        texts.append(w)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    shared = [k for k, n in collections.Counter(itertools.chain(*sets)).items() if n > 1]
    column = {k: j for j, k in enumerate(shared)}
    has = np.zeros((len(sets), len(shared)), np.float32)
    for i, one in enumerate(sets):
        has[i, [column[k] for k in one if k in column]] = 1
    both, sizes = has @ has.T, np.array([len(x) for x in sets])
    score = both / (sizes[:, None] + sizes[None, :] - both)
    want = {i: i for i in range(len(sets))} | {int(j): int(i) for i, j in np.argwhere(np.triu(score >= 0.8, 1))}
    assert len(set(want.values())) == n and 0.55 < np.median(score) < 0.75
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want


def test_shingle_hashes_are_of_the_words():
    h = np.arange(1, 9, dtype=np.uint64)
    got, owner, first = shingles.shingles(h, np.array([0, 3, 3, 8]))
    assert owner.tolist() == [0, 2] and first.tolist() == [0, 3]
    again, _, _ = shingles.shingles(h[3:], np.array([0, 5]))
    assert got[1] == again[0]


def test_components_equal_brute_force(spark):
    """Long ways, stars and random edges; later edges are laid between the labels of earlier ones."""
    rng = random.Random(3)
    path = rng.sample(range(40), 40)
    edges = [*zip(path, path[1:], strict=False), *[(i, 100) for i in range(60, 80)], *[(200 + rng.randrange(90), 200 + rng.randrange(90)) for _ in range(60)]]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    rng.shuffle(edges)
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    assert {r.nid: r.label for r in minhash.components(frame(edges)).collect()} == want
    early = minhash.components(frame(edges[:60]))
    assert {r.nid: r.label for r in minhash.components(frame(edges[60:]), early).collect()} == want
    assert minhash.components(frame([])).count() == 0

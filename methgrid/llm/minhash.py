"""MinHash near-duplicate detection with BagMinHash signatures.

Texts are multisets of five-word shingles. A shingle's weight, its count, is discretised into
the dyadic ranges [0,1), [1,2), [2,4), ...; each range of each shingle carries a Poisson process
of a rate equal to its length, whose points come in ascending order and fall on random registers.
A range that the weight fills only in part keeps the points below the weight. Every register keeps
its first point, so two texts agree in a register with probability equal to the weighted
Jaccard index. A process is left as soon as its next point lies beyond all registers.

Signatures are cut into bands. Texts that share a band are candidates: all pairs of small
groups; members of larger groups against their first node, which most bands of near copies have in
common, and again in finer groups that also share the next band, and the next but one. Copies
were folded into one node before. Candidates are verified by the exact overlap of their multisets. Members of larger
groups that this leaves in different components are compared by an exact join over length and
prefix filters, whose result doesn't depend on the bands. Connected texts form classes.

Nulls: null texts and texts without words are classes of their own. Shorter texts than a shingle
are one shingle. A null ``doc_id`` takes part by its text. Repeated rows are copies. Empty tables
give empty results; other columns are ignored, and ``near_dedup_stage`` returns those of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, drop_written, in_batches, read_table, small, written
from .shingles import atoms, chunks, counted, mixed, shingles, word_hashes

REGISTERS, BANDS = 96, 24
SIMILAR = 0.8
#: Groups up to this size give all their pairs; larger ones go by pivots and finer groups.
PAIRED = 12
#: How often a larger group is refined by one more band.
LEVELS = 3
#: Members of larger groups that have one shingle in their prefixes are joined in blocks of so many.
BLOCK = 1000
#: Words of 64 bits of the maps that tell sets with too little in common apart.
MAP_WORDS = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bag_minhash(hashes: np.ndarray, owner: np.ndarray, often: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) of float64: the first points of the processes of each text's weighted shingles."""
    best = np.full(texts * registers, np.inf)
    if not len(hashes):
        return best.reshape(texts, registers)
    state, who, rate, weight, low = [], [], [], [], []
    level = 0
    while True:
        start = 0 if level == 0 else 1 << (level - 1)
        has = often > start
        if not has.any():
            break
        state.append(mixed(hashes[has] + mixed(np.full(1, level + 1, np.uint64))))
        who.append(owner[has])
        rate.append(np.full(has.sum(), float(max(start, 1))))
        weight.append(often[has].astype(np.float64))
        low.append(np.full(has.sum(), float(start)))
        level += 1
    state, who, rate, weight, low = map(np.concatenate, (state, who, rate, weight, low))
    at = np.zeros(len(state))
    limit = np.full(texts, np.inf)
    turn = 0
    while len(state):
        state = state + _STEP
        draw = mixed(state)
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        other = mixed(draw + _STEP)
        register = (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
        # Where in its range the point lies; a range that the weight fills accepts every point.
        spot = low + rate * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        live = at < limit[who]
        hit = live & ((spot < weight) | (low == 0))
        np.minimum.at(best, who[hit] * registers + register[hit], at[hit])
        turn += 1
        if turn < 6 or turn % 8 == 0:
            limit = best.reshape(texts, registers).max(1)
            live = at < limit[who]
        if not live.all():
            state, who, rate, weight, low, at = (x[live] for x in (state, who, rate, weight, low, at))
    return best.reshape(texts, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) of int64 keys."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        out = mixed(out * _STEP + bits[:, :, j])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, bands) of every row, written; ``node`` is a digest of the words, null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for at, to, words, offsets in chunks(batch.column(2)):
                raw, edges = words.tobytes(), (offsets * 8).tolist()
                nodes += [hashlib.blake2b(raw[a:b], digest_size=16).hexdigest() if b > a else None for a, b in zip(edges, edges[1:], strict=False)]
                keys.append(band_keys(bag_minhash(*counted(*shingles(words, offsets)[:2]), to - at)))
            flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.string()), lists], names=["doc_id", "text_key", "node", "bands"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), word_hashes(F.col("text")).alias("words"))
    return written(in_batches(base).mapInArrow(run, "doc_id long, text_key long, node string, bands array<long>"), "signatures")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of nodes (nid, bands) that may be similar, and (key, nid) of the groups over PAIRED."""
    rows = nodes.select("nid", "bands", F.posexplode("bands").alias("band", "key"))
    rows = rows.select("nid", "band", "key", F.get("bands", (F.col("band") + 1) % BANDS).alias("next_1"), F.get("bands", (F.col("band") + 2) % BANDS).alias("next_2"))
    found = []
    for level in range(LEVELS):
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("pivot")).where("n > 1")
        members = rows.join(groups, "key")
        members = written(members, "band_members")
        few = members.where(F.col("n") <= PAIRED).select("key", "nid")
        found.append(few.select("key", F.col("nid").alias("a")).join(few.select("key", F.col("nid").alias("b")), "key").where("a < b").select("a", "b"))
        many = members.where(F.col("n") > PAIRED)
        if level == 0:
            large = many.select("key", "nid")
        found.append(many.where("nid != pivot").select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")))
        if level < LEVELS - 1:
            rows = many.select("nid", "band", F.xxhash64("key", f"next_{level + 1}").alias("key"), "next_1", "next_2")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct(), large


def id_key(doc_id) -> F.Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**62)))


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, atoms) of the wanted nodes (nid, node, rep, text_key): the shingle occurrences of the texts they stand for.

    Texts are met by id and text, so that rows without an id, or with one id, don't meet each other's.
    Equal rows give equal lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = [], []
            for at, to, words, offsets in chunks(batch.column(2)):
                raw, edges = words.tobytes(), (offsets * 8).tolist()
                got, owner = atoms(*counted(*shingles(words, offsets)[:2]))
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(to - at + 1))
                got = got[order]
                for i in range(to - at):
                    if hashlib.blake2b(raw[edges[i] : edges[i + 1]], digest_size=16).hexdigest() == batch.column(1)[at + i].as_py():
                        own.append(batch.column(0)[at + i].as_py())
                        lists.append(got[cuts[i] : cuts[i + 1]])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            edges = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["nid", "atoms"])

    keyed = docs.select(id_key(F.col("doc_id")).alias("rep_key"), F.xxhash64("text").alias("text_key"), "text")
    picked = keyed.join(small(wanted.select(id_key(F.col("rep")).alias("rep_key"), "text_key", "nid", "node")), ["rep_key", "text_key"])
    return in_batches(picked.select("nid", "node", word_hashes(F.col("text")).alias("words"))).mapInArrow(run, "nid long, atoms array<int>")


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of the pairs whose multisets overlap by ``least`` or more."""
    both = pairs.join(sets.toDF("a", "a_atoms"), "a").join(sets.toDF("b", "b_atoms"), "b")
    common = F.size(F.array_intersect("a_atoms", "b_atoms"))
    score = common / (F.size("a_atoms") + F.size("b_atoms") - common)
    may = F.least(F.size("a_atoms"), F.size("b_atoms")) >= F.greatest(F.size("a_atoms"), F.size("b_atoms")) * (least - 0.01)
    return both.where(may).select("a", "b", score.alias("similarity")).where(F.col("similarity") >= least).dropDuplicates(["a", "b"])


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the labels of the edges' ends; a node without a label stands for itself."""
    ends = edges.join(labels.select(F.col("nid").alias("a"), F.col("label").alias("a_label")), "a", "left")
    ends = ends.join(labels.select(F.col("nid").alias("b"), F.col("label").alias("b_label")), "b", "left")
    x, y = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
    return ends.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(nid, label): every node of the edges and where the way to ever smaller neighbours ends.

    A node points to its least neighbour, if that is smaller; pointers are followed by doubling.
    """
    both = edges.select(F.col("a").alias("nid"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("nid"), F.col("a").alias("other")))
    now = written(both.groupBy("nid").agg(F.least(F.min("other"), F.col("nid")).alias("label")), "roots")
    while True:
        far = now.select(F.col("nid").alias("label"), F.col("label").alias("next"))
        new = written(now.join(far, "label").select("nid", F.col("next").alias("label"), F.col("label").alias("was")), "roots")
        drop_written(now)
        now = new.drop("was")
        if not new.where("label != was").limit(1).count():
            return now


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(nid, label): the least node of each node's connected component; nodes without an edge are left out.

    Every round points nodes to roots and replaces the edges by those between different roots, so
    that edges inside what is already one component are read once. ``labels`` of an earlier call
    are taken as they are, and the new edges are laid between them. Tables are written each
    round, and only counts come to the driver.
    """
    edges = written(edges.select("a", "b") if labels is None else relabelled(edges, labels), "edges")
    if labels is not None:
        ends = edges.select(F.col("a").alias("nid")).unionByName(edges.select(F.col("b").alias("nid"))).distinct()
        labels = labels.unionByName(ends.join(labels, "nid", "left_anti").select("nid", F.col("nid").alias("label")))
    while True:
        found = roots(edges)
        if labels is None:
            labels = found
        else:
            top = found.select(F.col("nid").alias("label"), F.col("label").alias("root"))
            labels = written(labels.join(top, "label", "left").select("nid", F.coalesce("root", "label").alias("label")), "labels")
        left = written(relabelled(edges, found), "edges")
        drop_written(edges)
        edges = left
        if not edges.limit(1).count():
            return labels


def rest_pairs(large: DataFrame, labels: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame | None:
    """Distinct (a, b), a < b, of members of larger groups in different components that may overlap by ``least``; None without such groups.

    Every pair that does is among them: sets that have o atoms in common share one of the first
    n - o + 1 of each in one order of all atoms. The longer set has o >= least * n, the shorter
    one o >= 2 * least / (1 + least) * n; of a pair o is known. Rare atoms come first. Each set also has a
    map of MAP_WORDS x 64 bits in which each of its atoms flips one: two maps differ in no more bits than the sets
    do in atoms, so most pairs with too little in common go before they leave the join, and no other ones. Of an atom's members those of its largest component aren't joined with
    each other, and the others are joined in blocks of BLOCK against BLOCK.
    """
    labelled = large.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    members = written(labelled.join(split, "key").select("nid", "label").distinct(), "large_members")
    if not members.limit(1).count():
        return None
    own = sets.join(members, "nid").select("nid", "label", F.array_distinct("atoms").alias("atoms"))
    each = own.select("nid", "label", F.size("atoms").alias("n"), F.explode("atoms").alias("atom"))
    often = each.groupBy("atom").agg(F.count(F.lit(1)).alias("often"))
    spot = F.xxhash64("atom")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spot, 58).cast("int"))
    flipped = [F.bit_xor(F.when(F.pmod(spot, F.lit(MAP_WORDS)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MAP_WORDS)]
    maps = [f"m{i}" for i in range(MAP_WORDS)]
    first = each.join(often, "atom").groupBy("nid", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "atom"))).alias("sorted"), *flipped)
    length = lambda part: (F.col("n") - F.ceil(F.col("n") * part - 1e-6) + 1).cast("int")
    placed = first.select("nid", "label", "n", *maps, F.posexplode(F.slice("sorted", F.lit(1), length(least))).alias("place", "one"))
    indexed = F.col("place") < length(2 * least / (1 + least))
    prefix = written(placed.where("one.often > 1").select("nid", "label", "n", *maps, F.col("one.atom").alias("atom"), "place", indexed.alias("indexed")), "prefixes")
    of_label = prefix.groupBy("atom", "label").agg(F.count(F.lit(1)).alias("m"))
    main = of_label.groupBy("atom").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = prefix.join(main.select("atom", "main", blocks.alias("blocks")), "atom")
    block, every = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    long = rows.select("atom", F.col("nid").alias("x"), F.col("n").alias("x_n"), F.col("label").alias("x_label"), F.col("place").alias("x_place"), *[F.col(m).alias(f"x_{m}") for m in maps], "main", block.alias("x_block"), every.alias("y_block"))
    short = rows.where("indexed").select("atom", F.col("nid").alias("y"), F.col("n").alias("y_n"), F.col("label").alias("y_label"), F.col("place").alias("y_place"), *[F.col(m).alias(f"y_{m}") for m in maps], F.col("main").alias("y_main"), block.alias("y_block"), every.alias("x_block"))
    may = (F.col("y_n") >= F.col("x_n") * least - 1e-6) & ((F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y") < F.col("x"))))
    # How many atoms the pair must have in common, and so how far both prefixes go.
    need = F.ceil((F.col("x_n") + F.col("y_n")) * (least / (1 + least)) - 1e-6)
    counts = (F.col("x_place") <= F.col("x_n") - need) & (F.col("y_place") <= F.col("y_n") - need)
    apart = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in maps), F.lit(0))
    near = apart <= F.col("x_n") + F.col("y_n") - 2 * need
    found = [
        x.join(y, ["atom", "x_block", "y_block"]).where(may & counts & near & (F.col("x_label") != F.col("y_label"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        for x, y in ((long.where("x_label != main"), short), (long.where("x_label = main"), short.where("y_label != y_main")))
    ]
    return found[0].unionByName(found[1]).distinct()


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, node, class_id, is_first) of every row: the class of near duplicates and its least doc_id.

    ``is_first`` marks the rows of the class's first document.
    """
    sigs = signed(docs)
    nodes = sigs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("of"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("nid"), "node", F.col("of.doc_id").alias("rep"), "of.text_key", "bands"), "nodes")
    pairs, large = candidates(nodes.select("nid", "bands"))
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    sets = multisets(docs, nodes.select("nid", "node", "rep", "text_key").join(wanted, "nid"))
    # Only repeated rows give a node's list more than once.
    again = sigs.where(F.col("node").isNotNull()).groupBy(id_key(F.col("doc_id")).alias("id"), "text_key").count().where("count > 1").limit(1).count()
    sets = written(sets.dropDuplicates(["nid"]) if again else sets, "multisets")
    links = written(verified(pairs, sets, least), "links")
    labels = components(links)
    rest = rest_pairs(large, labels, sets, least)
    if rest is not None:
        # What failed before needn't be verified again.
        rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest_pairs")
        more = written(verified(rest, sets, least), "rest_links")
        if more.limit(1).count():
            labels = components(more, labels)
    labelled = nodes.select("nid", "node", "rep").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    best = labelled.groupBy("label").agg(F.min_by(F.struct("rep", "node"), F.struct(F.col("rep").isNull(), "rep")).alias("first"))
    of_node = labelled.join(best, "label").select("node", F.col("first.rep").alias("class_id"), (F.col("node") == F.col("first.node")).alias("first_node"))
    got = sigs.select("doc_id", "text_key", "node").join(of_node, "node", "left")
    lone = F.col("node").isNull()
    return got.select(
        "doc_id",
        "text_key",
        "node",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (lone | (F.col("first_node") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("is_first"),
    )


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    docs = docs.select(*DOC_COLUMNS)
    found = written(classes(docs).withColumn("id", id_key(F.col("doc_id"))), "classes")
    gone = small(found.where(~F.col("is_first")).select("id", "text_key").distinct())
    twice = found.where(F.col("is_first") & F.col("node").isNotNull()).groupBy("id", "node").count().where("count > 1").limit(1).count()
    keyed = docs.withColumns({"id": id_key(F.col("doc_id")), "text_key": F.xxhash64("text")})
    kept = keyed.join(gone, ["id", "text_key"], "left_anti").select(*DOC_COLUMNS)
    return kept.dropDuplicates(DOC_COLUMNS) if twice else kept

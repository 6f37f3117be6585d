"""Byte-level BPE by corpus-level merge replay, and decoding.

Words (matches of the tokenizer's pattern) are collected over a block of texts. The distinct
ones that aren't known yet stand in one array of symbols; an inverted index leads from a rank
to the places whose two symbols merge into it. Ranks are replayed in ascending order, each over
all its places at once, and only the neighbours of merged symbols are looked up anew. Words have
numbers and their ids stand in one flat array, from which every text's ids are gathered. When
too many words are held, those that the last block used stay.

Ranks are read by the driver and broadcast: a vocabulary has a fixed size.

Nulls: a null text is an empty text with no ids. Very long texts and words are handled in time
near linear in their length. Repeated rows get the same answer, empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import in_batches, read_table

#: Characters of text whose words are merged together, and words remembered between blocks.
BLOCK, REMEMBERED = 5_000_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of code points below 256, with its classes written out; None if it has others than these.

    Python's own engine runs it in half the time, and few texts need the whole pattern.
    """
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        member = regex.compile(name)
        classes[name] = "".join(f"\\x{i:02x}" for i in range(256) if member.fullmatch(chr(i)))
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|\[\^?|.", pattern, re.S):
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part[0] == "\\" and part[1].isalnum():
            return None
        else:
            inside = part[0] == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


class MergeReplay:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.token = {rank: token for token, rank in ranks.items()}

    def prepare(self) -> None:
        """Sorted codes (left rank, right rank) of all pairs that merge, and the merged ranks."""
        self.words, self.narrow, self.wide = regex.compile(self.pattern), narrow_pattern(self.pattern), re.compile("[^\x00-\xff]")
        self.size = 1 << 17
        codes, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(codes)
        self.codes, self.merged = np.array(codes, np.int64)[order], np.array(merged, np.int32)[order]
        self.codes, self.merged = np.append(self.codes, np.int64(2**62)), np.append(self.merged, np.int32(-1))
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        top = max(self.token, default=-1) + 1
        self.shown = [str(i) for i in range(top)]
        self.piece = [self.token.get(i, b"") for i in range(top)]
        self._forget([], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _forget(self, words: list[str], ids: np.ndarray, edges: np.ndarray) -> None:
        """Hold these words only: word i has the ids from edges[i] to edges[i + 1]."""
        self.number: defaultdict[str, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.ids, self.edges = ids, edges

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.codes, code)
        return np.where((left >= 0) & (right >= 0) & (self.codes[at] == code), self.merged[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many each word has), by replaying all merges over all words together."""
        # Symbol -1 keeps words apart.
        sizes = np.array([len(w) + 1 for w in words])
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbol = self.single[raw]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = -1
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> int:
            """Enter places under their ranks; the least rank entered."""
            live = ranks >= 0
            places, ranks = places[live], ranks[live]
            if not len(places):
                return 1 << 30
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            for rank, part in zip(heads, np.split(places, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)
            return heads[0]

        add(np.arange(n - 1, dtype=np.int32), self._rank(symbol[:-1], symbol[1:]))
        while queue:
            rank = heapq.heappop(queue)
            places = np.sort(np.concatenate(index.pop(rank)))
            places = places[np.concatenate(([True], places[1:] > places[:-1]))]
            follow = after[places]
            inside = follow < n
            places, follow = places[inside], follow[inside]
            # Places may be stale: the symbols there must still merge into this rank.
            valid = (symbol[places] >= 0) & (before[follow] == places)
            places, follow = places[valid], follow[valid]
            valid = self._rank(symbol[places], symbol[follow]) == rank
            places, follow = places[valid], follow[valid]
            if not len(places):
                continue
            if len(places) > 1 and (follow[:-1] == places[1:]).any():
                # Runs of places that overlap: every second place of each run, from its left end.
                linked = np.concatenate(([False], follow[:-1] == places[1:]))
                start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(places))))
                take = (np.arange(len(places)) - start) % 2 == 0
                places, follow = places[take], follow[take]
            symbol[places] = rank
            symbol[follow] = -2
            beyond = after[follow]
            after[places] = beyond
            before[beyond[beyond < n]] = places[beyond < n]
            before[follow] = -5
            left = before[places]
            has_left, has_right = left >= 0, beyond < n
            spots = np.concatenate((left[has_left], places[has_right]))
            ranks = np.concatenate((self._rank(symbol[left[has_left]], symbol[places[has_left]]), self._rank(symbol[places[has_right]], symbol[beyond[has_right]])))
            if add(spots, ranks) < rank:
                return self._merge_apart(words)
        flat = symbol[symbol != -2]
        stops = np.flatnonzero(flat == -1)
        return flat[flat >= 0], np.diff(stops, prepend=-1) - 1

    def _merge_apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For vocabularies in which a merge makes a lower rank: replay in halves, then words one by one by (rank, place)."""
        if len(words) > 1:
            half = len(words) // 2
            parts = self.merge(words[:half]), self.merge(words[half:])
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        symbol = [self.ranks[bytes([b])] for b in words[0]]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int):
            j = after[i] if i >= 0 else n
            return self.ranks.get(self.token[symbol[i]] + self.token[symbol[j]]) if j < n else None

        queue = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            if symbol[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            symbol[i], symbol[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(queue, (x, k))
        ids = np.array([s for s in symbol if s >= 0], np.int32)
        return ids, np.array([len(ids)])

    def learn_words(self) -> None:
        """Append the ids of the words that have a number but no ids yet."""
        new = [w.encode("utf-8", "surrogatepass") for w in islice(self.number, len(self.edges) - 1, None)]
        if not new:
            return
        # A word that is a token as a whole is that token.
        whole = np.array(list(map(self.ranks.get, new, [-1] * len(new))), np.int32)
        hard = np.flatnonzero(whole < 0)
        sizes = np.ones(len(new), np.int64)
        if len(hard):
            ids, sizes[hard] = self.merge([new[i] for i in hard.tolist()])
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1], np.int32)
        easy = whole >= 0
        out[ends[easy] - 1] = whole[easy]
        if len(hard):
            out[np.repeat(~easy, sizes)] = ids
        self.ids = np.concatenate((self.ids, out))
        self.edges = np.concatenate((self.edges, self.edges[-1] + ends))

    def _gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of the words of these numbers, how many each has)."""
        sizes = self.edges[codes + 1] - self.edges[codes]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(self.edges[codes] - before, sizes)], sizes

    def blocks(self, texts: Iterable[str]) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by spaces, their number, decoded bytes) of each text, in order."""

        def words_of(text: str) -> list[str]:
            return (self.words if self.narrow is None or self.wide.search(text) else self.narrow).findall(text)

        def flush(held: list[str]):
            coded = [np.array(list(map(self.number.__getitem__, words_of(t))), np.int64) for t in held]
            self.learn_words()
            for codes in coded:
                ids = self._gathered(codes)[0].tolist()
                yield " ".join(map(self.shown.__getitem__, ids)), len(ids), b"".join(map(self.piece.__getitem__, ids))
            if len(self.number) > REMEMBERED:
                used = np.zeros(len(self.number), bool)
                for codes in coded:
                    used[codes] = True
                ids, sizes = self._gathered(np.flatnonzero(used))
                words = [w for w, u in zip(self.number, used.tolist(), strict=True) if u]
                self._forget(words, ids, np.concatenate(([0], np.cumsum(sizes))))

        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, with ``ids`` and ``decoded`` on request."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])

    def encoded(model: MergeReplay, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        counts, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
        for ids, n, data in model.blocks(x.as_py() for batch in held for x in batch.column(1)):
            counts.append(n)
            ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hash.append(hashlib.sha256(data).hexdigest())
            if with_ids:
                all_ids.append([int(i) for i in ids.split()])
                decoded.append(data.decode("utf-8", "replace"))
        columns = [pa.concat_arrays([batch.column(0) for batch in held]), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        if with_ids:
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made anew in every task, so that nothing of it outlives the task in a worker.
        model = MergeReplay(ranks.value, pattern)
        model.prepare()
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield encoded(model, held)
                held, size = [], 0
        if held:
            yield encoded(model, held)

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return in_batches(base).mapInArrow(run, schema)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to, as digests."""
    return encode_decode(read_table(spark, sf_dir, "documents"), *_public())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: digests of every row's ids and decoded bytes."""
    return encode_decode(docs, *_public())

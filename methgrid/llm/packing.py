"""Best-fit packing of documents into sequences, by minimum bin slack.

Documents become ids, end in ``END``, and are cut into pieces of at most ``capacity`` ids: only longer
ones are cut, all pieces but the first are full. Pieces are known by their length alone while they are
packed. For the bin that takes the longest piece left, a bitset subset-sum over the lengths left (each as
often as it is left, in chunks of powers of two) finds the fullest feasible combination, which is then
removed; the same combination is taken again as long as its pieces last, so the number of different
combinations depends on ``capacity`` and not on the number of documents. The lengths' counts, at most
``capacity`` rows, are all that the driver sees, and the combinations, a bounded table, are broadcast.
Each piece then finds its bin by its number among the pieces of its length, in one join by length.

Ids are those of the tokenizers library. A text's words (matches of the pre-tokenizer's pattern) are
looked up; those not seen before are encoded by the library, many in one call. Each Python worker
remembers a bounded number of words. Special tokens' strings in a text are ordinary text.

Nulls: a null text is empty; an empty document is the one id ``END``. A null ``doc_id`` is kept. Repeated
rows are packed each by itself. Very long texts are encoded by slices that the pattern cuts there too.
Empty tables give empty results; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import narrow_pattern
from .common import in_batches, ordered, read_table, written

CAPACITY, END = 1024, 2

#: Characters whose words are encoded together, of a slice of a text, and words remembered between blocks.
BLOCK, SLICE, REMEMBERED = 2_000_000, 500_000, 700_000
#: Words given to the library in one call.
TOGETHER = 2000

#: A blank between two letters or digits always begins a word.
CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Control characters that Python's engines count as white space and the library doesn't, and any character beyond one byte.
ODD, ODD_OR_WIDE = re.compile("[\x1c-\x1f\x85]"), re.compile("[\x1c-\x1f\x85\u0100-\U0010ffff]")


def slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * SLICE and (m := CUT.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Ids of texts by the tokenizers library, remembered by word."""

    def __init__(self, tokenizer: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.words, self.narrow = regex.compile(pattern), narrow_pattern(pattern)
        self.odd: set[str] = set()
        self._hold([], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _hold(self, words: list[str], ids: np.ndarray, edges: np.ndarray) -> None:
        """Remember these words only: word i has the ids from edges[i] to edges[i + 1]."""
        self.number: defaultdict[str, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.ids, self.edges = ids, edges
        self.uses = np.zeros(len(words), np.int64)

    def _words(self, text: str) -> list[str]:
        if self.narrow and not ODD_OR_WIDE.search(text):
            return self.narrow.findall(text)
        if ODD.search(text):
            self.odd.add(text)
            return [text]
        return self.words.findall(text)

    def _encoded(self, words: list[str], between: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many each word has); between: what keeps words apart, None if they can't be joined."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        step = 1 if between is None else TOGETHER
        for at in range(0, len(words), step):
            some = words[at : at + step]
            got = self.tokenizer.encode((between or "").join(some), add_special_tokens=False)
            found, owner = np.array(got.ids, np.int32), np.array(got.word_ids, np.int64)
            if between is None:
                owner = np.zeros(len(found), np.int64)
            elif between:
                own = owner % 2 == 0
                found, owner = found[own], owner[own] // 2
            ids.append(found)
            sizes.append(np.bincount(owner, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self) -> None:
        """Append the ids of the words that have a number but no ids yet."""
        new = list(islice(self.number, len(self.edges) - 1, None))
        if not new:
            return
        # Words led by a blank stand apart by themselves, others between line ends; white space and odd texts go alone.
        kinds = [(0 if len(w) > 1 and not w[1].isspace() else 2) if w[0] == " " else 2 if w[0].isspace() else 1 for w in new]
        if self.odd:
            kinds = [2 if w in self.odd else k for w, k in zip(new, kinds, strict=True)]
            self.odd.clear()
        kind = np.array(kinds)
        sizes, found = np.zeros(len(new), np.int64), []
        for k, between in enumerate(("", "\n", None)):
            ids, sizes[kind == k] = self._encoded(list(compress(new, (kind == k).tolist())), between)
            found.append(ids)
        owner = np.repeat(kind, sizes)
        out = np.empty(len(owner), np.int32)
        for k, ids in enumerate(found):
            out[owner == k] = ids
        self.ids = np.concatenate((self.ids, out))
        self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(sizes)))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))

    def _gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.edges[codes + 1] - self.edges[codes]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(self.edges[codes] - before, sizes)], sizes

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""

        def flush(held: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
            self._learn()
            for parts in held:
                yield np.concatenate([self._gathered(codes)[0] for codes in parts])
            self.uses += np.bincount(np.concatenate([codes for parts in held for codes in parts]), minlength=len(self.uses))
            if len(self.number) > REMEMBERED:
                # Words met once go; if that leaves too many, only those of this block stay.
                kept = self.uses > 1
                if kept.sum() > 0.8 * REMEMBERED:
                    kept[:] = False
                    kept[np.concatenate([codes for parts in held for codes in parts])] = True
                ids, sizes = self._gathered(np.flatnonzero(kept))
                self._hold(list(compress(self.number, kept.tolist())), ids, np.concatenate(([0], np.cumsum(sizes))))

        held, size = [], 0
        for text in texts:
            held.append([np.array(list(map(self.number.__getitem__, self._words(part))), np.int64) for part in slices(text)])
            size += len(text)
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)


#: The last encoder that this Python process used.
_LAST: dict[int, Encoder] = {}


def _encoder(tokenizer: str, pattern: str) -> Encoder:
    key = hash((tokenizer, pattern))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(tokenizer, pattern)
    return _LAST[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all but the first are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row of ``docs``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        last = np.array([end], np.int32)
        for batch in batches:
            owner, rows = [], []
            for i, ids in enumerate(encoder.encode(x.as_py() for x in batch.column(1))):
                ids = np.concatenate((ids, last)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    owner.append(i)
                    rows.append((k, start, length, crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(left: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of pieces that fills most of ``room``, longer ones first; ``left`` counts pieces by length."""
    reach, chunks = 1, []
    inside = (1 << room + 1) - 1
    for length in range(min(room, len(left) - 1), 0, -1):
        spare, chunk = min(left[length], room // length), 1
        while spare and not reach >> room & 1:
            chunk = min(chunk, spare)
            chunks.append((length, chunk, reach))
            reach |= reach << length * chunk & inside
            spare -= chunk
            chunk *= 2
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, chunk, before in reversed(chunks):
        if not before >> at & 1:  # only this chunk leads there
            taken[length] += chunk
            at -= length * chunk
    return sorted(taken.items(), reverse=True)


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, times, sequence, offset) that say where the pieces of each length go.

    Pieces ``from`` to ``to - 1`` of a length are dealt in turn to ``times`` sequences that begin with number
    ``sequence``, at ``offset`` and, in later turns, behind one another.
    """
    left = [counts.get(length, 0) for length in range(capacity + 1)]
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            taken = dict(fullest(left, capacity - longest))
            left[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            times = min(left[length] // n for length, n in taken.items())
            offset = 0
            for length, n in sorted(taken.items(), reverse=True):
                rows.append((length, used[length], used[length] + n * times, times, sequence, offset))
                used[length] += n * times
                left[length] -= n * times
                offset += n * length
            sequence += times
    return rows


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_up`` (a stored table with ``length``, ``doc_id`` and ``piece``) with ``sequence_id`` and ``offset``."""
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    plan = [(length, before[length] + low, before[length] + high, times, sequence, offset) for length, low, high, times, sequence, offset in combinations(counts, capacity)]
    deal = cut_up.sparkSession.createDataFrame(plan, "length long, _from long, _to long, _times long, _sequence long, _offset long")
    # The row's number splits a length that many rows share, even rows that are equal.
    placed = ordered(cut_up.withColumn("_row", F.monotonically_increasing_id()), ["length", "doc_id", "piece", "_row"], "_place")
    meets = (placed["length"] == deal["length"]) & (placed["_place"] >= deal["_from"]) & (placed["_place"] < deal["_to"])
    joined = placed.join(F.broadcast(deal), meets).drop(deal["length"])
    sequence = F.expr("_sequence + (_place - _from) % _times")
    offset = F.expr("_offset + (_place - _from) div _times * length")
    return joined.withColumn("sequence_id", sequence).withColumn("offset", offset).drop("_row", "_place", "_from", "_to", "_times", "_sequence", "_offset")


def op11_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they lie in sequences of 1024 tokens."""
    import public_tokenizers

    cut_up = written(pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "pieces")
    return pack(cut_up).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Language identification by a byte convolutional network.

Texts are cut into fixed-length windows of bytes. Filters of several widths run over each
window, each filter's highest response is kept (max pooling, then ReLU), and a softmax layer
gives the languages. Training is numpy's: a bounded sample of labelled texts, Adam, on the
driver. Prediction covers every window of every text in Arrow batches, adds the windows' log
probabilities weighted by their lengths, and needs no shuffle.

A filter of width w over one-hot bytes is a sum of w table rows. For prediction, neighbouring
tables are folded into one over byte pairs, so that width w costs w / 2 look-ups.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with null text or
language are not learned from; with nothing to learn from, all rows are ``und``. Very long
texts are read window by window. Repeated rows get the same answer. Other columns are ignored;
``language_stage`` returns those of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, in_batches, read_table, small, written

#: Bytes of a window.
WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 16
#: Labelled texts to learn from, whole: the bound of what the driver gathers.
SAMPLE = 2000
#: As many steps whatever the sample's size.
STEPS, BATCH, RATE = 800, 64, 0.004
UNKNOWN = "und"
LETTER = r"\p{L}"
#: How far from chance to certainty a language must be.
MARGIN = 0.1


class ByteConv:
    """The network: ``tables[w]`` is (w, 256, FILTERS), ``out`` is (features, languages)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shift = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam over minibatches; the pooled position of each filter alone gets the gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), *self.shift.values(), self.out, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        while t < STEPS:
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
                grads = self._gradients(x, y)
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        pooled, peaks = [], []
        for w in WIDTHS:
            reach = WINDOW - w + 1
            response = sum(self.tables[w][j][x[:, j : j + reach]] for j in range(w))
            peak = response.argmax(1)
            pooled.append(np.take_along_axis(response, peak[:, None, :], 1)[:, 0, :] + self.shift[w])
            peaks.append(peak)
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        score = hidden @ self.out + self.bias
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (raw > 0)
        tables, shifts = [], []
        for k, w in enumerate(WIDTHS):
            g, own = np.zeros_like(self.tables[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
            filters = np.broadcast_to(np.arange(FILTERS), own.shape)
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, peaks[k] + j, 1), filters), own)
            tables.append(g)
            shifts.append(own.sum(0))
        return [*tables, *shifts, hidden.T @ p, p.sum(0)]

    def fold(self) -> None:
        """Tables over byte pairs for prediction."""
        self.pairs = {w: [(self.tables[w][j][:, None, :] + self.tables[w][j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w, 2)] for w in WIDTHS}

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) for windows (n, WINDOW) of bytes."""
        code = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for w in WIDTHS:
            reach = WINDOW - w + 1
            response = self.pairs[w][0][code[:, :reach]]
            for j in range(1, w // 2):
                response += self.pairs[w][j][code[:, 2 * j : 2 * j + reach]]
            pooled.append(response.max(1) + self.shift[w])
        score = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled with spaces, and the bytes that each really has."""
    raw = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """(lang, chance, text): the first ``sample`` / languages distinct texts of each language by a hash; None without labels.

    A language with fewer is taken whole; of more languages than ``sample``, those with the first texts by the hash. Languages
    and their parts are a table, so there may be any number. Rows are thinned to somewhat more than a
    language's part first, so that no task ranks a whole language.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    counts = written(known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    each = max(1, sample // languages)
    # The count may be a tenth too high, and what a hash takes is off by some square roots.
    share = F.least(F.lit(1.0), F.lit(1.1 * (each + 8 * each**0.5 + 30)) / F.greatest("n", F.lit(1)))
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    thinned = known.withColumn("chance", chance).join(small(counts.select("lang", share.alias("share"))), "lang").where(F.col("chance") < F.col("share"))
    some = thinned.withColumn("text_key", F.xxhash64("text")).dropDuplicates(["lang", "text_key"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "text_key"))
    kept = some.withColumn("place", place).where(F.col("place") <= each)
    return kept.orderBy("place", "chance", "text_key", "lang").limit(sample).select("lang", "chance", "text")


def learn(docs: DataFrame, sample: int = SAMPLE) -> ByteConv | None:
    """A network from labelled rows that aren't held out: all windows of ``sample`` texts at most, the same in every run."""
    chosen = sampled(docs, sample)
    if chosen is None:
        return None
    rows = sorted(chosen.collect(), key=lambda r: (r.chance, r.lang, r.text))
    number = {lang: i for i, lang in enumerate(sorted({r.lang for r in rows}))}
    cut = [(windows_of(r.text.encode())[0], number[r.lang]) for r in rows]
    if not cut:
        return None
    net = ByteConv(list(number))
    net.train(np.concatenate([c[0] for c in cut]), np.concatenate([np.full(len(c[0]), c[1]) for c in cut]))
    return net


def held_out(doc_id) -> F.Column:
    """True for the third of rows, by checksum of the id, that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, net: ByteConv | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score."""
    base = docs.select(*keep, F.when(F.col("text").rlike(LETTER), F.col("text")).alias("_text"))
    if net is None:
        return base.drop("_text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if not hasattr(model, "pairs"):
            model.fold()
        for batch in batches:
            names, scores, queue, owners, weights = [UNKNOWN] * len(batch), np.zeros(len(batch)), [], [], []
            total = np.zeros((len(batch), len(model.languages)))

            def flush():
                x, who, size = np.concatenate(queue), np.concatenate(owners), np.concatenate(weights)
                for at in range(0, len(x), 512):
                    part = slice(at, at + 512)
                    np.add.at(total, who[part], model.log_probabilities(x[part]) * (size[part] / WINDOW)[:, None])
                queue.clear(), owners.clear(), weights.clear()

            texts, held, some = batch.column(len(keep)), 0, []
            for i in range(len(batch)):
                if not texts[i].is_valid:
                    continue
                x, size = windows_of(texts[i].as_buffer().to_pybytes())
                queue.append(x), owners.append(np.full(len(x), i)), weights.append(size)
                some.append(i)
                held += len(x)
                if held > 20_000:
                    flush()
                    held = 0
            if queue:
                flush()
            total -= total.max(1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i in some:
                names[i], scores[i] = model.languages[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return in_batches(base).mapInArrow(run, schema)


def op5_byte_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a known language.

    Texts without a letter go, as do those whose best language is hardly likelier than chance. If
    no row has a language to learn from, only texts without a letter go.
    """
    docs = docs.select(*DOC_COLUMNS)
    net = learn(docs)
    if net is None:
        return docs.where(F.col("text").rlike(LETTER))
    chance = 1 / len(net.languages)
    got = predict(docs, net, DOC_COLUMNS)
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= chance + MARGIN * (1 - chance))).select(*DOC_COLUMNS)

"""Secret scans with multipart credential linking.

Strong secrets (assigned values, access identifiers, long hexadecimal runs) are reported
wherever they stand. Weak parts (a user name, a bare key-like run, a short pass phrase, an
endpoint) are common in harmless text, so each is reported only if a complementary part lies
within ``SCOPE`` code points of it in the same text: an interval join over exploded parts.

Spans are code points, end exclusive. Nulls: a null text is an empty text; a null ``doc_id``
is carried. Empty tables give empty results, repeated rows the same result each. Other columns
are ignored; ``redact_stage`` returns the columns of documents only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, read_table, small, written

#: Kind, role, pattern, group whose length counts, least length, texts without which nothing matches.
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
BASE = [
    ("assign", "secret", r"(?i)(password|passwd|secret|token|api_?key)(?-i)" + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 8, [":", "="]),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16, ["AKIA"]),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32, []),
]
WEAK = [
    ("user", "identifier", r"(?i)\b(user(?:name|_id)?|login|client_id|account_id|access_key_id)(?-i)" + VALUE + r"([A-Za-z0-9_.@-]+)", 2, 3, [":", "="]),
    ("pass", "secret", r"(?i)\b(pass|pwd|passphrase|credential|private_key|access_key|auth)(?-i)" + VALUE + r"([A-Za-z0-9+/_.=!@#$%-]+)", 2, 4, [":", "="]),
    ("key", "secret", r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]*[0-9])[A-Za-z0-9/+]{40,}", 0, 40, []),
    ("endpoint", "endpoint", r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8, ["://"]),
]
KINDS = [k[0] for k in BASE + WEAK]
ROLE = {k[0]: k[1] for k in BASE + WEAK}
#: Code points between parts of one credential, at most.
SCOPE = 400

SPAN = "struct<start:int,ord:int,end:int>"


def _found(text, ord_: int, spec) -> F.Column:
    """Array of SPAN: the leftmost non-overlapping matches of a pattern that are long enough.

    The texts between the matches give the places: each match starts where the text before it ends.
    """
    _, _, pattern, group, least, needs = spec
    none = F.array().cast(f"array<{SPAN}>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = x["hit"] if group == 0 else F.regexp_extract(x["hit"], pattern, group)
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    may = text.rlike(pattern)
    for need in needs and [needs]:
        present = F.lit(False)
        for part in need:
            present = present | text.contains(part)
        may = F.when(present, may).otherwise(F.lit(False))
    return F.when(may, walked).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, weak): spans by kind of every row, as a written table without texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[_found(text, i, s) for i, s in enumerate(BASE)]))
    weak = F.concat(*[_found(text, i + len(BASE), s) for i, s in enumerate(WEAK)])
    return written(docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_key"), base.alias("base"), weak.alias("weak")), "secret_spans")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("id_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))))


def _role(ord_) -> F.Column:
    out = F.lit(None).cast("string")
    for i, kind in enumerate(KINDS):
        out = F.when(ord_ == i, F.lit(ROLE[kind])).otherwise(out)
    return out


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id_key, text_key, linked): the weak spans with a complementary part in their scope.

    Both sides are cut into buckets of ``scope`` code points; a part is offered to its own and
    the two buckets beside it, so the join's fan-out is bounded by what fits in a scope.
    A secret completes an identifier or an endpoint, and either of these completes a secret.
    """
    some = _keyed(scanned.where(F.size("weak") > 0)).dropDuplicates(["id_key", "text_key"])
    role = _role(F.col("span.ord"))
    weak = some.select("id_key", "text_key", F.explode("weak").alias("span")).withColumn("bucket", F.floor(F.col("span.start") / scope)).withColumn("is_secret", role == "secret")
    other = some.select("id_key", "text_key", F.explode(F.concat("base", "weak")).alias("span")).select(
        "id_key",
        "text_key",
        F.col("span.start").alias("o_start"),
        F.col("span.end").alias("o_end"),
        (role == "secret").alias("o_secret"),
        F.explode(F.expr(f"sequence(cast(span.start / {scope} as bigint) - 1, cast(span.end / {scope} as bigint) + 1)")).alias("bucket"),
    )
    near = (F.col("o_start") - F.col("span.end") <= scope) & (F.col("span.start") - F.col("o_end") <= scope)
    apart = (F.col("o_start") >= F.col("span.end")) | (F.col("span.start") >= F.col("o_end"))
    w, o = weak.alias("w"), other.alias("o")
    same = (F.col("w.id_key") == F.col("o.id_key")) & (F.col("w.text_key") == F.col("o.text_key")) & (F.col("w.bucket") == F.col("o.bucket"))
    kept = w.join(o, same & (F.col("w.is_secret") != F.col("o.o_secret")) & near & apart, "left_semi")
    return kept.groupBy("id_key", "text_key").agg(F.sort_array(F.collect_list("span")).alias("linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, linked) of every row of ``docs``; ``base`` and ``linked`` are arrays of SPAN."""
    scanned = scan(docs)
    got = _keyed(scanned).join(linked(scanned), ["id_key", "text_key"], "left")
    return got.select("doc_id", "text_key", "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["ord"]], s["start"], s["end"])), ",")


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: the base kinds, and weak parts that complete each other."""
    got = find_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(kind))).cast("long")

    return got.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").alias("n_linked"),
    )


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets and linked parts but endpoints masked; texts without any are unchanged."""
    mask = "[secret]"
    hidden = F.filter(F.array_sort(F.concat("base", "linked")), lambda s: s["ord"] != KINDS.index("endpoint"))
    found = _keyed(find_secrets(docs)).select("id_key", "text_key", hidden.alias("hidden")).where(F.size("hidden") > 0).dropDuplicates(["id_key", "text_key"])
    found = small(written(found, "secret_masks"), 100_000)
    text = F.col("text")

    def cut(acc, s):
        # Overlapping spans share one mask.
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate("hidden", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = _keyed(docs.select(*DOC_COLUMNS)).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    got = rows.join(found, ["id_key", "text_key"], "left").withColumn("masked", F.when(F.col("hidden").isNotNull(), clean).otherwise(text))
    return got.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(F.col("hidden").isNotNull(), F.length("masked").cast("long")).otherwise(F.col("n_chars").cast("long")).alias("n_chars"))

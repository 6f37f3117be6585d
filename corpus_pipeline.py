"""The corpus pipeline: language ID, near-duplicate removal, secret masking, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``:

- language_id keeps rows whose language is known (texts without a letter go);
- near_dedup keeps one document of each class of near duplicates;
- secrets masks what the secret scan reports and keeps every row;
- mix repeats or drops rows so that every source meets its target of words;
- bpe returns doc_id, n_tokens and digests of the ids and of the bytes they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methgrid.llm.bpe import bpe_stage
from methgrid.llm.common import read_table, written
from methgrid.llm.language import language_stage
from methgrid.llm.minhash import near_dedup_stage
from methgrid.llm.mixing import mix_stage
from methgrid.llm.secrets import redact_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", redact_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the learned, hashed and encoded stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

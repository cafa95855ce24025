"""A pipeline over the documents: toxic texts go, one of each near-duplicate class stays, contaminated texts go, secrets are blotted out, the rest is packed.

Every stage takes whole texts of any length, rows in any order and tables of no rows, which stay empty. Filtering stages
keep columns of any names as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import decontamination, near_duplicates, packing, secret_scan, toxicity
from lodeglass.llm.shared import delete, shared_folder, spare
from lodeglass.sources.adapters import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7.

    Null, empty and wordless texts have the score of a text without evidence, and equal texts equal scores, so repeated
    rows stay or go together. Without labels of both classes every score is the share of toxic labels (0 without any).
    """
    (score,) = spare(docs, 1)
    scored = toxicity.with_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score)
    return scored.filter(F.col(score) < 0.7).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of least doc_id, among equal ones that of least text hash.

    Null and empty texts are in no class and stay, each doc_id once; of rows repeated under one doc_id one stays.
    """
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    Null, empty and wordless texts share none and stay, as all do where the benchmark is empty; repeated rows stay or go together.
    """
    (passages,) = spare(docs, 1)
    found = decontamination.with_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passages)
    return found.filter(F.col(f"{passages}.n_hit") == 0).drop(passages)


def blot_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [REDACTED] in place of secrets and n_chars as it is then.

    Null texts stay null and so does their n_chars; empty ones stay empty; repeated rows stay repeated.
    """
    clean = docs.withColumn("text", secret_scan.redacted("text"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece.

    Null and empty texts are one token, the end id; repeated rows are packed as often as they occur; a null doc_id stays null.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", blot_out_secrets), ("packing", pack)]

#: SQL can neither score texts nor sign, pack or tokenise them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last returns is written to the shared folder and read again, and goes once the next is written."""
    folder, docs, last = shared_folder(spark), spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

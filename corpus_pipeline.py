"""Corpus pipeline: language ID, near-dedup, decontamination, PII, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, language_id, mixing, order_minhash, pii
from siftline.llm.scratch import Scratch

#: No stage but the last is plain SQL; tests/llm hold them against brute-force twins.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; ``lang`` is filled by the prediction where it is null.

    Rejected are null texts and texts without letters, which no language fits.
    Where no document has a language to learn from, all others stay with the
    ``lang`` they have. Repeated rows are judged each, null ids and other
    columns do not count, and an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    found = language_id.predict(rows, model, ["row"], None, "text").where("n_letters > 0")
    lang = F.coalesce(F.col("row").getField("lang"), F.nullif("lang_pred", F.lit("und")))
    return found.select(*[(lang if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, the one of the least id.

    Null texts and texts without words are in no class and stay. Of rows alike
    in id and text one stays, null ids included. Other columns do not count; an
    empty table gives an empty one.
    """
    return order_minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.

    Null and empty texts hold none and stay; every repeated row is judged by its
    own text, null ids too. Other columns do not count; an empty table, or an
    empty benchmark, gives what came.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null, with null n_chars; repeated rows all stay; other
    columns do not count; an empty table gives an empty one.
    """
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it.

    Null texts have size 0, null sources are a source, repeated rows have a row
    each; other columns do not count; an empty table gives an empty one.
    """
    return mixing.digest(mixing.mix(docs))


STAGES = [
    ("language_id", language_stage),
    ("order_minhash", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    last = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs

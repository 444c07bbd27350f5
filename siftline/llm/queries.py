"""Thin queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ball_tree, decontaminate, embed_dedup, host_quality, language_id, masked_lm, mixing, order_minhash, pii, secret_scan, token_align, url_filter, warc_fixity
from .oracles import ORACLES  # noqa: F401
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def decayed(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """A replica with planted faults: records of ids 13 modulo 97 have a byte changed, those of 7 modulo 389 are lost, so all after them move up."""
    bad = F.concat(F.substring("record", 1, 9), F.lit("?"), F.substring("record", 11, 1 << 30))
    changed = records.where("id % 97 = 13").select("id", "digest", F.sha2(bad, 256).alias("bad")).distinct()
    rows = manifest.where("id is null or id % 389 <> 7").join(changed, ["id", "digest"], "left").withColumn("digest", F.coalesce("bad", "digest"))
    order = Window.partitionBy("segment").orderBy("seq")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return rows.withColumn("moved", offset).withColumn("seq", (F.row_number().over(order) - 1).cast("bigint")).withColumn("offset", F.col("moved")).drop("bad", "moved")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_fixity.records(_table(spark, sf_dir, "pages"))
    ours = Scratch(spark).table(warc_fixity.lay_out(records), "manifest")
    return warc_fixity.audit(ours, decayed(ours, records)).withColumnRenamed("id", "page_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, rule failures and host verdicts of all documents; their host is the source."""
    return host_quality.judge(_table(spark, sf_dir, "documents"))


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, distances and inertia of all embeddings that count."""
    return ball_tree.cluster(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of all documents under the two public tokenizers."""
    return token_align.align(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_source_mixing,
        op3_pii,
        op4_order_minhash,
        op5_masked_lm,
        op6_warc_fixity,
        op7_url_filter,
        op8_language_id,
        op9_secret_scan,
        op10_decontamination,
        op11_host_quality,
        op12_ball_tree_clusters,
        op13_token_alignment,
    )
}

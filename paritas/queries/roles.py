"""The shared tables in the roles of the audit: ranked applicants, labels and predictions, scores with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scalars import binary_group

SEGMENT_0, SEGMENT_1 = ("BUILDING", "MACHINERY", "HOUSEHOLD"), ("AUTOMOBILE",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: id, score (balance), grp by market segment; one segment is in no group (-1)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), binary_group(F.col("c_mktsegment"), SEGMENT_0, SEGMENT_1).alias("grp"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


APPLICANTS = """a AS (SELECT c_custkey AS id, c_acctbal AS score, c_mktsegment AS segment, c_nationkey AS nation,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 0 WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE -1 END AS grp FROM customer)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: a key of five parts, score (discount, eleven values), grp by return flag."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, sf_dir, "lineitem").select(key.alias("id"), F.col("l_discount").alias("score"), binary_group(F.col("l_returnflag"), ["A", "N"], ["R"]).alias("grp"), "l_returnflag", "l_linestatus", "l_quantity")


LINES = """l AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, l_discount AS score,
  l_returnflag, l_linestatus, l_quantity, CASE WHEN l_returnflag IN ('A', 'N') THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS grp FROM lineitem)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, group (English or not), label (quality), proba from the length, yhat, and a second decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    proba = F.col("n_chars") / (F.col("n_chars") + 1500.0)
    rows = rows.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("group"), F.col("quality").alias("label"), proba.alias("proba"), F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"))
    return rows.withColumn("yhat", (F.col("proba") >= 0.5).cast("int")).withColumn("cf_yhat", (F.col("proba") + F.when(F.col("group") == 0, 0.0).otherwise(0.05) >= 0.5).cast("int"))


EVALUATED = """e AS (SELECT *, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS yhat, CASE WHEN proba + CASE WHEN grp = 0 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END >= 0.5 THEN 1 ELSE 0 END AS cf_yhat FROM (
  SELECT d.doc_id AS id, CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS grp, quality AS label, n_chars::DOUBLE / (n_chars::DOUBLE + 1500.0::DOUBLE) AS proba, n_chars::DOUBLE AS n_chars, toxic::DOUBLE AS toxic
  FROM documents d JOIN labels USING (doc_id)))"""


def sel(source: str, fraction: float, seed: int = 0, least: int = 1, cells: str = "", name: str = "s", order: str = "score") -> str:
    """SQL of a top-K selection over ``source`` (columns id, score)."""
    part = f"PARTITION BY {cells} " if cells else ""
    return f"""{name} AS (SELECT *, CASE WHEN rk <= greatest({least}, round_even({fraction} * n, 0)) THEN 1 ELSE 0 END AS selected FROM (
  SELECT *, row_number() OVER ({part}ORDER BY {order} DESC NULLS LAST, md5('{seed}:' || id::VARCHAR)) AS rk, count(*) OVER ({part}) AS n FROM {source}))"""


RATES = """avg(CASE WHEN grp = 0 THEN selected::DOUBLE END) AS r0, avg(CASE WHEN grp = 1 THEN selected::DOUBLE END) AS r1,
  count(CASE WHEN grp = 0 THEN 1 END)::BIGINT AS n_group0, count(CASE WHEN grp = 1 THEN 1 END)::BIGINT AS n_group1"""

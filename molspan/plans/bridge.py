"""The driver's tables as molecules, marks, intervals, reads and contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molspan.functions.chain import Model

#: A toy alphabet of two contexts: hits 0 and 1, misses 3 and 4, 5 is no target.
MODEL = Model((0.5, 0.5), (0.95, 0.95), ((0.04, 0.06, 1e-30, 0.96, 0.94, 1.0), (0.75, 0.85, 1e-30, 0.25, 0.15, 1.0)))
#: Steps of the segment scan on a hit and on a miss.
HIT, MISS = -2.0, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, pos, code, hit, opp, step): events of a user in time order are the bases of a molecule."""
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), code.alias("code"))
    hit, opp = (F.col("code") <= 1).cast("int"), (F.col("code") <= 4).cast("int")
    return rows.withColumns({"hit": hit, "opp": opp, "step": F.when(hit == 1, HIT).when(opp == 1, MISS).otherwise(0.0)})


OBS = f"""
obs AS (SELECT *, CASE WHEN hit = 1 THEN {HIT} WHEN opp = 1 THEN {MISS} ELSE 0.0 END::DOUBLE AS step FROM (
  SELECT *, CASE WHEN code <= 1 THEN 1 ELSE 0 END AS hit, CASE WHEN code <= 4 THEN 1 ELSE 0 END AS opp FROM (
    SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS code
    FROM events)))
"""


def coded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, codes): one row a molecule."""
    rows = obs(spark, sf_dir).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("x"))
    return rows.select("read_id", F.transform("x", lambda x: x["code"]).alias("codes"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, start, stop, kind, score): order lines as intervals on molecules."""
    start, n = F.col("l_partkey") % 500, F.col("l_quantity").cast("long")
    kind = F.when(F.col("l_returnflag") == "R", "tf").otherwise("nuc")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), start.alias("start"), (start + n).alias("stop"), kind.alias("kind"), (F.col("l_linenumber") * 10).cast("long").alias("score"))


INTERVALS = """
iv AS (SELECT l_orderkey AS read_id, l_partkey % 500 AS start, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS stop,
  CASE WHEN l_returnflag = 'R' THEN 'tf' ELSE 'nuc' END AS kind, CAST(l_linenumber * 10 AS BIGINT) AS score FROM lineitem)
"""


def seqs(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.regexp_replace(F.upper("text"), f"[^{letters}]", "").alias("seq"))


def seqs_sql(letters: str = "ACGT") -> str:
    return f"seqs AS (SELECT doc_id AS read_id, regexp_replace(upper(text), '[^{letters}]', '', 'g') AS seq FROM documents)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads: mapq by priority, length by price, flags by status; buyers of one segment were trained on."""
    trained = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")).distinct().withColumn("trained", F.lit(True))
    rows = table(spark, sf_dir, "orders").join(trained, "o_custkey", "left")
    return rows.select(F.col("o_orderkey").alias("read_id"), (F.substring("o_orderpriority", 1, 1).cast("int") * 10).alias("mapq"), F.when(F.col("o_totalprice") >= 0, F.floor("o_totalprice")).cast("long").alias("length"), (F.col("o_orderstatus") == "P").alias("unmapped"), (F.col("o_custkey") % 11 == 0).alias("secondary"), F.coalesce("trained", F.lit(False)).alias("trained"), F.col("o_custkey").alias("source_file"))


READS = """
reads AS (SELECT o_orderkey AS read_id, CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS mapq, CAST(floor(o_totalprice) AS BIGINT) AS length,
  o_orderstatus = 'P' AS unmapped, o_custkey % 11 = 0 AS secondary, o_custkey AS source_file,
  o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS trained FROM orders)
"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as contigs, a thousand bases a customer."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    return table(spark, sf_dir, "nation").join(n, "n_nationkey", "left").select(F.col("n_name").alias("chrom"), (1000 * F.coalesce("c", F.lit(0))).cast("long").alias("length"))


CONTIGS = """
contigs AS (SELECT n_name AS chrom, CAST(1000 * coalesce(c, 0) AS BIGINT) AS length FROM nation
  LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)
"""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_all_marks_of_a_hot_molecule_come_back(spark, tmp_path):
    n = 1_000_500
    event = F.when(F.col("id") % 1000 == 7, "view").otherwise("click")
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).cast("long").alias("user_id"), event.alias("event_type"))
    more = spark.range(n, n + 2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"))
    rows.unionByName(more).write.parquet(str(tmp_path / "events.parquet"))
    hits = n + 2000 - 1001
    got = entry.queries()["q_fn01_mm_roundtrip"](spark, str(tmp_path)).agg(F.count("*"), F.max("k"), F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(got) == (hits, hits - 1, n + 1999, hits)

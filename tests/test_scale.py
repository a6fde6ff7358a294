from molspan.operators import intervals


def test_points_meet_spaces_without_a_row_for_each_base(spark):
    # one space of 10 ** 12 bases: laid out by base this would never end
    spaces = spark.createDataFrame([(1, 5, 10**12), (1, 10**12 + 5, 10**12 + 9), (2, 0, 3), (3, 4, 4)], "k long, start long, stop long")
    points = spark.createDataFrame([(1, 4, "a"), (1, 5, "b"), (1, 10**12 - 1, "c"), (1, 10**12, "d"), (1, 10**12 + 8, "e"), (2, 2, None), (2, 3, "f"), (3, 4, "g"), (4, 0, "h")], "k long, pos long, v string")
    got = sorted(tuple(r) for r in intervals.holding(points, spaces, ["k"]).collect())
    assert got == [(1, 5, "b", 5, 10**12), (1, 10**12 - 1, "c", 5, 10**12), (1, 10**12 + 8, "e", 10**12 + 5, 10**12 + 9), (2, 2, None, 0, 3)]


def test_tasks_of_a_scan_grow_with_its_rows(spark):
    from pyspark.sql import functions as F

    from molspan.operators import recall

    seen = spark.range(96).select(F.lit(1).alias("read_id"), F.col("id").alias("pos"), F.lit(0.5).alias("step"), (F.col("id") % 3 == 0).cast("int").alias("hit"), F.lit(1).alias("opp"))
    spaces = spark.createDataFrame([(1, 0, 40), (1, 30, 96)], "read_id int, a long, b long")
    assert [recall.parts_for(seen, n) for n in (10, 96, 97)] == [10, 1, 1]
    found = recall.scan_within(seen, spaces, ["read_id"], parts=7, min_llr=1.0)
    assert found._jdf.queryExecution().toString().count("RepartitionByExpression") + found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 3
    plain = recall.scan_within(seen, spaces, ["read_id"], min_llr=1.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []


def test_the_funnel_lays_out_no_base(spark, tmp_path):
    from pyspark.sql import functions as F

    from molspan.operators import controls
    from molspan.plans import molecules

    # order 8 has a null and lines that add no base, 9 none but such; 10 has no lines, 11 no order
    lines = [(r, k * 3 + r, k, float((r * 17 + k * 23) % 51)) for r in range(1, 8) for k in range(1, 2 + r)] + [(8, 1, 1, None), (8, 2, 2, 40.0), (8, 5, 2, 120.0), (9, 2, 1, 50.0), (11, 0, 1, 7.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(r, r + 1, "F" if r % 2 else "O") for r in range(1, 11)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    whole = molecules.molecules(spark, str(tmp_path))
    length = {r.read_id: len(r.seq) for r in whole.collect()}
    assert length == {r.read_id: r.read_length for r in molecules.lengths(spark, str(tmp_path)).collect()} and (length[8], length[9]) == (120, 0) and len(length) == 9
    # reasons by length are those by sequence
    more = {"flag": F.lit(0), "mapq": F.lit(60)}
    rows = controls.funnel(whole.withColumns(more), min_length=100)
    light = rows.withColumn("read_length", F.length("seq")).drop("seq", "reason")
    assert sorted(map(tuple, controls.funnel(light, min_length=100).select("read_id", "reason").collect())) == sorted(map(tuple, rows.select("read_id", "reason").collect()))
    assert {r.reason for r in rows.collect()} == {"no_sequence", "short", "processed"}
    found = molecules.flt18(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "collect_list" not in plan
    assert sum(r.n for r in found.collect()) == 9

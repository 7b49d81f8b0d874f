from pyspark.sql import functions as F

from curbflow.functions.numbering import dense_numbers
from curbflow.operators import features


def test_numbers_follow_the_order_and_are_dense(spark):
    # a third of all rows are equal in every column; nulls come first
    rows = [(k % 7 if k % 10 else None, f"n{k % 3}") for k in range(4_000)] + [(3, "same")] * 2_000
    df = spark.createDataFrame(rows, "a int, b string").repartition(9)
    got = dense_numbers(df, ["a", "b"], "id").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, len(rows) + 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [(r.a, r.b) for r in got] == sorted(rows, key=key)


def test_equal_rows_are_dealt_to_several_ranges(spark):
    df = spark.range(60_000).select(F.lit(1).alias("a"))
    limit = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = dense_numbers(df, ["a"], "id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", limit)
    assert len([f for f in numbered.inputFiles() if "numbered-ranges" in f]) == 4
    stats = numbered.agg(F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(stats) == (60_000, 60_000, 1, 60_000)


def test_no_window_and_no_single_task_sees_the_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 10).alias("a"), "id")
    numbered = dense_numbers(df, ["a", "id"], "n")
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_clashing_names_and_empty_tables(spark):
    names = ["_file", "_row", "_range", "_start", "__file", "a b"]
    rows = [tuple(f"{n}{k % 3}" for n in names) for k in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    got = dense_numbers(df, ["a b", "_file"], "id")
    assert got.columns == [*names, "id"]
    assert sorted(tuple(r)[:-1] for r in got.collect()) == sorted(rows)
    assert sorted(r.id for r in got.collect()) == list(range(1, 51))
    assert dense_numbers(df.limit(0), ["_file"], "id").count() == 0


def test_trips_without_source_id_get_their_own_ids(spark, chain):
    trips = features.dwd_trips(chain.features.drop("source_trip_id"))
    twice = trips.unionByName(trips)  # every trip repeats: the hash is no key
    assert twice.select("trip_id").distinct().count() < twice.count()
    numbered = features.numbered_trips(twice)
    assert numbered.columns == twice.columns
    n = twice.count()
    assert sorted(r.trip_id for r in numbered.select("trip_id").collect()) == list(range(1, n + 1))
    times = [r.pickup_datetime for r in numbered.orderBy("trip_id").collect()]
    assert times == sorted(times)

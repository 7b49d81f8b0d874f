import os

import pytest
from pyspark.sql import functions as F

from curbflow.operators import timeseries
from curbflow.sinks import upsert, warehouse, writers
from curbflow.sources import readers

KEYS = ["day", "zone"]


def table(spark, rows):
    return spark.createDataFrame(rows, "day string, zone int, n int")


def content(spark, path):
    return sorted(
        (tuple(r) for r in spark.read.parquet(path).select("day", "zone", "n").collect()), key=str
    )


def files(path):
    return {
        os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns
        for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_changed_new_and_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert(table(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("b", None, 4)]),
                  path, KEYS, ["day"])
    untouched = {f: t for f, t in files(path).items() if "day=a" in f}
    late = [("b", 1, 30), ("b", None, 40), ("b", 7, 5), ("c", 1, 6)]
    for _ in range(2):  # a rerun gives the same table
        upsert.upsert(table(spark, late), path, KEYS, ["day"])
        assert content(spark, path) == sorted([("a", 1, 1), ("a", 2, 2), *late], key=str)
    assert untouched.items() <= files(path).items()


def test_a_broken_grain_leaves_the_table_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert(table(spark, [("a", 1, 1)]), path, KEYS, ["day"])
    before, stamps = content(spark, path), files(path)
    with pytest.raises(upsert.BrokenGrain):
        upsert.upsert(table(spark, [("a", 2, 1), ("a", 2, 5)]), path, KEYS, ["day"])
    assert content(spark, path) == before and files(path) == stamps
    with pytest.raises(ValueError):
        upsert.upsert(table(spark, [("a", 2, 1)]), path, ["zone"], ["day"])
    # a table that was broken by other means is found out, too
    writers.write_partitioned(table(spark, [("a", 1, 1), ("a", 1, 2)]), path, "day")
    with pytest.raises(upsert.BrokenGrain):
        upsert.upsert(table(spark, [("a", 9, 1)]), path, KEYS, ["day"])


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"d{k}", z, k) for k in range(6) for z in range(50)]
    upsert.upsert(table(spark, rows), path, KEYS, ["day"])
    for f in files(path):
        if "day=d5" not in f:  # unreadable: the upsert must not open it
            with open(f, "r+b") as file:
                file.write(b"xxxx")
                file.seek(-4, 2)
                file.write(b"xxxx")
            checksum = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            if os.path.exists(checksum):
                os.remove(checksum)
    upsert.upsert(table(spark, [("d5", 1, 99)]), path, KEYS, ["day"])
    day = spark.read.parquet(f"{path}/day=d5")
    assert day.count() == 50 and day.where("n = 99").count() == 1


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bucketed_panel_needs_no_exchange(spark, chain, tmp_path):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = warehouse.create_bucketed(
            chain.panel, "curbflow_test_panel", str(tmp_path / "p"), ["zone_id"], 4,
            ["zone_id", "trip_date", "hour"],
        )
        totals = warehouse.create_bucketed(
            panel.groupBy("zone_id").agg(F.sum("order_count").alias("total")),
            "curbflow_test_totals", str(tmp_path / "q"), ["zone_id"], 4,
        )
        for plan in (
            final_plan(timeseries.demand_lags(panel, ("lag_1", "lag_24", "lag_7_day"))),
            final_plan(panel.join(totals, "zone_id")),
            final_plan(panel.groupBy("zone_id").agg(F.max("hour"))),
        ):
            assert "Exchange" not in plan and "Bucketed: true" in plan
        lags = timeseries.demand_lags(chain.panel, ("lag_1", "lag_24", "lag_7_day"))
        assert "Exchange" in final_plan(lags)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE IF EXISTS curbflow_test_panel")
        spark.sql("DROP TABLE IF EXISTS curbflow_test_totals")


def test_calendar_prunes_partitions_while_running(spark, tmp_path):
    trips, months = str(tmp_path / "trips"), str(tmp_path / "months")
    month = F.format_string("2024-%02d", F.col("id") % 12 + 1)
    rows = spark.range(1200).select("id", month.alias("pickup_month"))
    writers.write_partitioned(rows, trips, "pickup_month")
    calendar = [(f"2024-{m:02d}", m in (3, 4)) for m in range(1, 13)]
    spark.createDataFrame(calendar, "pickup_month string, policy boolean").write.parquet(months)
    sliced = readers.calendar_slice(
        spark.read.parquet(trips), spark.read.parquet(months).where("policy")
    )
    plan = final_plan(sliced)
    assert "dynamicpruning" in plan
    assert sliced.count() == 200
    assert {r.pickup_month for r in sliced.collect()} == {"2024-03", "2024-04"}

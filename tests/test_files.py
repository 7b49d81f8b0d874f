import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from curbflow.operators import cleaning
from curbflow.operators.forecast import BoostSettings, ForestSettings
from curbflow.plans.pipeline import run_pipeline
from curbflow.session import materialize, scratch_path, shared_dir
from curbflow.sinks import warehouse, writers
from curbflow.sources import adapters, inventory, readers, sampling


def test_smallest_hashes_against_brute_force(spark):
    # one group holds two thirds of the rows
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5))
        .alias("g"),
    )
    got = sampling.smallest_hashes(df, F.col("g"), ["id"], 500, 42).drop("_hash")
    assert got.columns == ["id", "g"]
    picked = {}
    for r in got.collect():
        picked.setdefault(r.g, set()).add(r.id)
    groups = {}
    for r in df.collect():
        digest = hashlib.md5(f"{r.id}|42".encode()).hexdigest()
        groups.setdefault(r.g, []).append((digest, r.id))
    assert picked == {g: {i for _, i in sorted(rows)[:500]} for g, rows in groups.items()}


def test_samples_never_shuffle_unchosen_payload(spark):
    """Exchanges carry counts, or rows that already passed the hash bound."""
    trips = adapters.table(spark, SMALL, "events")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for sample in (
            sampling.uniform_sample(trips, ["event_id"], 20),
            sampling.time_spread_sample(trips, ["event_id"], 24),
        ):
            sample.collect()
            plan = sample._jdf.queryExecution().executedPlan().toString()
            final = plan.split("== Initial Plan ==")[0]
            assert "SortMergeJoin" not in final
            payload = [x for x in final.split("Exchange ") if "user_id" in x]
            assert payload and all("md5(" in x for x in payload[-1:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ten_thousand_groups(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 10_007).alias("g"))
    got = sampling.smallest_hashes(df, F.col("g"), ["id"], 2, 7).drop("_hash").collect()
    best = {}
    for i in range(60_000):
        best.setdefault(i % 10_007, []).append((hashlib.md5(f"{i}|7".encode()).hexdigest(), i))
    assert {(r.g, r.id) for r in got} == {
        (g, i) for g, rows in best.items() for _, i in sorted(rows)[:2]
    }
    assert len(got) == 2 * 10_007


def test_more_groups_than_are_sent(spark, monkeypatch):
    df = spark.range(3_000).select("id", (F.col("id") % 50).alias("g"))
    sent = sampling.smallest_hashes(df, F.col("g"), ["id"], 3, 1).drop("_hash").collect()
    monkeypatch.setattr(sampling, "SENT_GROUPS", 10)
    merged = sampling.smallest_hashes(df, F.col("g"), ["id"], 3, 1).drop("_hash").collect()
    assert sorted(sent) == sorted(merged) and len(sent) == 150


def test_uniform_sample_size(spark):
    df = spark.range(5000)
    assert sampling.uniform_sample(df, ["id"], 777).count() == 777
    assert sampling.uniform_sample(df, ["id"], 9999).count() == 5000
    first = sampling.uniform_sample(df, ["id"], 50).collect()
    assert sorted(first) == sorted(sampling.uniform_sample(df, ["id"], 50).collect())


def test_time_spread_sample_covers_every_slice(spark):
    events = adapters.table(spark, SMALL, "events")
    picked = sampling.time_spread_sample(events, ["event_id"], 120)
    ids = sorted(r.event_id for r in picked.collect())
    assert len(ids) == 120
    # 1,000 rows in file order, ten from each twelfth
    assert [sum(k * 1000 <= i * 12 < (k + 1) * 1000 for i in ids) for k in range(12)] == [10] * 12


def test_inventory_and_schema_report(spark):
    row = inventory.file_inventory(spark, f"{SMALL}/nation.parquet").first()
    assert (row.file, row.rows) == ("nation.parquet", 25) and row.size_mb >= 0
    tables = [f"{SMALL}/{name}.parquet" for name in ("nation", "region")]
    report = inventory.schema_report(spark, tables)
    assert {(r.file, r.column, r.type) for r in report.collect()} >= {
        ("nation.parquet", "n_name", "string"), ("region.parquet", "r_regionkey", "int"),
    }
    assert inventory.schema_drift(report).where("column = 'n_name'").first().file_count == 1


def test_months_with_drifting_types_stack(spark, tmp_path):
    months = {
        "2024-11": "SELECT 1 AS PULocationID, 2.5D AS fare, DATE '2024-11-02' AS at, NULL AS fee",
        "2024-12": "SELECT 2L AS PULocationID, 7L AS fare, TIMESTAMP_NTZ '2024-12-01 03:00:00' "
        "AS at",
        "2025-01": "SELECT 3D AS PULocationID, 1.5 AS fare, 'x' AS extra, 4 AS FEE",
        "2025-02": "SELECT 9 AS PULocationID, 9.0D AS fare",
    }
    for month, sql in months.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"fhvhv/fhvhv_tripdata_{month}.parquet"))
    paths = [str(tmp_path / f"fhvhv/fhvhv_tripdata_{m}.parquet") for m in months]
    got = readers.read_trips(spark, paths, ["2024-11", "2024-12", "2025-01"])
    assert dict(got.dtypes) == {
        "PULocationID": "double", "fare": "double", "at": "timestamp_ntz", "fee": "int",
        "extra": "string",
    }
    assert sorted((r.PULocationID, r.fare, r.extra, r.fee) for r in got.collect()) == [
        (1, 2.5, None, None), (2, 7, None, None), (3, 1.5, "x", 4),
    ]
    plan = got.select("fare")._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan
    with pytest.raises(FileNotFoundError):
        readers.read_trips(spark, paths, ["2030-01"])


def test_partition_overwrite_keeps_other_months(spark, tmp_path):
    path = str(tmp_path / "months")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "m string, x int")
    writers.write_partitioned(df, path, "m")
    writers.write_partitioned(spark.createDataFrame([("b", 9)], "m string, x int"), path, "m")
    back = spark.read.parquet(path)
    assert {(r.m, r.x) for r in back.collect()} == {("a", 1), ("b", 9)}
    plan = readers.month_slice(back, ["a"], "m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(m" in plan or "PartitionFilters: [(m" in plan


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("区", {"a": 1.5}, None)], "name string, evidence map<string,double>, gone string"
    )
    writers.write_csv(df, str(tmp_path / "c"), single_file=True)
    row = spark.read.csv(str(tmp_path / "c"), header=True, escape="\\").first()
    assert row.name == "区" and '"a":1.5' in row.evidence
    writers.write_json(df, str(tmp_path / "j"), single_file=True)
    text = spark.read.text(str(tmp_path / "j")).first().value
    assert '"gone":null' in text and "区" in text


def test_jdbc_options_replace_in_batches():
    options = writers.jdbc_options("jdbc:x", "mobility.t", user="u")
    assert options["batchsize"] == "10000" and options["truncate"] == "true"
    assert options["dbtable"] == "mobility.t" and options["user"] == "u"


def test_external_table_with_partitions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("2025-01", 1.0)], "pickup_month string, fare double")
    writers.write_partitioned(df, warehouse.table_path(root, "dwd_clean_trips"), "pickup_month")
    names = warehouse.register_layer(
        spark, root, {"dwd_clean_trips": "fare double, pickup_month string"}, prefix="unit_"
    )
    assert spark.table(names[0]).first().fare == 1.0
    spark.sql(f"DROP TABLE {names[0]}")
    assert spark.read.parquet(warehouse.table_path(root, "dwd_clean_trips")).count() == 1


def test_readers(spark, tmp_path):
    folder = tmp_path / "fhvhv"
    df = spark.createDataFrame([(1, 2.0)], "PULocationID int, trip_miles double")
    for month in ("2024-11", "2024-12"):
        df.coalesce(1).write.parquet(str(folder / f"fhvhv_tripdata_{month}.parquet"))
    spark.createDataFrame([(3, 4.0, 1.5)], "PULocationID int, trip_miles double, cbd_congestion_fee double").write.parquet(
        str(folder / "fhvhv_tripdata_2025-01.parquet")
    )
    paths = [str(folder / f"fhvhv_tripdata_{m}.parquet") for m in ("2024-11", "2024-12", "2025-01")]
    both = readers.read_trips(spark, paths, ["2024-12", "2025-01"])
    assert {(r.PULocationID, r.cbd_congestion_fee) for r in both.collect()} == {(1, None), (3, 1.5)}
    with pytest.raises(FileNotFoundError):
        readers.read_trips(spark, paths, ["2031-01"])
    with pytest.raises(FileNotFoundError):
        readers.service_files(spark, str(tmp_path), "yellow")
    found = readers.list_files(spark, f"{folder}/fhvhv_tripdata_2024-1*.parquet/*.parquet", 1)
    assert len(found) == 1 and "2024-11" in found[0]

    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n265,N/A,Outside,N/A\n")
    zone = readers.read_zones(spark, str(tmp_path / "zones.csv")).first()
    assert (zone.zone_id, zone.borough, zone.zone_name) == (265, None, "Outside")

    empty = readers.read_first_existing(spark, [str(tmp_path / "no")], "a int")
    assert empty.count() == 0 and empty.columns == ["a"]
    assert readers.read_first_existing(
        spark, [str(tmp_path / "no"), paths[0]], "PULocationID int"
    ).count() == 1


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_insert_overwrite_keeps_other_partitions(spark):
    path = scratch_path(spark, "overwrite")
    spark.sql("DROP TABLE IF EXISTS curbflow_test_overwrite")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "m string, x int")
    warehouse.create_as_select(df, "curbflow_test_overwrite", path, ["m"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    warehouse.insert_overwrite(
        spark.createDataFrame([(9, "b"), (7, "c")], "x int, m string"), "curbflow_test_overwrite"
    )
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    rows = spark.table("curbflow_test_overwrite").collect()
    assert {(r.m, r.x) for r in rows} == {("a", 1), ("b", 9), ("c", 7)}
    spark.sql("DROP TABLE curbflow_test_overwrite")


def test_pipeline_writes_every_layer(spark, chain):
    root = scratch_path(spark, "pipeline")
    small = BoostSettings(rounds=2, max_depth=2)
    paths = run_pipeline(chain, root, small, small, ForestSettings(trees=3, max_depth=4))
    assert len(paths) >= 42
    catalogue = {r.result: r.available_rows for r in spark.read.parquet(paths["output_catalogue"]).collect()}
    profile = spark.read.parquet(paths["quality_profile"]).collect()
    assert {r.service: r.sample_rows for r in profile} == {
        "high_volume_fhv": chain.raw.count(), "yellow_taxi": chain.raw_taxi.count()
    }
    drops = spark.read.parquet(paths["data_quality_summary"]).first()
    assert (drops.raw_count, drops.valid_count) == (chain.raw.count(), chain.trips.count())
    ids = spark.read.parquet(paths["dwd_hvfhv_trip_clean"]).agg(
        F.count_distinct("trip_id"), F.max("trip_id")
    ).first()
    assert tuple(ids) == (chain.trips.count(),) * 2
    counts = {
        name: spark.read.parquet(paths[name]).count()
        for name in ("dwd_hvfhv_trip_clean", "dws_zone_hour_policy_panel", "policy_cards")
    }
    assert counts["dwd_hvfhv_trip_clean"] == chain.trips.count()
    assert counts["dws_zone_hour_policy_panel"] == chain.panel.count()
    assert counts["policy_cards"] >= 1
    models = spark.read.parquet(paths["model_metrics"]).collect()
    assert {r.model_name for r in models} == {"random_forest", "gradient_boosting"}
    assert spark.read.parquet(paths["best_model"]).first().rmse == min(r.rmse for r in models)
    assert spark.read.parquet(paths["demand_forecast"]).count() > 0

    # every table that the catalog knows and the pipeline writes has the rows it wrote
    written = [name for name in warehouse.TABLES if name in paths]
    assert {"dws_hourly_demand", "dws_zone_hourly_demand", "dwd_clean_trips"} <= set(written)
    for table in warehouse.register_written(spark, root, written):
        fmt = warehouse.TABLES[table][1]
        reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
        rows = reader.format(fmt).load(paths[table]).count()
        assert spark.table(table).count() == rows == catalogue[table] > 0
        spark.sql(f"DROP TABLE {table}")
    hourly = spark.read.csv(paths["dws_hourly_demand"], header=True)
    assert hourly.select("service_type").distinct().count() == 2


def test_small_readers(spark, tmp_path):
    path = str(tmp_path / "panel")
    spark.createDataFrame([("2025-01-05", 2), ("2025-01-04", 1), (None, 3)], "trip_date string, x int").write.parquet(path)
    panel = readers.read_panel(spark, path)
    assert dict(panel.dtypes)["trip_date"] == "date"
    assert [r.x for r in readers.first_rows(cleaning.prune_missing(panel, ["trip_date"]), ["x"], 1).collect()] == [1]


def test_materialize_keeps_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS INT) AS small", "id % 2 = 0 AS even")
    for rebalance in (True, False):
        stored = materialize(df, "unit", rebalance)
        assert stored.dtypes == df.dtypes and stored.count() == 10

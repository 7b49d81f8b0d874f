import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.operators import panels
from curbflow.sources import inventory, readers


@pytest.fixture(scope="module")
def hot_features(spark, chain):
    """The trips and, of one zone and hour, as many again as a third of all rows and more."""
    one = chain.features.where("pickup_location_id IS NOT NULL AND response_us IS NOT NULL").orderBy(
        "source_trip_id"
    ).limit(1)
    times = spark.range(30_000).select(((F.col("id") * 7_919_993) % 9_000_000_000).alias("us"))
    extra = one.drop("response_us").crossJoin(times).withColumnRenamed("us", "response_us")
    return chain.features.unionByName(extra.select(*chain.features.columns))


def expected(features, keys):
    groups = {}
    for r in features.select(*keys, "response_us").collect():
        groups.setdefault(tuple(r)[:-1], []).append(r.response_us)
    return {
        k: [x / 60_000_000 for x in v if x is not None] for k, v in groups.items()
    }


@pytest.mark.parametrize("which", ["zone", "od"])
def test_a_third_of_all_trips_in_one_key(spark, chain, hot_features, which):
    if which == "zone":
        panel = panels.zone_hour_panel(hot_features, chain.zones, chain.spec)
        keys, names = panels.HOUR_KEYS, ["zone_id", "trip_date", "hour"]
        probs, count = {"response_time_p50": 0.5, "response_time_p90": 0.9}, "order_count"
    else:
        panel = panels.od_hour_panel(hot_features, chain.zones, chain.spec)
        keys = panels.OD_KEYS
        names = ["pickup_location_id", "dropoff_location_id", "trip_date", "hour"]
        probs, count = {"response_time_p90": 0.9}, "od_order_count"
    plan = panel._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    want = expected(hot_features, keys)
    rows = panel.collect()
    assert len(rows) == len(want) and max(r[count] for r in rows) > 30_000
    for r in rows:
        values = want[tuple(r[n] for n in names)]
        for name, p in probs.items():
            assert r[name] == (pytest.approx(np.quantile(values, p)) if values else None)


def test_footers_of_drifting_files(spark, tmp_path):
    for k, sql in enumerate((
        "SELECT 1 AS id, 2.5D AS fare, DATE '2024-11-02' AS at, true AS flag, 'x' AS name",
        "SELECT 2L AS id, CAST(7 AS DECIMAL(9, 2)) AS fare, TIMESTAMP_NTZ '2024-12-01 03:00:00' AS at",
        "SELECT CAST(1 AS SMALLINT) AS id, 3F AS fare, TIMESTAMP '2024-12-01 03:00:00' AS at, "
        "named_struct('a', 1) AS parts",
    )):
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/m{k}")
    report = inventory.schema_report(spark, f"{tmp_path}/*/*.parquet")
    found = {}
    for r in report.collect():
        assert r.rows == 1
        found.setdefault(r.path.split("/")[-2], {})[r.column] = r.type
    for k in range(3):
        fields = spark.read.parquet(f"{tmp_path}/m{k}").schema
        assert found[f"m{k}"] == {
            f.name: "nested" if f.name == "parts" else f.dataType.simpleString() for f in fields
        }
    drift = {r.column: r.types for r in inventory.schema_drift(report).collect()}
    assert drift["id"] == ["bigint", "int", "smallint"] and {"flag", "parts"} <= set(drift)


def test_too_many_files_are_an_error(spark, tmp_path, monkeypatch):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "t"))
    pattern = str(tmp_path / "t" / "*.parquet")
    assert len(readers.list_files(spark, pattern)) == 3
    monkeypatch.setattr(readers, "MOST_FILES", 2)
    assert len(readers.list_files(spark, pattern, first=1)) == 1
    with pytest.raises(ValueError):
        readers.list_files(spark, pattern)

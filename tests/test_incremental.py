import os
import shutil

import pytest
from pyspark.sql import functions as F

from curbflow.operators import cleaning, incremental, marts
from curbflow.plans import registry
from curbflow.sources import readers


@pytest.fixture()
def raw(chain, tmp_path):
    root = str(tmp_path / "raw")
    registry._write_months(chain, root, (0, 1, 2))
    return root


def sources(root):
    return {
        cleaning.RIDE_HAILING: f"{root}/{readers.SERVICE_PATTERNS['fhvhv']}",
        cleaning.YELLOW: f"{root}/{readers.SERVICE_PATTERNS['yellow']}",
    }


def one_scan(spark, root, rules):
    parts = [
        cleaning.standard_trips(
            readers.read_trips(spark, readers.list_files(spark, pattern)), service, rules
        )
        for service, pattern in sources(root).items()
    ]
    return cleaning.union_services(*parts)


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def rows(df):
        return sorted(
            (tuple(round(x, 6) if isinstance(x, float) else x for x in r)
             for r in df.select(*columns).collect()),
            key=str,
        )

    assert rows(left) == rows(right)


def check(spark, chain, state, root):
    standard = one_scan(spark, root, chain.spec.rules)
    expected = {
        "hourly_demand": marts.hourly_demand(standard),
        "zone_hourly_demand": marts.zone_hourly_demand(standard, chain.zones),
        "od_flows": marts.od_flows(standard),
        "invalid_trip_summary": marts.invalid_reason_summary(standard),
    }
    for name, df in expected.items():
        same(incremental.mart(spark, state, name, chain.zones), df)


def files_of(root, month):
    return [
        os.path.join(folder, name)
        for folder, _, names in os.walk(root)
        for name in names
        if f"-{month}.parquet" in folder and name.endswith(".parquet")
    ]


def test_unchanged_files_are_not_opened(spark, chain, raw, tmp_path):
    state = str(tmp_path / "state")
    late = {f: f"{tmp_path}/late-{k}" for k, f in enumerate(files_of(raw, "03"))}
    for f, held in late.items():
        shutil.copy2(f, held)
        os.remove(f)
        checksum = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(checksum):
            os.remove(checksum)
    first = incremental.update(spark, state, sources(raw), chain.spec.rules)
    assert (first.read, first.kept, first.gone, first.version) == (4, 0, 0, 1)
    check(spark, chain, state, raw)
    nothing = incremental.update(spark, state, sources(raw), chain.spec.rules)
    assert nothing == incremental.Update(0, 4, 0, 1)

    sound = {}
    for f in files_of(raw, "01") + files_of(raw, "02"):  # same size and time, unreadable
        stat = os.stat(f)
        with open(f, "rb") as file:
            sound[f] = file.read()
        with open(f, "wb") as file:
            file.write(b"x" * stat.st_size)
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    for f, held in late.items():
        shutil.copy2(held, f)
    second = incremental.update(spark, state, sources(raw), chain.spec.rules)
    assert (second.read, second.kept, second.gone, second.version) == (2, 4, 0, 2)
    for f, data in sound.items():
        stat = os.stat(f)
        with open(f, "wb") as file:
            file.write(data)
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    check(spark, chain, state, raw)


def test_changed_and_deleted_files(spark, chain, raw, tmp_path):
    state = str(tmp_path / "state")
    incremental.update(spark, state, sources(raw), chain.spec.rules)
    changed = f"{raw}/fhvhv/fhvhv_tripdata_2024-02.parquet"
    half = spark.read.parquet(changed).limit(100).toPandas()
    shutil.rmtree(changed)
    spark.createDataFrame(half).write.parquet(changed)
    shutil.rmtree(f"{raw}/yellow/yellow_tripdata_2024-01.parquet")
    done = incremental.update(spark, state, sources(raw), chain.spec.rules)
    assert (done.kept, done.gone, done.version) == (4, 2, 2) and done.read >= 1
    check(spark, chain, state, raw)


def test_a_batch_without_manifest_does_not_count(spark, chain, raw, tmp_path):
    """An update that was lost before its manifest leaves partial sums that nothing names."""
    state = str(tmp_path / "state")
    incremental.update(spark, state, sources(raw), chain.spec.rules)
    batch = next(n for n in os.listdir(f"{state}/partials") if n.startswith("batch="))
    shutil.copytree(f"{state}/partials/{batch}", f"{state}/partials/batch=lost")
    check(spark, chain, state, raw)
    shutil.rmtree(f"{state}/manifest/version=1")
    assert incremental.manifest(spark, state).count() == 0
    redone = incremental.update(spark, state, sources(raw), chain.spec.rules)
    assert (redone.read, redone.version) == (6, 1)
    check(spark, chain, state, raw)


def test_partial_sums_come_from_one_scan(spark, chain, raw):
    path = readers.list_files(spark, sources(raw)[cleaning.YELLOW])[1:2]
    trips = cleaning.standard_trips(readers.read_trips(spark, path), cleaning.YELLOW)
    plan = incremental.partial_sums(trips)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def near(spark, chain, state, root):
    """Flows as from one scan; sums may be added in another order."""
    keys = list(incremental.KEYS["od_flows"])

    def rows(df):
        df = df.select(*keys, "trip_count", "distance_sum", "fare_sum")
        return sorted((tuple(r) for r in df.collect()), key=lambda r: str(r[:4]))

    left = rows(incremental.mart(spark, state, "od_flows"))
    right = rows(marts.od_flows(one_scan(spark, root, chain.spec.rules)))
    assert [r[:4] for r in left] == [r[:4] for r in right]
    assert [r[4:] for r in left] == [pytest.approx(r[4:]) for r in right]


def test_parts_of_a_month_share_their_partial_sums(spark, chain, tmp_path):
    """Sums by part file grew with the parts, up to a row for each trip."""
    root, state = str(tmp_path / "raw"), str(tmp_path / "state")
    registry._write_months(chain, root, (0, 1, 2))
    month = f"{root}/yellow/yellow_tripdata_2024-02.parquet"
    trips = spark.read.parquet(month).toPandas()
    shutil.rmtree(month)
    spark.createDataFrame(trips).repartition(9).write.parquet(month)
    incremental.update(spark, state, sources(root), chain.spec.rules)
    partials = spark.read.schema(incremental.PARTIALS).parquet(f"{state}/partials")
    keys = ["file", "batch", "mart", *incremental.ALL_KEYS]
    assert partials.count() == partials.select(*keys).distinct().count()
    mine = partials.where("file LIKE '%yellow_tripdata_2024-02.parquet' AND mart = 'od_flows'")
    assert mine.count() == mine.select(*incremental.KEYS["od_flows"]).distinct().count() > 0
    near(spark, chain, state, root)

    # A further part is read alone; with a part that goes, its month is read again.
    spark.createDataFrame(trips.head(50)).coalesce(1).write.mode("append").parquet(month)
    more = incremental.update(spark, state, sources(root), chain.spec.rules)
    assert (more.read, more.gone) == (1, 0)
    near(spark, chain, state, root)
    first = sorted(files_of(root, "02"))
    gone = next(f for f in first if "yellow" in f)
    os.remove(gone)
    checksum = os.path.join(os.path.dirname(gone), f".{os.path.basename(gone)}.crc")
    if os.path.exists(checksum):
        os.remove(checksum)
    less = incremental.update(spark, state, sources(root), chain.spec.rules)
    assert less.version == 3 and less.gone >= 1
    near(spark, chain, state, root)


def test_states_with_sums_by_part_file_still_count(spark, chain, raw, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    with monkeypatch.context() as before:
        before.setattr(incremental, "_month_file", lambda file: F.concat(file))
        incremental.update(spark, state, sources(raw), chain.spec.rules)
    near(spark, chain, state, raw)

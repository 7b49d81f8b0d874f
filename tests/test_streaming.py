import pytest
from pyspark.sql import functions as F

from curbflow.operators import cleaning, features, panels
from curbflow.streaming import hourly

KEYS = ["zone_id", "trip_date", "hour"]
SHARED = ["order_count", "valid_response_count", "airport_trip_count", "avg_trip_miles",
          "avg_trip_time", "avg_base_fare", "avg_driver_pay", "avg_tolls",
          "avg_response_time_min", "slow_response_rate"]


class Feed:
    def __init__(self, spark, chain, root):
        self.spark, self.chain, self.root = spark, chain, root

    def add(self, trips):
        trips.coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, at_once=1):
        raw = hourly.trip_stream(self.spark, f"{self.root}/in", self.chain.raw.schema, at_once)
        hours = hourly.hourly_panel(raw, self.chain.zones, self.chain.spec)
        query = hourly.write_hours(hours, f"{self.root}/out", f"{self.root}/checkpoint")
        query.awaitTermination()
        return query

    def rows(self):
        return hourly.panel_means(self.spark.read.parquet(f"{self.root}/out"))


@pytest.fixture()
def feed(spark, chain, tmp_path):
    return Feed(spark, chain, str(tmp_path))


def days(chain, low, high):
    day = F.dayofmonth("pickup_datetime")
    return chain.raw.where((day > low) & (day <= high))


def batch(chain, raw):
    trips = cleaning.policy_trips(raw, cleaning.RIDE_HAILING, chain.spec.rules)
    table = features.policy_features(trips, chain.zones, chain.spec)
    return panels.zone_hour_panel(table, chain.zones, chain.spec), trips


def closed(panel, trips, delay="1 day"):
    last = trips.agg(F.max("pickup_datetime")).first()[0]
    end = "timestampadd(HOUR, hour + 1, CAST(trip_date AS TIMESTAMP_NTZ))"
    return panel.where(f"{end} <= TIMESTAMP_NTZ '{last}' - INTERVAL {delay}")


def values(df):
    return sorted(
        tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        for r in df.select(*KEYS, *SHARED).collect()
    )


def test_closed_hours_equal_the_batch_panel_across_a_restart(feed, chain):
    feed.add(days(chain, 0, 9))
    feed.run()
    first = feed.rows().count()
    feed.add(days(chain, 9, 16))
    feed.add(days(chain, 16, 31))
    feed.run()
    panel, trips = batch(chain, chain.raw)
    assert values(feed.rows()) == values(closed(panel, trips))
    assert 0 < first < feed.rows().count()
    hours = feed.spark.read.parquet(f"{feed.root}/out")
    assert hours.count() == hours.select(*KEYS).distinct().count()  # no hour is written twice


def test_a_run_without_new_files_changes_nothing(feed, chain):
    feed.add(days(chain, 0, 20))
    feed.run()
    before = values(feed.rows())
    feed.run()
    assert values(feed.rows()) == before


def test_late_trips_are_left_out_and_counted(feed, chain):
    feed.add(days(chain, 0, 20))
    feed.run()
    before = values(feed.rows())
    late = days(chain, 4, 6)
    feed.add(late)
    query = feed.run()
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
    assert dropped > 0  # partial sums of zones and hours
    assert values(feed.rows()) == before
    feed.add(days(chain, 20, 31))  # trips in time still count
    feed.run()
    panel, trips = batch(chain, chain.raw)
    assert values(feed.rows()) == values(closed(panel, trips))


def test_hours_within_the_delay_wait_for_more_trips(feed, chain):
    """A trip that is late, but not later than the delay, is counted."""
    whole = days(chain, 0, 10)
    late = "event_id % 7 = 0" if "event_id" in whole.columns else "source_trip_id % 7 = 0"
    at = F.col("pickup_datetime") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    feed.add(whole.where(~(F.expr(late) & at)))
    feed.run()
    feed.add(whole.where(F.expr(late) & at))
    feed.add(days(chain, 10, 31))
    feed.run()
    panel, trips = batch(chain, chain.raw)
    assert values(feed.rows()) == values(closed(panel, trips))

"""Small datasets behind the report figures, the dashboard and the summary texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import label_map


def daily_totals(time_metrics: DataFrame) -> DataFrame:
    return time_metrics.groupBy("date").agg(F.sum("order_count").alias("order_count"))


def hourly_totals(time_metrics: DataFrame) -> DataFrame:
    return time_metrics.groupBy("hour").agg(F.sum("order_count").alias("order_count"))


def weekday_totals(time_metrics: DataFrame) -> DataFrame:
    """All seven weekdays, 0 where a day has no trip."""
    days = time_metrics.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    totals = time_metrics.groupBy("weekday").agg(F.sum("order_count").alias("order_count"))
    names = F.array(*[F.lit(x) for x in L.WEEKDAY_LABELS])
    return days.join(totals, "weekday", "left").select(
        "weekday",
        F.element_at(names, F.col("weekday") + 1).alias("weekday_label"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
    )


def price_group_means(price: DataFrame, response: DataFrame) -> DataFrame:
    """Means of group means: fare by distance, pay by hour group, response by hour."""

    def series(df, key, measure, name):
        return df.groupBy(F.col(key).cast("string").alias("segment")).agg(
            F.avg(measure).alias("mean_value")
        ).select(F.lit(name).alias("series"), "segment", "mean_value")

    return (
        series(price, "trip_distance_group", "avg_fare_per_mile", "fare_per_mile")
        .unionByName(
            series(price, "hour_group", "avg_driver_pay_per_minute", "driver_pay_per_minute")
        )
        .unionByName(series(response, "hour", "avg_response_time_min", "response_time"))
    )


def with_route_label(routes: DataFrame, start: str, end: str, arrow: str = " → ") -> DataFrame:
    return routes.withColumn("route", F.concat(F.col(start), F.lit(arrow), F.col(end)))


def executive_kpis(cells: DataFrame) -> DataFrame:
    """Totals, weighted averages, peak hour and weekday, busiest borough in one row.

    ``cells`` is the demand by hour, weekday and borough (``marts.calendar_demand``);
    grouping sets over it give every total, so the trips are read once.
    """
    sums = ["trip_count", "fare_sum", "distance_sum", "duration_sum"]
    keys = ["pickup_hour", "pickup_weekday", "pickup_borough"]
    totals = cells.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(
        F.grouping_id().alias("level"), *[F.sum(name).alias(name) for name in sums]
    )
    # grouping_id: 3 = by hour, 5 = by weekday, 6 = by borough, 7 = grand total
    whole = F.max(F.when(F.col("level") == 7, F.col("trip_count")))

    def mean(name):
        return F.max(F.when(F.col("level") == 7, F.col(name))) / whole

    def peak(key, level):
        # most trips, then the smaller key
        rank = F.when(
            (F.col("level") == level) & F.col(key).isNotNull(),
            F.struct(-F.col("trip_count"), F.col(key)),
        )
        return F.min_by(key, rank)

    return totals.agg(
        whole.alias("total_trips"),
        mean("fare_sum").alias("avg_fare"),
        mean("distance_sum").alias("avg_distance"),
        mean("duration_sum").alias("avg_duration"),
        peak("pickup_hour", 3).alias("peak_hour"),
        peak("pickup_weekday", 5).alias("peak_weekday"),
        peak("pickup_borough", 6).alias("top_borough"),
    )


def executive_top_zones(zone_hourly: DataFrame, k: int = 10) -> DataFrame:
    return (
        zone_hourly.groupBy("pickup_borough", "pickup_zone")
        .agg(F.sum("trip_count").alias("trip_count"))
        .orderBy(
            F.col("trip_count").desc(),
            F.col("pickup_borough").asc_nulls_first(),
            F.col("pickup_zone").asc_nulls_first(),
        )
        .limit(k)
    )


def zone_group_response(panel: DataFrame) -> DataFrame:
    """Mean p90 per zone group and period, only groups with a measured response."""
    period = F.when(F.col("post_policy"), L.POST).otherwise(L.PRE)
    return (
        panel.groupBy("zone_group", "post_policy")
        .agg(
            F.avg("response_time_p90").alias("response_time_p90"),
            F.sum("valid_response_count").alias("valid_response_count"),
        )
        .where(F.col("valid_response_count") > 0)
        .select(
            label_map("zone_group", L.ZONE_GROUP_LABELS).alias("zone_group"),
            period.alias("policy_period"), "response_time_p90", "valid_response_count",
        )
    )


def demand_gap_ranking(predictions: DataFrame, k: int = 15) -> DataFrame:
    return (
        predictions.dropna(subset=["zone_id", "zone_name"])
        .groupBy("zone_id", "zone_name")
        .agg(
            F.avg("demand_gap").alias("mean_demand_gap"),
            F.avg("demand_gap_rate").alias("mean_demand_gap_rate"),
            F.sum("actual_order_count").alias("actual_orders"),
        )
        .orderBy(F.col("mean_demand_gap").desc_nulls_last(), "zone_id")
        .limit(k)
    )


def actual_vs_predicted(
    predictions: DataFrame, predicted: str = "predicted_counterfactual_order_count"
) -> DataFrame:
    """Daily totals of the actual and the predicted orders."""
    return predictions.groupBy("date").agg(
        F.sum(F.col("actual_order_count").cast("double")).alias("actual_order_count"),
        F.sum(predicted).alias(predicted),
    )


def actual_vs_predicted_long(
    predictions: DataFrame, predicted: str = "predicted_counterfactual_order_count"
) -> DataFrame:
    return actual_vs_predicted(predictions, predicted).unpivot(
        "date", ["actual_order_count", predicted], "series", "orders"
    )


def pay_change_histogram(pressure: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins of the pay change; missing and non-finite values removed."""
    change = F.col("driver_pay_per_minute_change_rate")
    values = pressure.select(change.alias("v")).where(
        change.isNotNull() & ~F.isnan(change) & (F.abs(change) != float("inf"))
    )
    limits = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    # a constant column gets a unit range around its value
    pad = F.when(F.col("r.lo") == F.col("r.hi"), 0.5).otherwise(0.0)
    ranged = (
        values.withColumn("r", limits)
        .select("v", (F.col("r.lo") - pad).alias("low"), (F.col("r.hi") + pad).alias("high"))
        .select("v", "low", ((F.col("high") - F.col("low")) / bins).alias("width"))
    )
    place = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1))
    return (
        ranged.groupBy(place.cast("int").alias("bin"), "low", "width")
        .agg(F.count(F.lit(1)).alias("routes"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "routes",
        )
    )


def worst_response(response: DataFrame) -> DataFrame:
    """Zone-hour with the highest p90 response."""
    return response.orderBy(
        F.col("p90_response_time_min").desc_nulls_last(),
        F.col("pickup_zone").asc_nulls_first(), "hour",
    ).limit(1)


def report_scalars(
    drops: DataFrame, pickup: DataFrame, routes: DataFrame, response: DataFrame,
    windows: DataFrame,
) -> DataFrame:
    """One row of headline values, each source an independent scalar subquery."""
    top_zone = pickup.orderBy(
        F.col("pickup_order_count").desc(), F.col("pickup_zone").asc_nulls_first()
    ).limit(1)
    ends = ["pickup_zone", "dropoff_zone", "pickup_borough", "dropoff_borough"]
    top_route = with_route_label(
        routes.orderBy(
            F.col("order_count").desc(), *[F.col(c).asc_nulls_first() for c in ends]
        ).limit(1),
        "pickup_zone", "dropoff_zone",
    )

    def first(df, *columns):
        return df.select(F.struct(*columns).alias("row")).scalar()

    return drops.select(
        "raw_count", "valid_count", "drop_rate",
        first(top_zone, "pickup_zone", "pickup_order_count").alias("_zone"),
        first(top_route, "route", "order_count").alias("_route"),
        first(worst_response(response), "pickup_zone", "hour", "p90_response_time_min").alias(
            "_slow"
        ),
        windows.agg(F.count_if("supply_reallocation_signal").alias("n"))
        .scalar()
        .alias("reallocation_signals"),
    ).selectExpr(
        "raw_count", "valid_count", "drop_rate", "_zone.pickup_zone AS top_pickup_zone",
        "_zone.pickup_order_count AS top_pickup_orders", "_route.route AS top_route",
        "_route.order_count AS top_route_orders", "_slow.pickup_zone AS slowest_zone",
        "_slow.hour AS slowest_hour", "_slow.p90_response_time_min AS slowest_p90",
        "reallocation_signals",
    )


def report_estimates(effects: DataFrame, models: DataFrame) -> DataFrame:
    """The estimates a report quotes: one row per difference-in-differences metric, and the
    best model with its error."""
    best = models.orderBy("rmse", "model_name").limit(1)
    return effects.select(
        F.lit("did").alias("section"),
        F.col("metric_name").alias("name"),
        F.col("coef_treated_post").alias("value"),
        F.col("p_value"),
    ).unionByName(
        best.select(
            F.lit("model").alias("section"),
            F.col("model_name").alias("name"),
            F.col("rmse").alias("value"),
            F.lit(None).cast("double").alias("p_value"),
        )
    )


def active_incentives(pricing: DataFrame, k: int = 20) -> DataFrame:
    """First routes whose price rose while pay did not."""
    return (
        pricing.where("subsidy_signal")
        .orderBy(
            F.col("demand_change").desc(), "pickup_zone_name", "dropoff_zone_name",
            "is_airport_trip", "is_cross_treated_trip",
        )
        .limit(k)
        .select(
            "pickup_zone_name", "dropoff_zone_name", "fare_per_mile_change",
            "driver_pay_per_minute_change", "trip_count_post",
        )
    )


def fare_change_scatter(pricing: DataFrame, k: int = 20) -> DataFrame:
    """Routes with the largest fare increase and a bubble size of at least one trip."""
    return (
        pricing.orderBy(
            F.col("fare_per_mile_change").desc(), "pickup_zone_name", "dropoff_zone_name",
            "is_airport_trip", "is_cross_treated_trip",
        )
        .limit(k)
        .select(
            "pickup_zone_name", "dropoff_zone_name", "fare_per_mile_change",
            "driver_pay_per_minute_change",
            F.greatest("trip_count_post", F.lit(1)).alias("bubble_size"),
        )
    )


def event_series(events: DataFrame, metric: str) -> DataFrame:
    return events.where(F.col("metric_name") == metric).orderBy("event_week")


def headline_counts(panel: DataFrame) -> DataFrame:
    """Covered zones, date range and order total of the panel."""
    return panel.agg(
        F.count_distinct("zone_id").alias("zones"),
        F.min("trip_date").alias("first_date"),
        F.max("trip_date").alias("last_date"),
        F.sum("order_count").alias("orders"),
    )


def output_catalogue(results: Mapping[str, DataFrame]) -> DataFrame:
    """One row per result table with its number of rows."""
    catalogue = None
    for name, df in results.items():
        row = df.agg(F.lit(name).alias("result"), F.count(F.lit(1)).alias("available_rows"))
        catalogue = row if catalogue is None else catalogue.unionByName(row)
    return catalogue


def display_rate(value: str, digits: int = 1):
    """Percent text with a placeholder for missing values."""
    shown = F.format_string(f"%.{digits}f%%", F.col(value) * 100)
    return F.when(F.col(value).isNull(), "暂无可用结果").otherwise(shown)


def display_number(value: str, digits: int = 2):
    shown = F.format_string(f"%.{digits}f", F.col(value).cast("double"))
    return F.when(F.col(value).isNull(), "暂无可用结果").otherwise(shown)


def display_count(value: str):
    """Integer text with thousands separators."""
    return F.format_number(F.col(value).cast("bigint"), 0)


def kpi_text(kpis: DataFrame) -> DataFrame:
    """Executive numbers in display form."""
    return kpis.select(
        display_count("total_trips").alias("total_trips"),
        F.concat(F.lit("$"), F.format_number("avg_fare", 2)).alias("avg_fare"),
        F.format_number("avg_distance", 2).alias("avg_distance"),
        F.format_number("avg_duration", 1).alias("avg_duration"),
        "top_borough",
    )

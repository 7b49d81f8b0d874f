"""Before/after comparisons: one conditional aggregation per table, no self-join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import (
    MICROS_PER_MINUTE,
    cut,
    is_true,
    label_map,
    null_safe_join,
    rate_change,
    zero,
)
from curbflow.functions.quantiles import exact_quantiles
from curbflow.functions.scores import BOUNDS, floored_minmax, with_bounds
from curbflow.spec import PolicySpec

PERIODS = (("pre", False), ("post", True))


def pre_post(
    df: DataFrame,
    keys: Sequence[str],
    means: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    counts: Sequence[str] = (),
    quantiles: Mapping[str, float] | None = None,
) -> DataFrame:
    """Wide table with ``<measure>_pre`` and ``<measure>_post`` per key, 0 where absent.

    ``counts`` names row counts; ``quantiles`` are exact quantiles of
    ``response_us`` in minutes. Keys keep their NULLs.
    """
    keys = list(keys)
    aggregates, fills = [], {}
    for period, flag in PERIODS:
        inside = F.col("post_policy") == flag
        for name in counts:
            aggregates.append(F.count_if(inside).alias(f"{name}_{period}"))
        for name, source in (sums or {}).items():
            aggregates.append(
                F.coalesce(F.sum(F.when(inside, F.col(source))), F.lit(0)).alias(
                    f"{name}_{period}"
                )
            )
        for name, source in (means or {}).items():
            value = F.when(inside, F.col(source).cast("double"))
            aggregates.append(zero(F.avg(value)).alias(f"{name}_{period}"))
    if quantiles:
        # The row count is only a carrier when no other measure is asked for.
        aggregates = aggregates or [F.count(F.lit(1)).alias("_rows")]
    wide = df.groupBy(*keys).agg(*aggregates)
    if not quantiles:
        return wide
    long = exact_quantiles(
        df, [*keys, "post_policy"], "response_us", quantiles, scale=MICROS_PER_MINUTE
    )
    spread = long.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("post_policy") == flag, F.col(name))).alias(f"{name}_{period}")
            for period, flag in PERIODS
            for name in quantiles
        ]
    )
    fills = {f"{n}_{p}": zero(f"{n}_{p}") for p, _ in PERIODS for n in quantiles}
    return null_safe_join(wide, spread, keys).withColumns(fills).drop("_rows")


def demand_shift(features: DataFrame) -> DataFrame:
    """Orders by pickup zone group before and after the policy."""
    wide = pre_post(features, ["pickup_zone_group"], counts=["order_count"])
    return wide.withColumnRenamed("pickup_zone_group", "zone_group").withColumns(
        {
            "absolute_change": F.col("order_count_post") - F.col("order_count_pre"),
            "change_rate": rate_change("order_count_post", "order_count_pre"),
            "business_interpretation": F.when(
                F.col("zone_group") == "spillover_zones", L.INTERPRET_SPILLOVER_SHIFT
            ).otherwise(L.INTERPRET_OTHER_SHIFT),
        }
    )


def daily_orders(features: DataFrame) -> DataFrame:
    return features.groupBy("trip_date", "post_policy").agg(
        F.count(F.lit(1)).alias("order_count")
    )


def _order_change(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pre_post(df, keys, counts=["order_count"]).withColumn(
        "change_rate", rate_change("order_count_post", "order_count_pre")
    )


def hourly_pattern(features: DataFrame) -> DataFrame:
    return _order_change(features.withColumnRenamed("trip_hour", "hour"), ["hour", "is_weekend"])


def time_window_pattern(features: DataFrame) -> DataFrame:
    windowed = features.withColumn("time_window", cut("trip_hour", L.REPORT_WINDOW_CUTS))
    return _order_change(windowed, ["time_window", "is_weekend"])


def hour_rollup(pattern: DataFrame) -> DataFrame:
    return pattern.groupBy("hour").agg(
        F.sum("order_count_pre").alias("order_count_pre"),
        F.sum("order_count_post").alias("order_count_post"),
    )


OD_CHANGE_KEYS = [
    "pickup_zone_name", "dropoff_zone_name", "is_airport_trip", "is_cross_treated_trip",
]


def od_flow_change(features: DataFrame) -> DataFrame:
    """Route-level change with a route type; sort or limit at the consumer."""
    wide = pre_post(
        features, OD_CHANGE_KEYS, counts=["orders"],
        means={"fare_per_mile": "fare_per_mile", "driver_pay_per_minute": "driver_pay_per_minute"},
    )
    return wide.withColumns(
        {
            "absolute_change": F.col("orders_post") - F.col("orders_pre"),
            "change_rate": rate_change("orders_post", "orders_pre"),
            "avg_fare_per_mile_change": F.col("fare_per_mile_post") - F.col("fare_per_mile_pre"),
            "avg_driver_pay_per_minute_change": F.col("driver_pay_per_minute_post")
            - F.col("driver_pay_per_minute_pre"),
        }
    ).withColumns(
        {
            "route_type": F.when(F.col("is_airport_trip"), "airport_od")
            .when(F.col("is_cross_treated_trip"), "cross_treated_od")
            .when(F.col("avg_driver_pay_per_minute_change") < 0, "driver_pressure_od")
            .otherwise("high_value_od"),
            "business_interpretation": F.lit(L.INTERPRET_OD),
        }
    )


def pricing_pressure(features: DataFrame) -> DataFrame:
    """Unit price and fee burden by distance segment, with a discount signal."""
    segmented = features.withColumn(
        "distance_segment", cut("trip_miles", L.DISTANCE_SEGMENT_CUTS)
    )
    wide = pre_post(
        segmented, ["distance_segment"], counts=["orders"],
        means={"fare_per_mile": "fare_per_mile", "policy_fee_burden": "policy_fee_burden_rate"},
    )
    return wide.withColumns(
        {
            "fare_per_mile_change_rate": rate_change("fare_per_mile_post", "fare_per_mile_pre"),
            "policy_fee_burden_change_rate": rate_change(
                "policy_fee_burden_post", "policy_fee_burden_pre"
            ),
        }
    ).withColumns(
        {
            "passenger_discount_signal": is_true(F.col("fare_per_mile_change_rate") > 0)
            & (F.col("orders_post") < F.col("orders_pre")),
            "business_interpretation": F.lit(L.INTERPRET_PRICE),
        }
    )


def driver_pressure(features: DataFrame) -> DataFrame:
    """Routes scored by rising tolls and falling pay, flagged above the 90 % quantile.

    The table has at most one row per zone pair and airport flag, which bounds the
    state of the exact quantile.
    """
    wide = pre_post(
        features, ["pickup_zone_name", "dropoff_zone_name", "is_airport_trip"],
        counts=["orders"],
        means={
            "driver_pay_per_minute": "driver_pay_per_minute",
            "tolls": "tolls",
            "pay_to_fare": "driver_pay_to_fare_ratio",
        },
    ).withColumns(
        {
            "driver_pay_per_minute_change_rate": rate_change(
                "driver_pay_per_minute_post", "driver_pay_per_minute_pre"
            ),
            "tolls_change_rate": rate_change("tolls_post", "tolls_pre"),
            "driver_pay_to_fare_ratio_change": F.col("pay_to_fare_post")
            - F.col("pay_to_fare_pre"),
        }
    )
    tolls, pay = zero("tolls_change_rate"), zero("driver_pay_per_minute_change_rate")
    scored = (
        with_bounds(wide, {"tolls": tolls, "pay": pay})
        .withColumn(
            "driver_pressure_score",
            (floored_minmax(tolls, "tolls") + floored_minmax(pay, "pay", inverted=True)) / 2,
        )
        .drop(BOUNDS)
    )
    threshold = scored.agg(F.percentile("driver_pressure_score", 0.9).alias("p90")).scalar()
    return scored.withColumns(
        {
            "driver_incentive_signal": (F.col("driver_pressure_score") >= threshold)
            & (F.col("orders_post") >= 10),
            "business_interpretation": F.lit(L.INTERPRET_DRIVER),
        }
    )


def airport_routes(features: DataFrame, spec: PolicySpec) -> DataFrame:
    """Airport trips by airport and target area, with a recommended strategy."""
    airport = F.when(F.lit(False), "")
    for token, label in spec.airport_labels:
        either = is_true(F.col("pickup_zone_name").contains(token)) | is_true(
            F.col("dropoff_zone_name").contains(token)
        )
        airport = airport.when(either, label)
    core = (F.col("pickup_zone_group") == "treated_zones") | (
        F.col("dropoff_zone_group") == "treated_zones"
    )
    rows = features.where("is_airport_trip").withColumns(
        {
            "airport_name": airport.otherwise("Other airport"),
            "target_area": F.when(core, L.AREA_CORE).otherwise(L.AREA_OTHER),
        }
    )
    wide = pre_post(
        rows, ["airport_name", "target_area"], counts=["orders"],
        means={"fare_per_mile": "fare_per_mile", "driver_pay_per_minute": "driver_pay_per_minute"},
        quantiles={"response_time_p90": 0.9},
    )
    measures = ("orders", "fare_per_mile", "driver_pay_per_minute", "response_time_p90")
    rates = {f"{m}_change_rate": rate_change(f"{m}_post", f"{m}_pre") for m in measures}
    act = is_true(F.col("driver_pay_per_minute_change_rate") < 0) | is_true(
        F.col("response_time_p90_change_rate") > 0
    )
    return wide.withColumns(rates).withColumns(
        {
            "recommended_strategy": F.when(act, L.AIRPORT_ACT).otherwise(L.AIRPORT_WATCH),
            "business_interpretation": F.lit(L.INTERPRET_AIRPORT),
        }
    )


def response_time_windows(features: DataFrame) -> DataFrame:
    """Response quantiles by zone group and operating window; NULL responses excluded."""
    rows = features.where(F.col("response_time_min").isNotNull()).withColumn(
        "time_window", cut("trip_hour", L.REPORT_WINDOW_CUTS)
    )
    wide = pre_post(
        rows, ["pickup_zone_group", "time_window"], counts=["orders"],
        means={"slow_response_rate": "slow_response_flag"},
        quantiles={"response_time_p50": 0.5, "response_time_p90": 0.9},
    ).withColumnRenamed("pickup_zone_group", "zone_group")
    return wide.withColumns(
        {
            "slow_response_rate_change": F.col("slow_response_rate_post")
            - F.col("slow_response_rate_pre"),
            "supply_reallocation_signal": (
                F.col("response_time_p90_post") > F.col("response_time_p90_pre")
            )
            & (F.col("zone_group") == "spillover_zones"),
            "business_interpretation": F.lit(L.INTERPRET_RESPONSE),
        }
    )


def response_group_chart(windows: DataFrame) -> DataFrame:
    """Mean p90 per zone group before and after, with display labels."""
    return (
        windows.groupBy("zone_group")
        .agg(
            F.avg("response_time_p90_pre").alias("response_time_p90_pre"),
            F.avg("response_time_p90_post").alias("response_time_p90_post"),
        )
        .withColumn("zone_label", label_map("zone_group", L.ZONE_GROUP_CHART_LABELS))
    )


EFFICIENCY_FIELDS = (
    "avg_response_time_min", "response_time_p90", "slow_response_rate", "valid_response_count",
)


def service_efficiency(panel: DataFrame) -> DataFrame:
    """Response proxies by zone group from unweighted panel cells."""
    missing = sorted(set(EFFICIENCY_FIELDS) - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks service-efficiency fields: {missing}")
    wide = pre_post(
        panel, ["zone_group"],
        means={
            "average_response_time_min": "avg_response_time_min",
            "response_time_p90": "response_time_p90",
            "slow_response_rate": "slow_response_rate",
        },
        sums={"valid_response_count": "valid_response_count", "order_count": "order_count"},
    )
    return wide.withColumns(
        {
            "response_time_p90_change": F.col("response_time_p90_post")
            - F.col("response_time_p90_pre"),
            "slow_response_rate_change": F.col("slow_response_rate_post")
            - F.col("slow_response_rate_pre"),
            "response_coverage_rate": F.try_divide(
                "valid_response_count_post", "order_count_post"
            ),
        }
    )


def efficiency_long(efficiency: DataFrame) -> DataFrame:
    """Chart form: one row per zone group and period."""
    long = efficiency.select(
        "zone_group", "response_time_p90_pre", "response_time_p90_post"
    ).unpivot(
        "zone_group", ["response_time_p90_pre", "response_time_p90_post"],
        "period", "response_time_p90",
    )
    is_post = F.col("period") == "response_time_p90_post"
    return long.withColumn("period", F.when(is_post, L.POST).otherwise(L.PRE))


ROUTE_FLAG_KEYS = [
    "pickup_zone_name", "dropoff_zone_name", "is_cross_treated_trip", "is_airport_trip",
]


def route_period_metrics(features: DataFrame) -> DataFrame:
    """Count and seven means per route and period; routes with an unknown end drop out."""
    return (
        features.dropna(subset=ROUTE_FLAG_KEYS)
        .groupBy(*ROUTE_FLAG_KEYS, "post_policy")
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.avg("fare_per_mile").alias("fare_per_mile"),
            F.avg("fare_per_minute").alias("fare_per_minute"),
            F.avg("driver_pay_per_mile").alias("driver_pay_per_mile"),
            F.avg("driver_pay_per_minute").alias("driver_pay_per_minute"),
            F.avg("tolls").alias("tolls_per_trip"),
            F.avg("tip_rate").alias("tip_rate"),
            F.avg("driver_pay_to_fare_ratio").alias("driver_pay_to_fare_ratio"),
        )
    )


def pricing_driver_impact(features: DataFrame) -> DataFrame:
    """Price, pay and demand change per route with a subsidy signal."""
    wide = pre_post(
        features.dropna(subset=ROUTE_FLAG_KEYS), ROUTE_FLAG_KEYS, counts=["trip_count"],
        means={
            "fare_per_mile": "fare_per_mile",
            "driver_pay_per_minute": "driver_pay_per_minute",
            "tolls_per_trip": "tolls",
        },
    )
    return wide.withColumns(
        {
            "fare_per_mile_change": F.col("fare_per_mile_post") - F.col("fare_per_mile_pre"),
            "driver_pay_per_minute_change": F.col("driver_pay_per_minute_post")
            - F.col("driver_pay_per_minute_pre"),
            "demand_change": F.col("trip_count_post") - F.col("trip_count_pre"),
        }
    ).withColumn(
        "subsidy_signal",
        (F.col("fare_per_mile_change") > 0) & (F.col("driver_pay_per_minute_change") <= 0),
    )


def heterogeneity(features: DataFrame) -> DataFrame:
    """Order change over five dimensions in long form.

    Trips collapse to at most a few hundred cells over all five dimensions; the
    grouping sets then expand these cells, not the trips.
    """
    dimensions = ["hour_group", "day_type", "distance_group", "pickup_zone_group", "airport_flag"]
    cells = (
        features.select(
            cut("trip_hour", L.SEGMENT_HOUR_CUTS).alias("hour_group"),
            F.when(F.col("is_weekend"), "weekend").otherwise("weekday").alias("day_type"),
            cut("trip_miles", L.DISTANCE_CUTS).alias("distance_group"),
            "pickup_zone_group",
            F.when(F.col("is_airport_trip"), "airport")
            .otherwise("non_airport")
            .alias("airport_flag"),
            "post_policy",
        )
        .groupBy(*dimensions)
        .agg(
            F.count_if(~F.col("post_policy")).alias("pre"),
            F.count_if(F.col("post_policy")).alias("post"),
        )
    )
    sets = cells.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id().alias("_set"),
        F.sum("pre").alias("pre_order_count"),
        F.sum("post").alias("post_order_count"),
    )
    # grouping_id has a 0 bit only at the dimension a row belongs to.
    full = 2 ** len(dimensions) - 1
    name, segment = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for place, dimension in enumerate(dimensions):
        mine = F.col("_set") == full - 2 ** (len(dimensions) - 1 - place)
        name, segment = name.when(mine, dimension), segment.when(mine, F.col(dimension))
    return (
        sets.select(
            name.alias("dimension"), segment.alias("segment"),
            "pre_order_count", "post_order_count",
        )
        .where(F.col("segment").isNotNull())
        .withColumns(
            {
                "absolute_change": F.col("post_order_count") - F.col("pre_order_count"),
                "relative_change": rate_change("post_order_count", "pre_order_count"),
            }
        )
    )


ZONE_KEYS = ["zone_id", "zone_name", "zone_group"]


def spillover_ranking(panel: DataFrame) -> DataFrame:
    """Order totals per zone and the growth score relative change times ln(1 + post)."""
    wide = pre_post(panel.dropna(subset=ZONE_KEYS), ZONE_KEYS, sums={"order_count": "order_count"})
    return wide.withColumnsRenamed(
        {"order_count_pre": "pre_order_count", "order_count_post": "post_order_count"}
    ).withColumns(
        {
            "absolute_change": F.col("post_order_count") - F.col("pre_order_count"),
            "relative_change": rate_change("post_order_count", "pre_order_count"),
            "spillover_score": zero(rate_change("post_order_count", "pre_order_count"))
            * F.log1p("post_order_count"),
        }
    )


def top_spillover(ranking: DataFrame, k: int = 15) -> DataFrame:
    """The strongest zones of the configured spillover group."""
    return (
        ranking.where(F.col("zone_group") == "spillover_zones")
        .orderBy(F.col("spillover_score").desc(), "zone_id")
        .limit(k)
    )

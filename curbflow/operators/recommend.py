"""Rule-based scores, action lists and strategy cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import hour_window, is_true, rate_change, zero
from curbflow.functions.scores import BOUNDS, guarded_minmax, with_bounds
from curbflow.operators.compare import ZONE_KEYS, pre_post
from curbflow.operators.timeseries import peak_hour

CONTEXT_MEASURES = (
    "order_count", "avg_fare_per_mile", "avg_driver_pay_per_minute", "avg_tolls",
    "response_time_p90", "slow_response_rate",
)
GAP_MEASURES = (
    "actual_order_count", "predicted_counterfactual_order_count", "demand_gap", "demand_gap_rate",
)


def zone_context(panel: DataFrame) -> DataFrame:
    """Mean panel measures before and after per zone; zones without a name drop out."""
    return pre_post(
        panel.dropna(subset=ZONE_KEYS), ZONE_KEYS, means={m: m for m in CONTEXT_MEASURES}
    )


def mean_demand_gap(predictions: DataFrame) -> DataFrame:
    return (
        predictions.dropna(subset=["zone_id", "zone_name"])
        .groupBy("zone_id", "zone_name")
        .agg(*[F.avg(m).alias(m) for m in GAP_MEASURES])
    )


def _blend(gap: Column, pressure: Column, price: Column, spill: Column) -> Column:
    # Weights of demand gap, driver pressure, price pressure, spillover.
    return 0.35 * gap + 0.25 * pressure + 0.20 * price + 0.20 * spill


def _clip01(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def _positive(name: str) -> Column:
    return F.greatest(zero(name), F.lit(0.0))


def _sub_scores(df: DataFrame, metrics: dict[str, Column], toll: str, spill_name: str):
    """Append the four sub-scores and the blended action score."""
    def score(name):
        return guarded_minmax(metrics[name], name)

    return (
        with_bounds(df, metrics)
        .withColumns(
            {
                "demand_gap_score": score("gap"),
                "driver_pressure_score": _clip01(score(toll) - score("pay")),
                "passenger_price_pressure_score": score("price"),
                spill_name: score("spill"),
            }
        )
        .drop(BOUNDS)
        .withColumn(
            "final_action_score",
            _blend(
                F.col("demand_gap_score"), F.col("driver_pressure_score"),
                F.col("passenger_price_pressure_score"), F.col(spill_name),
            ),
        )
    )


def zone_scores(panel: DataFrame, predictions: DataFrame, spillover: DataFrame) -> DataFrame:
    """Zone context joined with peak hour, demand gap and spillover, scored 0..1."""
    busiest = peak_hour(
        panel.where("post_policy").dropna(subset=ZONE_KEYS), ZONE_KEYS
    ).drop("peak_orders")
    joined = (
        zone_context(panel)
        .join(busiest, ZONE_KEYS, "left")
        .join(mean_demand_gap(predictions), ["zone_id", "zone_name"], "left")
        .join(spillover.select("zone_id", "spillover_score"), "zone_id", "left")
    )
    rates = {
        "fare_per_mile_change_rate": "avg_fare_per_mile",
        "driver_pay_per_minute_change_rate": "avg_driver_pay_per_minute",
        "tolls_change_rate": "avg_tolls",
    }
    context = joined.withColumns(
        {
            "spillover_score": zero("spillover_score"),
            **{name: zero(rate_change(f"{m}_post", f"{m}_pre")) for name, m in rates.items()},
            "response_time_p90_change": F.col("response_time_p90_post")
            - F.col("response_time_p90_pre"),
            "slow_response_rate_change": F.col("slow_response_rate_post")
            - F.col("slow_response_rate_pre"),
        }
    )
    metrics = {
        "gap": _positive("demand_gap_rate"),
        "toll": F.col("tolls_change_rate"),
        "pay": F.col("driver_pay_per_minute_change_rate"),
        "price": _positive("fare_per_mile_change_rate"),
        "spill": _positive("spillover_score"),
    }
    scored = _sub_scores(context, metrics, "toll", "spillover_score_normalized")
    return scored.na.fill(0, ["hour", *GAP_MEASURES])


def route_scores(pricing: DataFrame) -> DataFrame:
    """Route economics scored like the zones; falling orders stand in for the demand gap."""
    rates = {
        f"{m}_change_rate": zero(rate_change(f"{m}_post", f"{m}_pre"))
        for m in ("fare_per_mile", "driver_pay_per_minute", "tolls_per_trip")
    }
    fall = -rate_change("trip_count_post", "trip_count_pre")
    routes = pricing.withColumns(rates).withColumn(
        "demand_gap_rate", F.greatest(zero(fall), F.lit(0.0))
    )
    metrics = {
        "gap": F.col("demand_gap_rate"),
        "toll": F.col("tolls_per_trip_change_rate"),
        "pay": F.col("driver_pay_per_minute_change_rate"),
        "price": _positive("fare_per_mile_change_rate"),
        "spill": F.greatest(F.col("demand_change").cast("double"), F.lit(0.0)),
    }
    return _sub_scores(routes, metrics, "toll", "spillover_score")


def top_k_or_fallback(
    df: DataFrame,
    rule: Column,
    order: Sequence[Column],
    k: int,
    fallback_rule: Column,
    fallback_order: Sequence[Column],
    fallback_k: int,
) -> DataFrame:
    """Top-k of the rows that meet ``rule``; the fallback top-k when none does.

    The choice is a scalar subquery in the plan, not a branch on the driver.
    """
    matches = df.where(is_true(rule)).agg(F.count(F.lit(1)).alias("n")).scalar()
    best = df.where(is_true(rule)).orderBy(*order).limit(k)
    spare = df.where(is_true(fallback_rule)).orderBy(*fallback_order).limit(fallback_k)
    return best.unionByName(spare.where(matches == 0))


def _by(score: str, *ties: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def supply_reallocation(zones: DataFrame) -> DataFrame:
    rule = (F.col("zone_group") == "spillover_zones") & (F.col("spillover_score") > 0)
    chosen = top_k_or_fallback(
        zones, rule, _by("final_action_score", "zone_id"), 8,
        F.lit(True), _by("spillover_score", "zone_id"), 3,
    )
    return chosen.withColumns(
        {
            "recommended_action": F.lit(L.SUPPLY_ACTION),
            "target_time_window": hour_window("hour"),
            "expected_business_impact": F.lit(L.SUPPLY_IMPACT),
        }
    )


ROUTE_TIES = ("pickup_zone_name", "dropoff_zone_name", "is_airport_trip", "is_cross_treated_trip")


def route_incentives(routes: DataFrame) -> DataFrame:
    """High-value routes under driver pressure.

    ``routes`` has at most one row per zone pair and flag pair, which bounds the
    state of the exact quantile.
    """
    busy = routes.agg(F.percentile("trip_count_post", 0.75).alias("p75")).scalar()
    valuable = (F.col("trip_count_post") > 0) & (
        F.col("is_airport_trip") | (F.col("trip_count_post") >= busy)
    )
    order = _by("final_action_score", *ROUTE_TIES)
    chosen = top_k_or_fallback(
        routes, valuable & (F.col("driver_pressure_score") > 0), order, 12, valuable, order, 6
    )
    return chosen.withColumns(
        {
            "target_od_pair": F.concat_ws(" -> ", "pickup_zone_name", "dropoff_zone_name"),
            "recommended_action": F.lit(L.INCENTIVE_ACTION),
            "expected_business_impact": F.lit(L.INCENTIVE_IMPACT),
        }
    )


def passenger_discounts(zones: DataFrame) -> DataFrame:
    rule = (F.col("demand_gap_rate") > 0) & (F.col("fare_per_mile_change_rate") > 0)
    order = _by("final_action_score", "zone_id")
    chosen = top_k_or_fallback(zones, rule, order, 8, F.col("demand_gap") > 0, order, 5)
    return chosen.withColumns(
        {
            "recommended_action": F.lit(L.DISCOUNT_ACTION),
            "target_time_window": hour_window("hour"),
            "expected_business_impact": F.lit(L.DISCOUNT_IMPACT),
        }
    )


def low_value_supply(zones: DataFrame, k: int = 2) -> DataFrame:
    """Ordinary zones with falling pay and the smallest action scores."""
    weak = (F.col("zone_group") == "other") & (F.col("driver_pay_per_minute_change_rate") < 0)
    return zones.where(weak).orderBy("final_action_score", "zone_id").limit(k)


def priority(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.75, "High").when(score >= 0.45, "Medium").otherwise("Low")


def confidence(sample_size: Column, signals: int) -> Column:
    high = sample_size >= 200 if signals >= 3 else F.lit(False)
    medium = sample_size >= 50 if signals >= 2 else F.lit(False)
    return F.when(high, "High").when(medium, "Medium").otherwise("Low")


def _evidence(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _r(name: str, digits: int = 3) -> Column:
    return F.round(F.col(name), digits)


def _cards(
    rows: DataFrame, order: Sequence[Column], k: int, place: int, kind: str, *,
    zone: bool, window: Column, problem: str, evidence: Column, action: Column,
    impact: Column, sample: str, signals: int,
) -> DataFrame:
    """First ``k`` rows of an action list in card form."""
    blank = F.lit("")
    return (
        rows.orderBy(*order)
        .limit(k)
        .select(
            F.lit(place).alias("_branch"),
            # at most k rows reach this window
            F.row_number().over(Window.partitionBy(F.lit(place)).orderBy(*order)).alias("_rank"),
            F.lit(kind).alias("strategy_type"),
            (F.coalesce("zone_name", blank) if zone else blank).alias("target_zone"),
            (F.coalesce("zone_group", blank) if zone else blank).alias("target_zone_group"),
            (blank if zone else F.col("target_od_pair")).alias("target_od_pair"),
            window.alias("target_time_window"),
            F.lit(problem).alias("problem_detected"),
            evidence.alias("evidence_metric"),
            action.alias("recommended_action"),
            impact.alias("expected_business_impact"),
            F.round("final_action_score", 3).alias("final_action_score"),
            priority("final_action_score").alias("priority"),
            confidence(F.col(sample), signals).alias("confidence_level"),
        )
    )


def strategy_cards(zones: DataFrame, routes: DataFrame) -> DataFrame:
    """Numbered cards of six strategy types with their evidence as JSON."""
    supply, incentives = supply_reallocation(zones), route_incentives(routes)
    discounts, weak = passenger_discounts(zones), low_value_supply(zones)
    # A supply list made by its fallback rule is ranked by spillover, else by score.
    is_rule = (F.col("zone_group") == "spillover_zones") & (F.col("spillover_score") > 0)
    supply_order = [
        F.when(is_rule, F.col("final_action_score"))
        .otherwise(F.col("spillover_score"))
        .desc_nulls_last(),
        F.col("zone_id").asc(),
    ]
    zone_order = _by("final_action_score", "zone_id")
    route_order = _by("final_action_score", *ROUTE_TIES)
    action, impact = F.col("recommended_action"), F.col("expected_business_impact")
    window = F.col("target_time_window")
    trips = F.col("trip_count_post").cast("bigint")
    branches = [
        _cards(
            supply, supply_order, 3, 1, "driver_supply_reallocation", zone=True, window=window,
            problem=L.PROBLEM_SUPPLY,
            evidence=_evidence(
                spillover_score=_r("spillover_score"),
                demand_gap_rate=_r("demand_gap_rate"),
                post_policy_average_orders=_r("order_count_post", 2),
                response_time_p90_change_min=_r("response_time_p90_change", 2),
                slow_response_rate_change=_r("slow_response_rate_change"),
            ),
            action=action, impact=impact, sample="order_count_post", signals=3,
        ),
        _cards(
            incentives.where(~F.col("is_airport_trip")), route_order, 2, 2,
            "route_level_driver_incentive", zone=False, window=F.lit(L.WINDOW_ROUTE),
            problem=L.PROBLEM_ROUTE,
            evidence=_evidence(
                post_policy_order_count=trips,
                tolls_change_rate=_r("tolls_per_trip_change_rate"),
                driver_pay_per_minute_change_rate=_r("driver_pay_per_minute_change_rate"),
                fare_per_mile_change_rate=_r("fare_per_mile_change_rate"),
            ),
            action=action, impact=impact, sample="trip_count_post", signals=3,
        ),
        _cards(
            incentives.where("is_airport_trip"), route_order, 2, 3, "airport_route_strategy",
            zone=False, window=F.lit(L.WINDOW_AIRPORT), problem=L.PROBLEM_AIRPORT,
            evidence=_evidence(
                post_policy_order_count=trips,
                tolls_change_rate=_r("tolls_per_trip_change_rate"),
                driver_pay_per_minute_change_rate=_r("driver_pay_per_minute_change_rate"),
            ),
            action=F.lit(L.AIRPORT_CARD_ACTION), impact=F.lit(L.AIRPORT_CARD_IMPACT),
            sample="trip_count_post", signals=3,
        ),
        _cards(
            discounts, zone_order, 2, 4, "passenger_discount", zone=True, window=window,
            problem=L.PROBLEM_DISCOUNT,
            evidence=_evidence(
                demand_gap_rate=_r("demand_gap_rate"),
                fare_per_mile_change_rate=_r("fare_per_mile_change_rate"),
                driver_pay_per_minute_change_rate=_r("driver_pay_per_minute_change_rate"),
            ),
            action=action, impact=impact, sample="actual_order_count", signals=3,
        ),
        _cards(
            supply, supply_order, 2, 5, "boundary_zone_strategy", zone=True, window=window,
            problem=L.PROBLEM_BOUNDARY,
            evidence=_evidence(
                spillover_score=_r("spillover_score"),
                post_policy_average_orders=_r("order_count_post", 2),
                response_time_p90_change_min=_r("response_time_p90_change", 2),
            ),
            action=F.lit(L.BOUNDARY_ACTION), impact=F.lit(L.BOUNDARY_IMPACT),
            sample="order_count_post", signals=3,
        ),
        _cards(
            weak, [F.col("final_action_score").asc(), F.col("zone_id").asc()], 2, 6,
            "reduce_low_value_supply", zone=True, window=hour_window("hour"),
            problem=L.PROBLEM_LOW_VALUE,
            evidence=_evidence(
                driver_pay_per_minute_change_rate=_r("driver_pay_per_minute_change_rate"),
                spillover_score=_r("spillover_score"),
                demand_gap_rate=_r("demand_gap_rate"),
            ),
            action=F.lit(L.LOW_VALUE_ACTION), impact=F.lit(L.LOW_VALUE_IMPACT),
            sample="order_count_post", signals=2,
        ),
    ]
    stacked = branches[0]
    for branch in branches[1:]:
        stacked = stacked.unionByName(branch)
    # at most 13 cards exist, so one ordered window numbers them
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_branch", "_rank"))
    return stacked.select(
        F.format_string("STRAT_%04d", number).alias("strategy_id"), "*"
    ).drop("_branch", "_rank")


def stamped(cards: DataFrame) -> DataFrame:
    """Cards with the creation time, as written to the sinks."""
    return cards.withColumn("created_at", F.current_timestamp())


def policy_cards(
    spillover: DataFrame, pricing: DataFrame, heterogeneity: DataFrame
) -> DataFrame:
    """Short English cards: boundary zones, subsidy routes and the weakest hour group."""
    none = F.lit(None).cast("string")
    zone_order = [F.col("spillover_score").desc_nulls_last(), F.col("zone_id").asc()]
    zones = (
        spillover.where(F.col("zone_group") == "spillover_zones")
        .orderBy(*zone_order)
        .limit(3)
        .select(
            F.lit(1).alias("_branch"),
            F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*zone_order)).alias("_rank"),
            F.concat(F.lit("boundary_"), F.col("zone_id").cast("string")).alias("strategy_id"),
            F.lit("boundary_zone_strategy").alias("strategy_type"),
            F.col("zone_name").alias("target_zone"),
            none.alias("target_od_pair"),
            F.lit("Monitor by hour").alias("target_time_window"),
            F.lit(L.BOUNDARY_PROBLEM_EN).alias("problem_detected"),
            F.format_string(
                "spillover_score=%.3f; post orders=%d", "spillover_score", "post_order_count"
            ).alias("evidence_metric"),
            F.lit(L.BOUNDARY_ACTION_EN).alias("recommended_action"),
            F.lit(L.BOUNDARY_IMPACT_EN).alias("expected_business_impact"),
            F.lit("high").alias("priority"),
        )
    )
    route_order = [F.col("demand_change").desc_nulls_last(), *map(F.col, ROUTE_TIES)]
    routes = (
        pricing.where("subsidy_signal")
        .orderBy(*route_order)
        .limit(3)
        .select(
            F.lit(2).alias("_branch"),
            F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*route_order)).alias("_rank"),
            none.alias("strategy_id"),
            F.lit("route_level_incentive").alias("strategy_type"),
            none.alias("target_zone"),
            F.concat_ws(" -> ", "pickup_zone_name", "dropoff_zone_name").alias("target_od_pair"),
            F.lit("Policy-period route").alias("target_time_window"),
            F.lit(L.ROUTE_PROBLEM_EN).alias("problem_detected"),
            F.format_string(
                "fare/mile change=%.2f; driver-pay/min change=%.2f",
                "fare_per_mile_change", "driver_pay_per_minute_change",
            ).alias("evidence_metric"),
            F.lit(L.ROUTE_ACTION_EN).alias("recommended_action"),
            F.lit(L.ROUTE_IMPACT_EN).alias("expected_business_impact"),
            F.lit("high").alias("priority"),
        )
    )
    hours = (
        heterogeneity.where(F.col("dimension") == "hour_group")
        .orderBy(F.col("relative_change").asc_nulls_last(), "segment")
        .limit(1)
        .select(
            F.lit(3).alias("_branch"),
            F.lit(1).alias("_rank"),
            F.lit("peak_hour_1").alias("strategy_id"),
            F.lit("peak_hour_operation").alias("strategy_type"),
            F.lit("treated zones").alias("target_zone"),
            none.alias("target_od_pair"),
            F.col("segment").alias("target_time_window"),
            F.lit(L.HOUR_PROBLEM_EN).alias("problem_detected"),
            F.format_string(
                "relative demand change=%.1f%%", F.col("relative_change") * 100
            ).alias("evidence_metric"),
            F.lit(L.HOUR_ACTION_EN).alias("recommended_action"),
            F.lit(L.HOUR_IMPACT_EN).alias("expected_business_impact"),
            F.lit("medium").alias("priority"),
        )
    )
    # at most seven rows; the running number names the route cards
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_branch", "_rank"))
    return (
        zones.unionByName(routes)
        .unionByName(hours)
        .withColumn("_place", place)
        .withColumn(
            "strategy_id",
            F.coalesce("strategy_id", F.concat(F.lit("route_"), F.col("_place").cast("string"))),
        )
        .drop("_branch", "_rank", "_place")
    )


def business_recommendations(pickup: DataFrame, routes: DataFrame) -> DataFrame:
    """Four recommendation types with four rows each."""
    route_ties = ["pickup_zone", "dropoff_zone", "pickup_borough", "dropoff_borough"]
    nulls_first = [F.col(c).asc_nulls_first() for c in route_ties]
    busiest = routes.orderBy(F.col("order_count").desc(), *nulls_first).limit(20)
    route_name = F.concat(F.col("pickup_zone"), F.lit(" → "), F.col("dropoff_zone"))

    def text(name):
        return F.round(F.col(name), 2).cast("string")

    def branch(rows, order, kind, target, evidence, wording):
        action, value, level = wording
        return rows.orderBy(*order).limit(4).select(
            F.lit(kind).alias("recommendation_type"),
            target.alias("target_zone_or_route"),
            evidence.alias("evidence_metric"),
            F.lit(action).alias("recommended_action"),
            F.lit(value).alias("business_value"),
            F.lit(level).alias("confidence_level"),
        )

    supply = branch(
        pickup,
        [
            F.col("avg_response_time_min").desc_nulls_last(),
            F.col("pickup_zone").asc_nulls_first(),
            F.col("pickup_borough").asc_nulls_first(),
        ],
        "driver_supply_reallocation",
        F.col("pickup_zone"),
        F.concat(F.lit("平均响应代理 "), text("avg_response_time_min"), F.lit(" 分钟")),
        L.REC_SUPPLY,
    )
    frequent = branch(
        routes, [F.col("order_count").desc(), *nulls_first], "route_priority", route_name,
        F.concat(F.lit("订单量 "), F.col("order_count").cast("string")), L.REC_ROUTE,
    )
    low_pay = branch(
        busiest, [F.col("avg_driver_pay_per_minute").asc_nulls_last(), *nulls_first],
        "driver_incentive", route_name,
        F.concat(F.lit("司机每分钟收益 "), text("avg_driver_pay_per_minute")), L.REC_DRIVER,
    )
    high_fare = branch(
        busiest, [F.col("avg_fare_per_mile").desc_nulls_last(), *nulls_first],
        "passenger_discount", route_name,
        F.concat(F.lit("每英里票价 "), text("avg_fare_per_mile")), L.REC_DISCOUNT,
    )
    return supply.unionByName(frequent).unionByName(low_pay).unionByName(high_fare)


def evidence_text(evidence: str | Column) -> Column:
    """Readable phrases from evidence JSON (single quotes allowed).

    Decimal numbers print as percent when the key holds "rate", else with three
    digits; integers print as they are. Text that is not JSON returns unchanged.
    """
    raw = F.col(evidence) if isinstance(evidence, str) else evidence
    quoted = F.replace(raw, F.lit("'"), F.lit('"'))
    parsed = F.from_json(quoted, "map<string,string>")
    names = F.create_map(*[F.lit(x) for pair in L.EVIDENCE_LABELS.items() for x in pair])

    def phrase(entry):
        key, value = entry["key"], entry["value"]
        number = value.try_cast("double")
        is_decimal = value.rlike(r"^-?[0-9]+(\.[0-9]+([eE][-+]?[0-9]+)?|[eE][-+]?[0-9]+)$")
        shown = (
            F.when(is_decimal & key.contains("rate"), F.format_string("%.1f%%", number * 100))
            .when(is_decimal, F.format_string("%.3f", number))
            .otherwise(value)
        )
        return F.concat(F.coalesce(F.try_element_at(names, key), key), F.lit("："), shown)

    rendered = F.array_join(F.transform(F.map_entries(parsed), phrase), "；")
    is_object = F.ltrim(quoted).startswith("{") & parsed.isNotNull()
    other_json = F.get_json_object(quoted, "$").isNotNull()
    return (
        F.when(raw.isNull(), L.NO_EVIDENCE)
        .when(is_object, rendered)
        .when(other_json, L.NO_EVIDENCE)
        .otherwise(raw)
    )


def rank_cards(cards: DataFrame, kind: str | None = None) -> DataFrame:
    """Cards of one type (or all), High before Medium before Low, best score first."""
    level = F.lower("priority")
    rank = F.when(level == "high", 0).when(level == "medium", 1).when(level == "low", 2).otherwise(3)
    chosen = cards if kind is None else cards.where(F.col("strategy_type") == kind)
    return chosen.withColumn("priority_rank", rank).orderBy(
        "priority_rank", F.col("final_action_score").desc(), "strategy_id"
    )


def card_counts(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_if(F.lower("priority") == "high").alias("high_priority"),
        F.count_distinct("strategy_type").alias("strategy_types"),
    )

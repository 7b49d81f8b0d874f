"""The operator chain from raw trips to results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import (
    causal, cleaning, compare, features, forecast, marts, panels, quality, recommend, reports,
    sketches,
)
from curbflow.session import materialize
from curbflow.sinks import warehouse, writers
from curbflow.sources import adapters, inventory
from curbflow.spec import NYC_CONGESTION_PRICING, PolicySpec


@dataclass
class Chain:
    """Frames of one data set. Plain properties are plans; those named ``stored_...`` and the
    fitted models run their jobs when first asked for, and keep the result."""

    raw_ride_hailing: Callable[[], DataFrame]
    raw_yellow: Callable[[], DataFrame] | None
    read_zones: Callable[[], DataFrame]
    spec: PolicySpec = NYC_CONGESTION_PRICING

    @classmethod
    def over_tables(cls, spark: SparkSession, sf_dir: str) -> Chain:
        """Chain over the star-schema stand-ins, which are plans over the given tables."""
        return cls(
            lambda: adapters.raw_trips_hv(spark, sf_dir),
            lambda: adapters.raw_trips_yellow(spark, sf_dir),
            lambda: adapters.zones(spark, sf_dir),
            adapters.ADAPTER_SPEC,
        )

    @property
    def spark(self) -> SparkSession:
        return self.zones.sparkSession

    @cached_property
    def zones(self) -> DataFrame:
        return self.read_zones()

    @cached_property
    def raw(self) -> DataFrame:
        return self.raw_ride_hailing()

    @cached_property
    def raw_taxi(self) -> DataFrame:
        return self.raw_yellow()

    @cached_property
    def standard(self) -> DataFrame:
        return cleaning.standard_trips(self.raw, cleaning.RIDE_HAILING, self.spec.rules)

    @cached_property
    def standard_yellow(self) -> DataFrame:
        return cleaning.standard_trips(self.raw_taxi, cleaning.YELLOW, self.spec.rules)

    @cached_property
    def standard_all(self) -> DataFrame:
        return cleaning.union_services(self.standard, self.standard_yellow)

    @cached_property
    def trips(self) -> DataFrame:
        return cleaning.policy_trips(self.raw, cleaning.RIDE_HAILING, self.spec.rules)

    @cached_property
    def trips_yellow(self) -> DataFrame:
        return cleaning.policy_trips(self.raw_taxi, cleaning.YELLOW, self.spec.rules)

    @cached_property
    def features(self) -> DataFrame:
        return features.policy_features(self.trips, self.zones, self.spec)

    @cached_property
    def stored_features(self) -> DataFrame:
        """The features as a written table, for panels and results that read them several times."""
        return materialize(self.features, "features")

    @cached_property
    def stored_dwd(self) -> DataFrame:
        return features.dwd_trips(self.stored_features)

    @cached_property
    def dwd(self) -> DataFrame:
        return features.dwd_trips(self.features)

    @cached_property
    def panel(self) -> DataFrame:
        return panels.zone_hour_panel(self.stored_features, self.zones, self.spec)

    @cached_property
    def od_panel(self) -> DataFrame:
        return panels.od_hour_panel(self.stored_features, self.zones, self.spec)

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel as a written table, for results that read it several times."""
        return materialize(self.panel, "panel")

    @cached_property
    def pricing(self) -> DataFrame:
        return compare.pricing_driver_impact(self.features)

    @cached_property
    def spillover(self) -> DataFrame:
        return compare.spillover_ranking(self.stored_panel)

    @cached_property
    def naive_gap(self) -> DataFrame:
        return forecast.seasonal_naive_gap(self.stored_panel)

    @cached_property
    def zone_scores(self) -> DataFrame:
        panel = self.stored_panel
        return recommend.zone_scores(
            panel, forecast.seasonal_naive_gap(panel), compare.spillover_ranking(panel)
        )

    @cached_property
    def route_scores(self) -> DataFrame:
        return recommend.route_scores(self.pricing)

    @cached_property
    def forest(self) -> forecast.Forecast:
        return forecast.fit_forecast(self.stored_panel, "random_forest")

    @cached_property
    def boosted(self) -> forecast.Forecast:
        return forecast.fit_forecast(self.stored_panel, "gradient_boosting")

    @cached_property
    def counterfactual(self) -> forecast.Counterfactual:
        return forecast.fit_counterfactual(self.stored_panel)

    @cached_property
    def stored_zone_scores(self) -> DataFrame:
        return materialize(self.zone_scores, "zone-scores")

    @cached_property
    def stored_route_scores(self) -> DataFrame:
        return materialize(self.route_scores, "route-scores")

    @cached_property
    def cards(self) -> DataFrame:
        return recommend.strategy_cards(self.stored_zone_scores, self.stored_route_scores)


def run_pipeline(
    chain: Chain,
    out: str,
    boost: forecast.BoostSettings = forecast.BASELINE_BOOST,
    demand: forecast.BoostSettings = forecast.BoostSettings(),
    forest: forecast.ForestSettings = forecast.ForestSettings(),
) -> dict[str, str]:
    """Write trips, panels, metrics, forecasts and results once, layer by layer.

    Each layer reads the files of the layer below, so a lost executor repeats one
    layer at most. Tables of the warehouse are written where and as ``warehouse.TABLES``
    says; all other results are Parquet under ``ads``. Returns the path of every table.
    """
    spark = chain.spark
    paths: dict[str, str] = {}
    sizes: dict[str, int] = {}

    def save(name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        _, fmt, parts = warehouse.TABLES.get(name, ("", "parquet", (partition,) if partition else ()))
        known = name in warehouse.TABLES
        path = warehouse.table_path(out, name) if known else f"{out.rstrip('/')}/ads/{name}"
        paths[name] = path
        schema = df.schema
        df, counted = quality.counting(df)
        if fmt == "csv":
            writers.write_csv(df, path)
            written = spark.read.schema(schema).csv(path, header=True)
        else:
            if parts:
                writers.write_partitioned(df, path, *parts)
            else:
                writers.write_parquet(df, path)
            written = spark.read.parquet(path)
        sizes[name] = counted.values["rows"]
        return written

    def stored_rows(name: str) -> int:
        return inventory.file_inventory(spark, paths[name]).agg(F.sum("rows")).first()[0] or 0

    # Raw trips are profiled, and dropped ones counted, while the layers above are written.
    services = {cleaning.RIDE_HAILING: chain.raw}
    if chain.raw_yellow:
        services[cleaning.YELLOW] = chain.raw_taxi
    profiles, parts = {}, []
    for service, raw in services.items():
        profiled, profiles[service] = quality.profiling(raw, service, chain.spec.rules)
        parts.append(cleaning.standard_trips(profiled, service, chain.spec.rules))
    both = cleaning.union_services(*parts) if len(parts) > 1 else parts[0]
    standard = save("dwd_clean_trips", both, "pickup_month")
    by_service = {
        row.service_type: row["count"] for row in standard.groupBy("service_type").count().collect()
    }
    rows = []
    for service, raw in services.items():
        row = quality.profile_row(
            spark, service, profiles[service], by_service.get(service, 0)
        )
        rows.append(row if row is not None else quality.quality_profile(raw, service, chain.spec.rules))
    save("quality_profile", reduce(lambda a, b: a.unionByName(b, True), rows))

    raw, raw_count = quality.counting(chain.raw)
    kept, kept_count = quality.counting(
        cleaning.policy_trips(raw, cleaning.RIDE_HAILING, chain.spec.rules)
    )
    trips = save(
        "dwd_trip_policy_feature",
        features.policy_features(kept, chain.zones, chain.spec).withColumn(
            "trip_month", F.date_format("trip_date", "yyyy-MM")
        ),
        "trip_month",
    )
    if kept_count.values["rows"] == stored_rows("dwd_trip_policy_feature"):
        drops = quality.drop_row(
            spark, raw_count.values["rows"], kept_count.values["rows"], "policy trips"
        )
    else:  # tasks were repeated, so what they counted cannot be told from the rest
        drops = quality.drop_summary(chain.raw, trips, "policy trips")
    drops = save("data_quality_summary", drops)
    dwd = save("dwd_hvfhv_trip_clean", features.numbered_trips(features.dwd_trips(trips)))
    panel = save(
        "dws_zone_hour_policy_panel",
        panels.zone_hour_panel(trips, chain.zones, chain.spec).withColumn(
            "dt", F.date_format("trip_date", "yyyy-MM-dd")
        ),
        "dt",
    ).drop("dt")
    save(
        "dws_od_policy_panel",
        panels.od_hour_panel(trips, chain.zones, chain.spec).withColumn(
            "dt", F.date_format("trip_date", "yyyy-MM-dd")
        ),
        "dt",
    )
    save("dws_time_demand_metrics", marts.time_demand_metrics(dwd))
    pickups = save("pickup_zone_metrics", marts.pickup_zone_metrics(dwd))
    save("dws_zone_demand_metrics", marts.zone_demand_metrics(dwd))
    routes = save("dws_od_route_metrics", marts.od_route_metrics(dwd))
    save("dws_price_driver_metrics", marts.price_driver_metrics(dwd))
    response = save("dws_response_metrics", marts.response_metrics(dwd))
    daily = save("dws_response_sketches", sketches.response_sketches(dwd))
    save("response_metrics_by_hour", sketches.merged_responses(daily, ["hour"]))
    days = save("dws_distinct_sketches", sketches.distinct_sketches(dwd))
    save("distinct_counts", sketches.merged_distincts(days))
    save("dws_hourly_demand", marts.hourly_demand(standard))
    save("dws_zone_hourly_demand", marts.zone_hourly_demand(standard, chain.zones))
    save("top_od_flows", marts.top_od_flows(standard))
    save("invalid_trip_summary", marts.invalid_reason_summary(standard))

    save("demand_shift_summary", compare.demand_shift(trips))
    save("hourly_demand_pattern", compare.hourly_pattern(trips))
    save("time_window_summary", compare.time_window_pattern(trips))
    save("od_flow_change", compare.od_flow_change(trips))
    save("pricing_pressure_summary", compare.pricing_pressure(trips))
    save("driver_pressure_summary", compare.driver_pressure(trips))
    save("airport_route_analysis", compare.airport_routes(trips, chain.spec))
    windows = save("response_time_windows", compare.response_time_windows(trips))
    save("service_efficiency", compare.service_efficiency(panel))
    pricing = save("pricing_driver_impact", compare.pricing_driver_impact(trips))
    segments = save("heterogeneity_summary", compare.heterogeneity(trips))
    spillover = save("spillover_zone_ranking", compare.spillover_ranking(panel))
    effects = save("dws_policy_effect_result", causal.did_fixed_effects(panel))
    save("event_study_results", causal.event_study(panel, chain.spec))

    models = {
        name: forecast.fit_forecast(panel, name, forest, demand)
        for name in ("random_forest", "gradient_boosting")
    }
    metrics = None
    for name, fitted in models.items():
        row = forecast.forecast_metrics(fitted, name)
        metrics = row if metrics is None else metrics.unionByName(row)
    metrics = save("model_metrics", metrics)
    save("best_model", forecast.best_model(metrics))
    save("feature_importance", models["gradient_boosting"].importance)
    save("demand_forecast", forecast.forecast_predictions(models["gradient_boosting"]))

    baseline = forecast.fit_counterfactual(panel, boost)
    gaps = save("counterfactual_predictions", baseline.predictions)
    save("counterfactual_metrics", baseline.metrics)
    zone_table = save("zone_scores", recommend.zone_scores(panel, gaps, spillover))
    route_table = save("route_scores", recommend.route_scores(pricing))
    save("driver_supply_reallocation", recommend.supply_reallocation(zone_table))
    save("route_incentive_recommendation", recommend.route_incentives(route_table))
    save("passenger_discount_recommendation", recommend.passenger_discounts(zone_table))
    save(
        "dws_operation_strategy_recommendation",
        recommend.stamped(recommend.strategy_cards(zone_table, route_table)),
    )
    save("policy_cards", recommend.policy_cards(spillover, pricing, segments))
    save(
        "business_recommendations",
        recommend.business_recommendations(pickups, routes),
    )
    # The report reads the tables above, never the trips.
    save("report_scalars", reports.report_scalars(drops, pickups, routes, response, windows))
    save("report_estimates", reports.report_estimates(effects, metrics))
    catalogue = spark.createDataFrame(
        sorted(sizes.items()), "result string, available_rows long"
    )
    save("output_catalogue", catalogue)
    return paths

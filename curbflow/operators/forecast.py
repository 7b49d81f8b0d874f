"""Demand forecasts and the no-policy baseline, on the distributed tree learners."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.operators.boosting import BoostSettings, fit_boosted
from curbflow.operators.forest import ForestSettings, fit_forest
from curbflow.operators.timeseries import demand_lags, rolling_means
from curbflow.session import materialize

# Feature lists and model settings.
FORECAST_FEATURES = (
    "zone_id", "hour", "weekday", "is_weekend", "month", "avg_trip_miles", "avg_fare_per_mile",
    "avg_driver_pay_per_minute", "avg_response_time_min", "lag_1_hour_order_count",
    "lag_24_hour_order_count", "lag_7_day_order_count", "rolling_3_hour_order_count",
    "rolling_24_hour_order_count",
)
BASELINE_FEATURES = (
    "zone_id", "hour", "weekday", "is_weekend", "month", "lag_1", "lag_24", "lag_7_day",
)
LEGACY_FEATURES = ("pickup_hour", "weekday", "day", "is_weekend", "pickup_location_id")


# Leaf-wise growth; the default settings are those of the forecast, level by level.
BASELINE_BOOST = BoostSettings(
    rounds=100, max_depth=None, leaves=31, step=0.1, min_leaf=20, penalty=0.0, row_share=1.0,
    column_share=1.0,
)
LEGACY_FOREST = ForestSettings(trees=120, min_leaf=3, max_depth=14)


def forecast_features(panel: DataFrame) -> DataFrame:
    """Lags, trailing means and calendar; the first row of each zone drops out."""
    lags = ("lag_1_hour_order_count", "lag_24_hour_order_count", "lag_7_day_order_count")
    table = rolling_means(demand_lags(panel, lags)).withColumn("month", F.month("trip_date"))
    kept = table.where(F.col(lags[0]).isNotNull())
    filled = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in FORECAST_FEATURES[5:]
    }
    return kept.withColumns(filled)


def baseline_features(panel: DataFrame) -> DataFrame:
    table = demand_lags(panel, ("lag_1", "lag_24", "lag_7_day"))
    return table.withColumn("month", F.month("trip_date")).where(F.col("lag_1").isNotNull())


def chrono_cutoff(table: DataFrame, share: float = 0.8):
    """Scalar with the exact quantile of the row dates, as epoch seconds.

    Rows collapse to one count per day first, so the quantile state is one entry
    per calendar day.
    """
    days = table.groupBy("trip_date").agg(F.count(F.lit(1)).alias("n"))
    second = F.unix_seconds(F.col("trip_date").cast("timestamp"))
    return days.agg(F.percentile(second, share, F.col("n")).alias("cutoff")).scalar()


def chrono_split(table: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: dates up to the cutoff train, later dates test."""
    second = F.unix_seconds(F.col("trip_date").cast("timestamp"))
    return table.withColumn("is_train", second <= chrono_cutoff(table, share))


def split_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("trip_date").alias("first_date"),
        F.max("trip_date").alias("last_date"),
        F.sum("order_count").alias("orders"),
    )


def with_errors(predicted: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Clip predictions at zero and add the signed and absolute error."""
    return predicted.withColumn(
        "predicted_order_count", F.greatest(F.col(prediction).cast("double"), F.lit(0.0))
    ).withColumns(
        {
            "prediction_error": F.col(actual) - F.col("predicted_order_count"),
            "abs_prediction_error": F.abs(F.col(actual) - F.col("predicted_order_count")),
        }
    )


def error_metrics(scored: DataFrame, actual: str = "order_count") -> DataFrame:
    """MAE, RMSE, MAPE (actual floored at 1) and R2 of the test rows, with date ranges."""
    test = ~F.col("is_train")
    error = F.when(test, F.col("prediction_error"))
    target = F.when(test, F.col(actual).cast("double"))
    return scored.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error / F.greatest(target, F.lit(1.0)))).alias("mape"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(target) * F.count(target))).alias(
            "r2_score"
        ),
        F.min(F.when(~test, F.col("trip_date"))).alias("train_start_date"),
        F.max(F.when(~test, F.col("trip_date"))).alias("train_end_date"),
        F.min(F.when(test, F.col("trip_date"))).alias("test_start_date"),
        F.max(F.when(test, F.col("trip_date"))).alias("test_end_date"),
    )


@dataclass
class Forecast:
    """Predictions on train and test rows, and the importance of each feature."""

    scored: DataFrame
    importance: DataFrame


def fit_forecast(
    panel: DataFrame,
    model: str,
    forest: ForestSettings = ForestSettings(),
    boost: BoostSettings = BoostSettings(),
) -> Forecast:
    """Train on the earlier dates, score everything."""
    table = materialize(chrono_split(forecast_features(panel)), "forecast")
    train = table.where("is_train")
    if train.isEmpty() or table.where(~F.col("is_train")).isEmpty():
        raise ValueError("forecast requires a chronological holdout window")
    if model == "gradient_boosting":
        boosted = fit_boosted(train, FORECAST_FEATURES, "order_count", boost)
        predicted, weights = boosted.predict(table), boosted.importance
    else:
        fitted = fit_forest(train, FORECAST_FEATURES, "order_count", forest)
        # Results read the predictions several times.
        predicted = materialize(fitted.predict(table), "forest-scored")
        weights = fitted.importance
    scored = with_errors(predicted, "order_count", "prediction").drop("prediction")
    rows = [(model, name, float(weight)) for name, weight in zip(FORECAST_FEATURES, weights)]
    importance = panel.sparkSession.createDataFrame(
        rows, "model_name string, feature string, importance double"
    ).orderBy(F.col("importance").desc(), "feature")
    return Forecast(scored, importance)


def forecast_metrics(forecast: Forecast, model: str) -> DataFrame:
    return error_metrics(forecast.scored).select(F.lit(model).alias("model_name"), "*")


def forecast_predictions(forecast: Forecast) -> DataFrame:
    """Holdout rows in published form."""
    return forecast.scored.where(~F.col("is_train")).select(
        F.col("trip_date").alias("date"), "hour", F.col("zone_name").alias("pickup_zone"),
        F.col("order_count").alias("actual_order_count"), "predicted_order_count",
        "prediction_error", "abs_prediction_error",
    )


def naive_forecast(panel: DataFrame) -> DataFrame:
    """Chronological split scored by the one-row lag, a reproducible yardstick."""
    return with_errors(
        chrono_split(forecast_features(panel)), "order_count", "lag_1_hour_order_count"
    )


def demand_gap(table: DataFrame, prediction: str) -> DataFrame:
    """Post-policy gap between the no-policy prediction and the actual orders."""
    predicted = F.greatest(F.col(prediction).cast("double"), F.lit(0.0))
    return (
        table.where("post_policy")
        .withColumn("predicted_counterfactual_order_count", predicted)
        .withColumn("actual_order_count", F.col("order_count"))
        .withColumn(
            "demand_gap",
            F.col("predicted_counterfactual_order_count") - F.col("actual_order_count"),
        )
        .select(
            "zone_id", "zone_name", F.col("trip_date").alias("date"), "hour",
            "actual_order_count", "predicted_counterfactual_order_count", "demand_gap",
            F.try_divide("demand_gap", "predicted_counterfactual_order_count").alias(
                "demand_gap_rate"
            ),
        )
    )


def seasonal_naive_gap(panel: DataFrame) -> DataFrame:
    """Demand gap against the 168-row lag: the model-free form of the baseline."""
    return demand_gap(baseline_features(panel), "lag_7_day")


@dataclass
class Counterfactual:
    """Gaps of the post-policy rows, metrics of both periods, and all rows with prediction."""

    predictions: DataFrame
    metrics: DataFrame
    scored: DataFrame


def fit_counterfactual(panel: DataFrame, boost: BoostSettings = BASELINE_BOOST) -> Counterfactual:
    """Boosted trees trained on pre-policy rows only, applied to the post-policy rows."""
    table = materialize(baseline_features(panel), "baseline")
    train = table.where(~F.col("post_policy"))
    if train.isEmpty() or table.where("post_policy").isEmpty():
        raise ValueError("the baseline needs rows before and after the policy")
    fitted = fit_boosted(train, BASELINE_FEATURES, "order_count", boost)
    scored = materialize(fitted.predict(table), "baseline-scored")
    gaps = demand_gap(scored, "prediction")
    error = F.when(~F.col("post_policy"), F.col("order_count") - F.col("prediction"))
    post_gap = F.when(
        F.col("post_policy"), F.greatest("prediction", F.lit(0.0)) - F.col("order_count")
    )
    metrics = scored.agg(
        F.avg(F.abs(error)).alias("MAE_pre_policy"),
        F.sqrt(F.avg(error * error)).alias("RMSE_pre_policy"),
        F.avg(post_gap).alias("mean_post_policy_demand_gap"),
    )
    return Counterfactual(gaps, metrics, scored)


def legacy_features(zone_hourly: DataFrame) -> DataFrame:
    """Calendar and zone features of the zone-hour demand table, missing rows removed."""
    table = zone_hourly.dropna(
        subset=["pickup_date", "pickup_hour", "pickup_location_id", "trip_count", "pickup_borough"]
    )
    return table.select(
        "pickup_hour",
        F.weekday("pickup_date").alias("weekday"),
        F.dayofmonth("pickup_date").alias("day"),
        (F.weekday("pickup_date") >= 5).cast("int").alias("is_weekend"),
        "pickup_location_id", "pickup_borough", "trip_count",
        F.to_date("pickup_date").alias("trip_date"),
    )


def legacy_split(features: DataFrame, seed: int = 42, holdout: float = 0.2) -> DataFrame:
    """Adds ``is_train`` by the md5 of date, hour and zone: the same rows in every run."""
    name = F.concat_ws("|", F.col("trip_date").cast("string"), "pickup_hour",
                       "pickup_location_id", F.lit(seed))
    place = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 1_000_000
    return features.withColumn("is_train", place >= int(holdout * 1_000_000))


def fit_legacy_demand(
    zone_hourly: DataFrame, forest: ForestSettings = LEGACY_FOREST, holdout: float = 0.2
) -> DataFrame:
    """Random forest on a hash split with one-hot boroughs; one row of holdout metrics."""
    split = materialize(
        legacy_split(legacy_features(zone_hourly), forest.seed, holdout), "legacy"
    )
    stages = [
        StringIndexer(inputCol="pickup_borough", outputCol="borough_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="borough_index", outputCol="borough_vector"),
    ]
    encoder = Pipeline(stages=stages).fit(split.where("is_train"))
    boroughs = [f"borough_{k}" for k in range(len(encoder.stages[0].labels))]
    encoded = encoder.transform(split).withColumns(
        {name: vector_to_array("borough_vector")[k] for k, name in enumerate(boroughs)}
    )
    wide = materialize(encoded.drop("borough_vector", "borough_index"), "legacy-encoded")
    fitted = fit_forest(
        wide.where("is_train"), [*LEGACY_FEATURES, *boroughs], "trip_count", forest
    )
    scored = with_errors(fitted.predict(wide), "trip_count", "prediction").withColumn(
        "prediction_error", F.col("trip_count") - F.col("prediction")
    )
    rows = split.agg(F.count(F.lit(1)).alias("n")).scalar()
    return error_metrics(scored, "trip_count").select(
        rows.alias("rows"), "mae", "rmse", F.col("r2_score").alias("r2")
    )


def beats_yardstick(
    scored: DataFrame, rows, actual: str, yardstick: str, prediction: str = "predicted_order_count"
) -> DataFrame:
    """Mean absolute error of a yardstick column on ``rows``, and whether the predictions have
    a smaller one and none below zero."""
    test = scored.where(rows)
    return test.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(F.col(actual) - F.greatest(F.col(yardstick).cast("double"), F.lit(0.0)))).alias(
            "yardstick_mae"
        ),
        (
            F.avg(F.abs(F.col(actual) - F.col(prediction)))
            < F.avg(F.abs(F.col(actual) - F.greatest(F.col(yardstick).cast("double"), F.lit(0.0))))
        ).alias("better"),
        (F.min(prediction) >= 0).alias("not_negative"),
    )


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("rmse", "model_name").limit(1)

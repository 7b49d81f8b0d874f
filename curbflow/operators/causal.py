"""Fixed-effects difference-in-differences and weekly event studies.

The regression never collects the panel. Rows collapse exactly to cells (zone,
hour, weekday, period) per metric, the zone effect is partialled out by zone means
(Frisch-Waugh), each partition adds its cells into a small Gram matrix, and the
sums are solved per metric inside a task. Only matrices of about 33 x 33 numbers
per metric leave a partition, whatever the number of trips or zones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import label_map
from curbflow.labels import DID_COLLINEAR, DID_NO_VARIATION
from curbflow.session import materialize, ship_to_workers
from curbflow.spec import PolicySpec

ship_to_workers(__name__)

DID_METRICS = (
    "log_order_count", "avg_fare_per_mile", "avg_driver_pay_per_minute", "avg_response_time_min",
)
EVENT_METRICS = ("log_order_count", "avg_fare_per_mile", "avg_driver_pay_per_minute")
COMPARED = ("treated_zones", "control_zones")
Z_95 = 1.959963984540054  # 97.5 % point of the standard normal
HOURS, WEEKDAYS = 24, 7
# Design after the zone effect is absorbed: interaction, post, hour and weekday levels.
WIDTH = 2 + HOURS + WEEKDAYS
MEANS = [f"m{i}" for i in range(WIDTH)]  # zone means of the design columns


def did_cells(panel: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Exact collapse of the panel: count, sum and sum of squares per cell and metric."""
    present = [m for m in metrics if m in panel.columns]
    rows = panel.where(F.col("zone_group").isin(*COMPARED)).select(
        "zone_id", "hour", "weekday",
        (F.col("zone_group") == COMPARED[0]).cast("int").alias("treated"),
        F.col("post_policy").cast("int").alias("post"),
        *[F.col(m).cast("double").alias(m) for m in present],
    )
    long = rows.unpivot(
        ["zone_id", "hour", "weekday", "treated", "post"], present, "metric_name", "y"
    ).where(F.col("y").isNotNull())
    return long.groupBy("metric_name", "zone_id", "treated", "post", "hour", "weekday").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("y_mean"),
        F.var_pop("y").alias("y_var"),
    )


def did_cell_means(panel: DataFrame, metrics: Sequence[str] = DID_METRICS) -> DataFrame:
    """Mean outcome of treated/control before/after, and the unadjusted 2x2 estimate."""
    cells = did_cells(panel, metrics)

    def mean(treated: int, post: int):
        inside = (F.col("treated") == treated) & (F.col("post") == post)
        total = F.sum(F.when(inside, F.col("n") * F.col("y_mean")))
        return F.try_divide(total, F.sum(F.when(inside, F.col("n"))))

    return (
        cells.groupBy("metric_name")
        .agg(
            F.sum("n").alias("n_observations"),
            mean(1, 1).alias("treated_post"),
            mean(1, 0).alias("treated_pre"),
            mean(0, 1).alias("control_post"),
            mean(0, 0).alias("control_pre"),
        )
        .withColumn(
            "unadjusted_effect",
            (F.col("treated_post") - F.col("treated_pre"))
            - (F.col("control_post") - F.col("control_pre")),
        )
    )


def _design(batch: pd.DataFrame) -> np.ndarray:
    """Dense rows of the design, minus their zone means."""
    n = len(batch)
    x = np.zeros((n, WIDTH))
    post = batch["post"].to_numpy(float)
    x[:, 0] = batch["treated"].to_numpy(float) * post
    x[:, 1] = post
    rows = np.arange(n)
    x[rows, 2 + batch["hour"].to_numpy(int)] = 1.0
    x[rows, 2 + HOURS + batch["weekday"].to_numpy(int)] = 1.0
    return x - batch[MEANS].to_numpy(float)


def _partial_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and metric: X'WX and X'Wy of the demeaned cells, row-major."""
    for batch in batches:
        for metric, part in batch.groupby("metric_name"):
            x = _design(part)
            weight = part["n"].to_numpy(float)
            y = part["y_mean"].to_numpy() - part["y_bar"].to_numpy()
            left = x.T * weight
            values = np.concatenate([(left @ x).ravel(), left @ y])
            yield pd.DataFrame(
                {"metric_name": metric, "position": np.arange(len(values)), "value": values}
            )


def _partial_meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and metric: sum of x x' times the squared residuals of the cell."""
    for batch in batches:
        for metric, part in batch.groupby("metric_name"):
            x = _design(part)
            n = part["n"].to_numpy(float)
            fitted = x @ np.asarray(part["beta"].iloc[0])
            gap = part["y_mean"].to_numpy() - part["y_bar"].to_numpy() - fitted
            squares = n * part["y_var"].to_numpy() + n * gap**2
            values = ((x.T * squares) @ x).ravel()
            yield pd.DataFrame(
                {"metric_name": metric, "position": np.arange(len(values)), "value": values}
            )


def _matrix_sums(parts: DataFrame) -> DataFrame:
    """Element-wise sums of the partial matrices, one ordered array per metric."""
    summed = parts.groupBy("metric_name", "position").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return summed.groupBy("metric_name").agg(
        F.transform(ordered, lambda item: item["value"]).alias("values")
    )


def _gram(values: np.ndarray) -> np.ndarray:
    gram = values[: WIDTH * WIDTH].reshape(WIDTH, WIDTH)
    return (gram + gram.T) / 2


def unidentified(values: np.ndarray) -> str | None:
    """Why the interaction coefficient cannot be told from the other columns, if so.

    What is left of the interaction after projecting out all other design columns is the
    Schur complement of its norm in the Gram matrix.
    """
    gram = _gram(values)
    own = gram[0, 0]
    if own <= 1e-10:
        return DID_NO_VARIATION
    others = np.linalg.pinv(gram[1:, 1:], rcond=1e-10, hermitian=True)
    rest = own - gram[0, 1:] @ others @ gram[1:, 0]
    return DID_COLLINEAR if rest <= 1e-8 * own else None


def _inverse(values: np.ndarray) -> tuple[np.ndarray, int]:
    gram = _gram(values)
    spectrum = np.linalg.eigvalsh(gram)
    tolerance = max(abs(spectrum).max(), 1.0) * 1e-10
    rank = int((spectrum > tolerance).sum())
    return np.linalg.pinv(gram, rcond=1e-10, hermitian=True), rank


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples():
            values = np.asarray(row.values, dtype=float)
            inverse, rank = _inverse(values)
            out.append(
                {
                    "metric_name": row.metric_name,
                    "beta": (inverse @ values[WIDTH * WIDTH :]).tolist(),
                    # weights of the interaction coefficient in the sandwich
                    "selector": inverse[0].tolist(),
                    "rank": rank,
                    "reason": unidentified(values),
                }
            )
        if out:
            yield pd.DataFrame(out)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples():
            meat = np.asarray(row.values, dtype=float).reshape(WIDTH, WIDTH)
            selector = np.asarray(row.selector)
            freedom = row.n_observations - row.zones - row.rank
            variance = selector @ meat @ selector * row.n_observations / max(freedom, 1)
            error = math.sqrt(max(variance, 0.0))
            coef = row.beta[0]
            z = abs(coef) / error if error > 0 else math.inf
            estimates = {
                "coef_treated_post": coef,
                "std_error": error,
                "p_value": math.erfc(z / math.sqrt(2)),
                "confidence_interval_low": coef - Z_95 * error,
                "confidence_interval_high": coef + Z_95 * error,
            }
            if row.reason is not None:
                estimates = dict.fromkeys(estimates)
            out.append(
                {
                    "metric_name": row.metric_name,
                    **estimates,
                    "n_observations": int(row.n_observations),
                    "not_identified": row.reason,
                }
            )
        if out:
            yield pd.DataFrame(out)


PART_SCHEMA = "metric_name string, position int, value double"


def did_fixed_effects(
    panel: DataFrame, metrics: Sequence[str] = DID_METRICS, min_rows: int = 20
) -> DataFrame:
    """Treated x post coefficient with zone, hour and weekday effects and HC1 errors.

    Metrics that are absent from the panel, or have no more than ``min_rows``
    values, are skipped. A metric whose coefficient the panel cannot identify keeps its row,
    with NULL estimates and the reason in ``not_identified``. p-values and intervals use the normal distribution.
    """
    present = [m for m in metrics if m in panel.columns]
    filled = panel.agg(F.struct(*[F.count(m).alias(m) for m in present]).alias("n")).scalar()
    enough = F.lit(False)
    for metric in present:
        enough = enough | ((F.col("metric_name") == metric) & (filled[metric] > min_rows))
    # Four consumers read the cells; a written table spares them the panel.
    cells = materialize(did_cells(panel, present).where(enough), "cells")

    indicators = ["treated * post", "post"]
    indicators += [f"int(hour = {h})" for h in range(HOURS)]
    indicators += [f"int(weekday = {d})" for d in range(WEEKDAYS)]
    # A zone has at most 24 x 7 x 2 cells, so centring is a window and not a join.
    zone = Window.partitionBy("metric_name", "zone_id")
    size = F.sum("n").over(zone)

    def zone_mean(value: str):
        return F.sum(F.expr(f"n * ({value})")).over(zone) / size

    centred = cells.withColumns(
        {"y_bar": zone_mean("y_mean")} | {m: zone_mean(x) for m, x in zip(MEANS, indicators)}
    )
    gram = _matrix_sums(centred.mapInPandas(_partial_gram, PART_SCHEMA))
    fit = gram.mapInPandas(
        _solve,
        "metric_name string, beta array<double>, selector array<double>, rank int, "
        "reason string",
    )
    meat = _matrix_sums(
        centred.join(fit.select("metric_name", "beta"), "metric_name").mapInPandas(
            _partial_meat, PART_SCHEMA
        )
    )
    sizes = cells.groupBy("metric_name", "zone_id").agg(F.sum("n").alias("n")).groupBy(
        "metric_name"
    ).agg(F.sum("n").alias("n_observations"), F.count(F.lit(1)).alias("zones"))
    results = (
        meat.join(fit, "metric_name")
        .join(sizes, "metric_name")
        .mapInPandas(
            _finish,
            "metric_name string, coef_treated_post double, std_error double, p_value double, "
            "confidence_interval_low double, confidence_interval_high double, "
            "n_observations bigint, not_identified string",
        )
    )
    demand = F.col("metric_name") == "log_order_count"
    return results.withColumn(
        "business_interpretation", F.when(demand, L.DID_DEMAND).otherwise(L.DID_OTHER)
    )


def did_intervals(results: DataFrame) -> DataFrame:
    """Chart form of the estimates: symmetric arm and the two interval arms."""
    coef = F.col("coef_treated_post")
    return results.select(
        "metric_name",
        label_map("metric_name", L.METRIC_LABELS).alias("metric_label"),
        "coef_treated_post",
        (F.lit(1.96) * F.col("std_error")).alias("error_arm"),
        (F.col("confidence_interval_high") - coef).alias("arm_high"),
        (coef - F.col("confidence_interval_low")).alias("arm_low"),
    )


def event_week(day: str, start: date, before: int, after: int):
    """Weeks since the policy start, floored (also before it) and clipped to the window."""
    weeks = F.floor(F.datediff(F.col(day), F.lit(start)) / 7)
    return F.greatest(F.least(weeks, F.lit(after)), F.lit(-before)).cast("int")


def event_study(
    panel: DataFrame, spec: PolicySpec, metrics: Sequence[str] = EVENT_METRICS
) -> DataFrame:
    """Weekly treated-control gap relative to week -1, or to the first week without it.

    ``std_error`` pools both groups, as published; ``gap_std_error`` is the error of
    the gap itself.
    """
    week = event_week("trip_date", spec.start_date, spec.weeks_before, spec.weeks_after)
    long = (
        panel.where(F.col("zone_group").isin(*COMPARED))
        .select(
            week.alias("event_week"), "zone_group",
            *[F.col(m).cast("double").alias(m) for m in metrics],
        )
        .unpivot(["event_week", "zone_group"], list(metrics), "metric_name", "y")
    )
    # All metrics but the order count drop their missing rows before the weeks form.
    kept = long.where(F.col("y").isNotNull() | (F.col("metric_name") == "log_order_count"))
    treated = F.when(F.col("zone_group") == COMPARED[0], F.col("y"))
    control = F.when(F.col("zone_group") == COMPARED[1], F.col("y"))

    def squared_error(value):
        return F.try_divide(F.var_samp(value), F.count(value))

    weekly = kept.groupBy("metric_name", "event_week").agg(
        (F.avg(treated) - F.avg(control)).alias("gap"),
        F.coalesce(
            F.try_divide(F.stddev_samp("y"), F.sqrt(F.count("y"))), F.lit(0.0)
        ).alias("std_error"),
        F.sqrt(squared_error(treated) + squared_error(control)).alias("gap_std_error"),
    )
    weeks = Window.partitionBy("metric_name")
    before = F.col("event_week") == -1
    has_reference = F.max(before).over(weeks)
    reference = F.when(
        has_reference, F.max(F.when(before, F.col("gap"))).over(weeks)
    ).otherwise(F.first("gap").over(weeks.orderBy("event_week")))
    effect = weekly.withColumn("estimated_effect", F.col("gap") - reference)
    return effect.select(
        "event_week",
        "metric_name",
        "estimated_effect",
        "std_error",
        (F.col("estimated_effect") - 1.96 * F.col("std_error")).alias("ci_low"),
        (F.col("estimated_effect") + 1.96 * F.col("std_error")).alias("ci_high"),
        "gap_std_error",
    )

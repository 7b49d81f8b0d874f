"""Column builders: time, cuts, guarded ratios and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def micros_sql(start: str, end: str) -> str:
    """Microseconds from ``start`` to ``end`` (naive timestamps, UTC session)."""
    return f"(unix_micros(CAST({end} AS TIMESTAMP)) - unix_micros(CAST({start} AS TIMESTAMP)))"


def minutes_sql(start: str, end: str) -> str:
    return f"{micros_sql(start, end)} / {MICROS_PER_MINUTE}D"


def clean_double(column: Column) -> Column:
    """Double or NULL; unparsable text and NaN both become NULL.

    Spark orders NaN above every number, so a NaN left in place would pass
    upper-bound rules that must ignore missing values.
    """
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def cut(column: str | Column, cuts: tuple[Sequence, Sequence[str]]) -> Column:
    """Label of the right-closed interval (a, b] that holds the value, else NULL."""
    value = F.col(column) if isinstance(column, str) else column
    edges, labels = cuts
    result = F.when(value <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=True):
        inside = value.isNotNull() if upper is None else value <= upper
        result = result.when(inside, label)
    return result


def cut_rank(column: str, cuts: tuple[Sequence, Sequence[str]]) -> Column:
    """Position of a label in its cut set, for ordered output."""
    return F.array_position(F.array(*[F.lit(x) for x in cuts[1]]), F.col(column))


def label_map(column: str, labels: dict[str, str]) -> Column:
    """Translate known codes and keep unknown ones."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def rate_change(post: str | Column, pre: str | Column) -> Column:
    """(post - pre) / pre, NULL when the base is zero or missing."""
    post = F.col(post) if isinstance(post, str) else post
    pre = F.col(pre) if isinstance(pre, str) else pre
    return F.try_divide((post - pre).cast("double"), pre.cast("double"))


def is_true(condition: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def zero(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(0.0))


def hour_window(hour: str) -> Column:
    """Four-hour operating window that starts at ``hour``."""
    from curbflow.labels import NO_HOUR

    start = F.col(hour).cast("int")
    text = F.format_string("%02d:00-%02d:00", start, F.pmod(start + 4, F.lit(24)))
    return F.when(start.isNull(), NO_HOUR).otherwise(text)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"):
    """Equi-join on keys where NULL matches NULL; keeps the left copy of the keys."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = None
    for key in keys:
        match = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])

"""One value format for both engines, so that result hashes can be compared.

Doubles are rounded to six digits, those below 0.001 to ten, integers widen to 64 bits,
dates and timestamps become ISO text. Operators themselves return unrounded, typed columns.

Money columns often end exactly on half a unit of the sixth digit, where the last
bit of a sum decides the rounding. A fixed shift far below one unit, added in both
engines, moves such values off the tie.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame

DIGITS = 6
SMALL, SMALL_DIGITS = 1e-3, 10  # p-values and fee burdens keep their leading digits
TIE_SHIFT = 1.7320508e-8
# Columns of the given tables that the oracle SQL reads.
TABLE_COLUMNS = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP, o_totalprice DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE",
    "part": "p_partkey BIGINT",
    "documents": "doc_id BIGINT",
    "embeddings": "vec_id BIGINT",
    "pages": "page_id BIGINT",
    "benchmark": "item_id BIGINT",
    "labels": "doc_id BIGINT",
    "conversations": "conv_id BIGINT",
}


def canonical(df: DataFrame) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        value = f"`{name}`"
        if kind in ("double", "float") or kind.startswith("decimal"):
            value = f"double({value})"
            value = (
                f"CASE WHEN abs({value}) < {SMALL!r}D THEN round({value} + {TIE_SHIFT * 1e-4!r}D,"
                f" {SMALL_DIGITS}) ELSE round({value} + {TIE_SHIFT!r}D, {DIGITS}) END + 0D"
            )
        elif kind in ("int", "smallint", "tinyint"):
            value = f"bigint({value})"
        elif kind == "date":
            value = f"date_format({value}, 'yyyy-MM-dd')"
        elif kind.startswith("timestamp"):
            value = f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        columns.append(f"{value} AS `{name}`")
    return df.selectExpr(*columns)


@cache
def _empty_tables():
    import duckdb

    connection = duckdb.connect()
    for name, columns in TABLE_COLUMNS.items():
        connection.execute(f"CREATE TABLE {name} ({columns})")
    return connection


def canonical_sql(query: str) -> str:
    """Wrap oracle SQL in the same formats; column types come from empty tables."""
    described = _empty_tables().execute(f"DESCRIBE {query}").fetchall()
    changes = []
    for name, kind, *_ in described:
        quoted = f'"{name}"'
        if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
            value = f"CAST({quoted} AS DOUBLE)"
            value = (
                f"CASE WHEN abs({value}) < {SMALL!r} THEN round({value} + {TIE_SHIFT * 1e-4!r},"
                f" {SMALL_DIGITS}) ELSE round({value} + {TIE_SHIFT!r}, {DIGITS}) END + 0e0"
            )
        elif kind in ("HUGEINT", "INTEGER", "SMALLINT", "TINYINT", "UBIGINT"):
            value = f"CAST({quoted} AS BIGINT)"
        elif kind == "DATE":
            value = f"strftime({quoted}, '%Y-%m-%d')"
        elif kind.startswith("TIMESTAMP"):
            value = f"strftime({quoted}, '%Y-%m-%d %H:%M:%S.%f')"
        else:
            continue
        changes.append(f"{value} AS {quoted}")
    replace = f" REPLACE ({', '.join(changes)})" if changes else ""
    return f"SELECT *{replace} FROM ({query})"

"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL for DuckDB.

Computed doubles are rounded to ``DIGITS`` decimals on both sides: sums in another order differ behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
_VIEWS = {"cube": [fx.CUBE_SQL], "obs": [fx.OBS_SQL], "tile_px": [fx.TILE_SQL], "product_index": [fx.CUBE_SQL, fx.INDEX_SQL]}


def gapfill_sql(name: str, source: str, targets: str, band: str, keys: str = "site px sensor") -> str:
    """Common table ``name`` with ``band`` of ``source`` (clear rows alone) interpolated at the rows of ``targets``."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split())
    ks = ", ".join(f"t.{k}" for k in keys.split())
    return f"""{name} AS (SELECT {ks}, t.doy, CASE WHEN n.doy IS NULL THEN a.{band} WHEN a.doy IS NULL OR n.doy = t.doy THEN n.{band}
        ELSE a.{band} + (n.{band} - a.{band}) * (t.doy - a.doy) / (n.doy - a.doy)::DOUBLE END AS {band}
        FROM {targets} t ASOF LEFT JOIN {source} a ON {on("t", "a")} AND t.doy > a.doy ASOF LEFT JOIN {source} n ON {on("t", "n")} AND t.doy <= n.doy)"""


def query(name: str, sql: str | None = None, doubles: str = "", views: str = "cube") -> Callable[[Query], Query]:
    """Register a query. ``sql`` ends with the common table ``q``; ``doubles`` names its computed columns.

    A name may end in ``:digits``: more of them where values are small, so that no value lies on a half.
    """
    digits = {n.partition(":")[0]: int(n.partition(":")[2] or DIGITS) for n in doubles.split()}

    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            # adding zero makes a negative zero positive
            return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()}) if digits else df

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            fixtures = list(dict.fromkeys(s for v in views.split() for s in _VIEWS[v]))
            replace = f" REPLACE ({', '.join(f'round({c}, {d}) + 0.0 AS {c}' for c, d in digits.items())})" if digits else ""
            ORACLE[name] = "WITH " + ",\n".join([*fixtures, sql.strip()]) + f"\nSELECT *{replace} FROM q"
        return fn

    return keep

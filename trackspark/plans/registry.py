"""Query registry: name -> (DataFrame function, SQL for the check)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def _rounding(spec: str) -> dict[str, int]:
    """"a b:4" -> {a: 6, b: 4}."""
    return {p.split(":")[0]: int(p.split(":")[1]) if ":" in p else 6 for p in spec.split()}


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    # a rounded zero loses its sign, or -0.0 and 0.0 would differ
    return df.withColumns({c: F.when(F.round(c, d) == 0, F.lit(0.0)).otherwise(F.round(c, d)) for c, d in digits.items()})


def query(name: str, ids: str, sql: str | None = None, rnd: str = ""):
    """Register a query; ``ids`` are the operators it covers, ``rnd`` the double columns rounded on both sides."""
    digits = _rounding(rnd)

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: _rounded(fn(spark, sf_dir), digits)
        IDS[name] = ids
        if sql is not None:
            # every step is computed once, however often it is used
            text = re.sub(r"\b(\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", sql)
            cols = ", ".join(
                f"CASE WHEN ROUND({c}, {d}) = 0 THEN CAST(0 AS DOUBLE) ELSE ROUND({c}, {d}) END AS {c}"
                for c, d in digits.items())
            ORACLES[name] = f"SELECT * REPLACE ({cols}) FROM ({text}) AS checked" if cols else text
        return fn

    return register

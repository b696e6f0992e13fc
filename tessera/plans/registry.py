"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Common tables that the checking SQL names as $NAME.
CTE = {
    "PW": """p AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, p_brand AS asset,
  ROUND(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / COUNT(*)) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "PD": """t_ AS (SELECT CAST(l_shipdate AS DATE) AS dt, l_linenumber AS asset, ROUND(l_extendedprice * 100) AS price, l_quantity AS volume,
  row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem),
d AS (SELECT dt, asset, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(volume) AS volume FROM t_ GROUP BY 1, 2)""",
    "PH": """h AS (SELECT date_trunc('hour', ts) AS dt, event_type AS asset, ROUND(SUM(CAST(ROUND(value * 100) AS BIGINT)) / COUNT(*)) AS close FROM events WHERE value > 0 GROUP BY 1, 2)""",
    "RT": """rt AS (SELECT l_linenumber AS cur, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) + INTERVAL 1 MONTH AS DATE) AS valid_from,
  SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) / COUNT(*) / 100 AS rate FROM lineitem GROUP BY 1, 2)""",
    "R": "r AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM p)",
    "F": "f AS (SELECT *, lead(ret) OVER (PARTITION BY asset ORDER BY dt) AS fwd FROM r)",
}


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = re.sub(r"\$(\w+)", lambda m: CTE[m[1]], sql)
            return f

        return add

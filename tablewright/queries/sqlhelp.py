"""Small helpers to write the DuckDB oracle texts."""

from __future__ import annotations

DIRTY_CTE = """base AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 50 = 7 THEN 'bad'
         ELSE CAST(o_custkey AS VARCHAR) END AS num_text,
    CASE WHEN o_orderkey % 25 = 0 THEN NULL WHEN o_orderkey % 90 = 11 THEN 'unknown'
         ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS date_text,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderpriority END AS category,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 5 THEN o_totalprice * 10
         ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_orderstatus END AS sparse,
    o_orderkey % 3 = 0 AS flag
  FROM orders),
dirty_orders AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 100 = 1)"""

DIRTY_COLS = ["o_orderkey", "num_text", "date_text", "category", "amount", "sparse", "flag"]
DIRTY_NUMERIC = ["o_orderkey", "amount", "flag"]
DIRTY_TEXT = ["num_text", "date_text", "category", "sparse"]

# Same gates as tablewright.functions.parse, written for DuckDB.
NUM_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def with_dirty(*ctes: str) -> str:
    parts = [DIRTY_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n"


def parse_num_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUM_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def parse_date_sql(x: str) -> str:
    """Only the layouts that occur in the fixtures: ISO dates, bare years in
    1678..2261 and yyyyMMdd; anything else that is all digits is no date."""
    t = f"trim({x})"
    return (f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}$') THEN "
            f"CASE WHEN CAST({t} AS INTEGER) BETWEEN 1678 AND 2261 THEN make_timestamp(CAST({t} AS INTEGER), 1, 1, 0, 0, 0) END "
            f"WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN try_strptime({t}, '%Y%m%d') "
            f"WHEN regexp_matches({t}, '^[0-9]+$') THEN NULL "
            f"ELSE COALESCE(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime({t}, '%Y/%m/%d'), try_strptime({t}, '%m/%d/%Y'), try_strptime({t}, '%d/%m/%Y')) END")


def as_double_sql(c: str, boolean: bool = False) -> str:
    return f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if boolean else f"CAST({c} AS DOUBLE)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)

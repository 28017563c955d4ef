"""SQL text for the oracle side: derived inputs as CTEs and small generators.

These strings run on DuckDB over the same parquet tables; they are written
independently of the Spark code and only share the fixed rules.
"""

from __future__ import annotations

PEOPLE = """
base AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer),
people AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE c_custkey % 10 = 0)
"""

MEASURES = """
measures AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
             FROM lineitem)
"""

PRICED = """
priced AS (SELECT l_quantity, l_extendedprice, l_discount,
                  l_extendedprice * (1 - l_discount) AS revenue,
                  l_extendedprice * l_discount AS saving,
                  1 - l_discount AS kept_share
           FROM lineitem)
"""

ODD_FLOATS = """
odd AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE
              WHEN l_linenumber = 6 THEN 'inf'::DOUBLE
              WHEN l_linenumber = 5 THEN '-inf'::DOUBLE
              ELSE l_discount END AS l_discount,
         l_returnflag
  FROM lineitem)
"""

DIRTY_ORDERS = """
dirty AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS custkey_text,
         CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
         CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date_text
  FROM orders)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def histogram_sql(src: str, cols: list[str]) -> str:
    """numpy.histogram bins per column: n = least(12, distinct), edges
    lo + i*step (last = hi), guess corrected against the edges."""
    parts = []
    for c in cols:
        e = lambda i: f"(CASE WHEN {i} >= nb THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END)"
        i0 = "least(CAST(floor((x - lo) * norm) AS BIGINT), nb - 1)"
        i1 = f"(CASE WHEN x < {e(i0)} THEN {i0} - 1 ELSE {i0} END)"
        binx = f"(CASE WHEN x >= {e(f'({i1} + 1)')} AND {i1} <> nb - 1 THEN {i1} + 1 ELSE {i1} END)"
        parts.append(f"""
SELECT * FROM (
  WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {src}
             WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))),
  s AS (SELECT min(x) AS lo, max(x) AS hi, least(12, count(DISTINCT x)) AS nb FROM v),
  p AS (SELECT lo, hi, nb, (hi - lo) / nb AS step, nb / (hi - lo) AS norm FROM s WHERE nb > 1),
  cnt AS (SELECT {binx} AS bin, count(*) AS n FROM v, p GROUP BY 1),
  grid AS (SELECT CAST(i AS BIGINT) AS bin,
                  CAST(i AS DOUBLE) * step + lo AS e0,
                  CASE WHEN i + 1 >= nb THEN hi ELSE CAST(i + 1 AS DOUBLE) * step + lo END AS e1
           FROM p, range(0, 12) r(i) WHERE i < nb)
  SELECT '{c}' AS "column", CAST(grid.bin AS INTEGER) AS bin,
         CAST(round(e0, 2) AS VARCHAR) || ' - ' || CAST(round(e1, 2) AS VARCHAR) AS "range",
         CAST(coalesce(cnt.n, 0) AS BIGINT) AS "count"
  FROM grid LEFT JOIN cnt ON grid.bin = cnt.bin)""")
    return "\nUNION ALL\n".join(parts)

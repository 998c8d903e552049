"""SQL of the queries here that SQL can express on whole tables."""

from __future__ import annotations

_MISSING = """('', '-', '--', '---', '?', '??', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'tbd', 'tba', 'unknown', 'not available',
 'not applicable', 'not specified', 'not known', 'unspecified', 'undefined', 'see description', 'missing')"""
_SEGMENT = "trim(regexp_replace(lower(segment), '[\\s\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))"
_PRICED = f"""
WITH priced AS (
  SELECT price, CAST(loaded_at AS DATE) AS day, CASE WHEN {_SEGMENT} NOT IN {_MISSING} THEN {_SEGMENT} END AS segment FROM (
    SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY loaded_at DESC) AS rn FROM products WHERE parent_asin IS NOT NULL)
  WHERE rn = 1 AND price IS NOT NULL AND NOT isnan(price) AND price BETWEEN 20 AND 20000)"""
_STATS = "count(*) AS n, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.9) AS p90, quantile_cont(price, 0.99) AS p99, 0 AS rank_error"

ORACLES = {
    "p3_segment": f"{_PRICED} SELECT segment, {_STATS} FROM priced GROUP BY segment",
    "p3_day_segment": f"{_PRICED} SELECT CAST(day AS VARCHAR) AS day, segment, {_STATS} FROM priced GROUP BY day, segment",
}

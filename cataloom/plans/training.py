"""Queries of the general training-data operator (problem 1) and their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.missing import folded, known_number, known_text
from cataloom.operators.impute import Fill, fill_missing, filled_cells
from cataloom.session import latest, table

COLUMNS = ["price", "segment", "brand", "ram_gb", "cpu_family", "store"]


def _comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings, one row each, with the keys by which listings are comparable."""
    p = latest(table(spark, sf_dir, "products").withColumn("loaded", F.col("loaded_at")), "parent_asin", "loaded", [*COLUMNS, "loaded_at"])
    ram = F.when(F.col("ram_gb") >= 1024, F.col("ram_gb") / 1024).otherwise(F.col("ram_gb"))
    return p.select(
        "parent_asin",
        F.col("price").alias("raw_price"),
        F.col("segment").alias("raw_segment"),
        F.col("brand").alias("raw_brand"),
        F.date_trunc("month", "loaded_at").alias("k_month"),
        folded(known_text(F.col("brand"))).alias("k_maker"),
        folded(known_text(F.col("segment"))).alias("k_segment"),
        folded(known_text(F.col("cpu_family"))).alias("k_cpu"),
        folded(known_text(F.col("store"))).alias("k_store"),
        F.round(ram).cast("int").alias("k_ram"),
    )


@dataclass(frozen=True)
class Plan:
    """What ``fills`` and the SQL have in common."""

    column: str
    kind: str
    levels: list[tuple[str, ...]]
    min_support: int = 5


PLANS = (
    Plan("price", "median", [("k_maker", "k_cpu", "k_ram"), ("k_segment", "k_cpu", "k_ram"), ("k_segment", "k_ram", "k_month"), ("k_segment", "k_ram"), ("k_segment",), ("k_month",), ()]),
    Plan("segment", "mode", [("k_maker", "k_cpu", "k_ram"), ("k_cpu", "k_ram"), ("k_cpu",), ("k_maker",), ()]),
    Plan("brand", "mode", [("k_store",), ("k_segment", "k_cpu", "k_ram"), ("k_segment", "k_ram"), ("k_segment",), ()]),
)


def fills() -> list[Fill]:
    known = {"price": known_number(F.col("raw_price")), "segment": folded(known_text(F.col("raw_segment"))), "brand": known_text(F.trim("raw_brand"))}
    return [Fill(p.column, known[p.column], p.levels, p.kind, p.min_support) for p in PLANS]


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with price, segment and brand, what was filled in and from which level."""
    out = fill_missing(_comparable(spark, sf_dir), "parent_asin", fills())
    return out.select("parent_asin", *[c for f in ("price", "segment", "brand") for c in (f, f"{f}_filled", f"{f}_level")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(p1_filled(spark, sf_dir), "parent_asin", ["price", "segment", "brand"])


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled}

_MISSING = """('', '-', '--', '---', '?', '??', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'tbd', 'tba', 'unknown', 'not available',
 'not applicable', 'not specified', 'not known', 'unspecified', 'undefined', 'see description', 'missing')"""
_FOLD = "trim(regexp_replace(lower({c}), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"


def _fold(c: str) -> str:
    return _FOLD.format(c=c)


_KNOWN = f"""
WITH one AS (SELECT parent_asin, price, segment, brand, ram_gb, cpu_family, store, loaded_at,
  row_number() OVER (PARTITION BY parent_asin ORDER BY loaded_at DESC) AS rn FROM products WHERE parent_asin IS NOT NULL),
base AS (SELECT parent_asin,
  CASE WHEN price IS NOT NULL AND NOT isnan(price) AND price BETWEEN 20 AND 20000 THEN price END AS price,
  CASE WHEN {_fold("segment")} NOT IN {_MISSING} THEN {_fold("segment")} END AS segment,
  CASE WHEN {_fold("brand")} NOT IN {_MISSING} THEN trim(brand, ' ') END AS brand,
  date_trunc('month', loaded_at) AS k_month,
  CASE WHEN {_fold("brand")} NOT IN {_MISSING} THEN {_fold("brand")} END AS k_maker,
  CASE WHEN {_fold("segment")} NOT IN {_MISSING} THEN {_fold("segment")} END AS k_segment,
  CASE WHEN {_fold("cpu_family")} NOT IN {_MISSING} THEN {_fold("cpu_family")} END AS k_cpu,
  CASE WHEN {_fold("store")} NOT IN {_MISSING} THEN {_fold("store")} END AS k_store,
  CAST(round(CASE WHEN ram_gb >= 1024 THEN ram_gb / 1024 ELSE ram_gb END) AS INTEGER) AS k_ram
  FROM one WHERE rn = 1)"""


def _level_sql(f: Plan, at: int) -> str:
    keys = ", ".join(f.levels[at]) or "1"
    stat = f"quantile_cont({f.column}, 0.5)" if f.kind == "median" else "v"
    if f.kind == "median":
        body = f"SELECT {keys if f.levels[at] else '1 AS one'}, count(*) AS support, {stat} AS stat FROM base WHERE {f.column} IS NOT NULL GROUP BY {keys}"
    else:
        inner = f"SELECT {keys if f.levels[at] else '1 AS one'}, {f.column} AS v, count(*) AS n FROM base WHERE {f.column} IS NOT NULL GROUP BY ALL"
        outer = ", ".join(f.levels[at]) or "one"
        body = f"SELECT {outer}, sum(n) AS support, arg_min(v, (-n, v)) AS stat FROM ({inner}) GROUP BY {outer}"
    return f"SELECT * FROM ({body}) WHERE support >= {f.min_support}"


def _filled_sql() -> str:
    parts, columns, joins = [], ["base.parent_asin"], []
    for f in PLANS:
        stats, levels = [], []
        for i, keys in enumerate(f.levels):
            name = f"{f.column}_{i}"
            parts.append(f"{name} AS ({_level_sql(f, i)})")
            on = " AND ".join(f"base.{k} = {name}.{k}" for k in keys) or "true"
            joins.append(f"LEFT JOIN {name} ON {on}")
            stats.append(f"{name}.stat")
            levels.append(f"WHEN {name}.support IS NOT NULL THEN {i}")
        c = f.column
        columns += [
            f"coalesce(base.{c}, {', '.join(stats)}) AS {c}",
            f"base.{c} IS NULL AND coalesce({', '.join(stats)}) IS NOT NULL AS {c}_filled",
            f"CASE WHEN base.{c} IS NOT NULL THEN NULL {' '.join(levels)} END AS {c}_level",
        ]
    return f"{_KNOWN}, {', '.join(parts)} SELECT {', '.join(columns)} FROM base {' '.join(joins)}"


def oracles() -> dict[str, str]:
    found = " UNION ALL ".join(f"SELECT parent_asin, '{c}' AS field_name FROM base WHERE {c} IS NULL" for c in ("price", "segment", "brand"))
    return {"p1_found": f"{_KNOWN} {found}", "p1_filled": _filled_sql()}

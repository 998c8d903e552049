"""Connected components of a graph given as edges: alternating large-star and small-star.

Defined cases: self-loops and repeated edges are harmless; edges with a null end are left out; a node named by a self-loop alone is a component of
its own; an empty table gives no rows. Ids may be of any orderable type; a component is named by its smallest id.

Scale: each round is two aggregations with map-side minima and two equi-joins over edges, at most one edge a node after
the first rounds, O(log n) rounds, none where the edges already are stars; each round is written to the shared folder, so lineage stays short and lost executors cost one round.
No component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.session import staged


def _each(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(a, b) from each of ``ends`` of every edge, in one pass: a union would plan, for each of its sides, all that the edges come from."""
    pairs = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends])
    return edges.select(F.explode(pairs).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges point from the greater to the smaller end
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _each(down.join(least, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: then each star is a component. Edges point to the smaller end."""
    up, down = [F.struct(F.col(c).alias("id"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("a", 1), ("b", 0))]
    ends = edges.select(F.explode(F.array(up, down)).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(id, component) of every node that an edge names."""
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = raw.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    current = staged(raw.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        if _is_forest_of_stars(current):
            break
        current = staged(_small_star(_large_star(current)), "components")
    else:
        raise RuntimeError(f"no forest of stars within {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

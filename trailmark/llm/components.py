"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def dealt_anew(per_key: DataFrame, key: str) -> DataFrame:
    """per_key (an aggregate by key) with the key as a computed column of the same values.

    A join on it then shuffles this side itself, so both sides are plain shuffles, and adaptive execution splits a hot
    key's rows on the other side; straight from the aggregate, one task would take all rows of a key.
    """
    return per_key.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges(u long, v long); the component is its least id.

    Each round points all larger neighbours of a node at its least neighbour, then the node and its smaller
    ones; rows stay about as many as edges and the number of rounds grows with the logarithm of the
    component's size. The rows of a node with very many neighbours are split among tasks. Loops and repeated edges do no harm; no edges, no rows. Rounds are written tables.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = ends.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    now = written(ends.where("u != v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(dealt_anew(least, "u"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = written(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    pairs = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.unionByName(roots).unionByName(loops.join(pairs.select("id").union(roots.select("id")).distinct(), "id", "left_anti").distinct())

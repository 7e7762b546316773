"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    # `^ 0` gives the join an exchange of its own on this side, so that a hub's rows can be split there
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0L AS u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node that it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).withColumn("m", F.least("m", "u"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them (edges have u > v)."""
    near = _least(edges)
    moved = edges.join(near, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of `pairs` (two long columns) that is not itself the least of its component.

    Pairs with a null or with two equal ends are no links; repeated pairs count once. No pairs: no rows.
    Each round is written to the shared folder; it ends when a round changes nothing. `rows` is a bound of the
    number of pairs, if one is known: tables then have files in proportion to their rows.
    """
    a, b = (F.col(x) for x in pairs.columns[:2])
    state = scratch.keep(pairs.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows=rows)
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        state = scratch.keep(_small_star(_large_star(state)), state, 2 * mark[0])

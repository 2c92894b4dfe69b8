"""Connected components of a link table by alternating star contraction, on DataFrames only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

_ROUNDS = 60
#: Hubs that a node is compared with before pairs across components are looked at.
HUBS = 3


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` links of longs to ``(node, component)``, the smallest reachable node.

    Every node in a link gets one row. Each round points the larger neighbours of a node, then
    the smaller ones, to the smallest. Only minima and equi-joins: no neighbour list is gathered.
    Null ends and self links are ignored; repeated links count once; no links give no rows.
    """
    edges = scratch.settle(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    seen = _state(edges)
    for _ in range(_ROUNDS):
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).union(
            edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("least"))
        large = (
            both.where("m > n")
            .join(least, "n")
            .select(F.col("m").alias("v"), F.col("least").alias("u"))
            .where("v <> u")
            .distinct()
        )
        large = scratch.settle(large)
        low = large.groupBy("v").agg(F.min("u").alias("least"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct("v", F.col("least").alias("u")), F.struct(F.col("u").alias("v"), F.col("least").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("v <> u")
            .distinct()
        )
        old, edges = edges, scratch.settle(small)
        state = _state(edges)
        scratch.discard(large)
        scratch.discard(old)
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select("u", "u").distinct()
    )


def band(n, percent: int):
    """Number of a size's band. Bands are so wide that the sizes which go with one lie in two at most."""
    return F.floor(F.log(n.cast("double")) / F.lit(4 * math.log(100.0 / percent)) + F.lit(1e-9))


def star_pairs(listed: DataFrame) -> DataFrame:
    """``(a, b)``: each node of ``listed (token, band, node[, strength])`` with hubs of its tokens and band.

    A hub is the strongest node of a token and band, the least one of equals; of a node's hubs the
    ``HUBS`` strongest are taken, so that members of one family meet in the same ones. Hubs of
    neighbouring bands are paired alike. The pairs are at most a few for each node.
    """
    strength = F.col("strength") if "strength" in listed.columns else F.lit(0).cast("long")
    listed = listed.select("token", "band", "node", strength.alias("strength"))

    def few(pairs: DataFrame) -> DataFrame:
        own = pairs.where("hub.node <> b").groupBy("b").agg(F.slice(F.array_sort(F.collect_set("hub")), 1, HUBS).alias("hubs"))
        return own.select(F.explode("hubs.node").alias("a"), "b")

    rank = F.struct((-F.col("strength")).alias("weakness"), "node")
    hubs = listed.groupBy("token", "band").agg(F.min(rank).alias("hub"))
    own = listed.join(hubs, ["token", "band"]).select("hub", F.col("node").alias("b"))
    above = hubs.select("token", (F.col("band") + 1).alias("band"), F.col("hub").alias("lower"))
    across = hubs.join(above, ["token", "band"]).select(F.col("lower").alias("hub"), F.col("hub.node").alias("b"))
    return ordered(few(own).union(few(across)))


def ordered(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cross_pairs(
    listed: DataFrame, detail: DataFrame, found: DataFrame, tried: DataFrame, percent: int, close, scratch: Scratch
) -> DataFrame:
    """Pairs of ``listed (token, band, node)`` under one token that are in two components.

    ``detail (node, n, ...)`` has each node's size and what ``close(left, right)`` needs to narrow
    pairs down, ``found`` the components so far, ``tried`` pairs already decided. The largest
    component of a token is never paired with itself: only the rest of the token's nodes meet all
    of them. Steps are written one by one, so that the shuffle files of one are gone before the next.
    """
    named = listed.join(found.withColumnRenamed("node", "__f"), F.col("node") == F.col("__f"), "left").drop("__f")
    every = scratch.settle(named.withColumn("component", F.coalesce("component", "node")))
    each = every.groupBy("token", "component").agg(F.count("*").alias("c"))
    mixed = (
        each.groupBy("token")
        .agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("token", F.col("top.component").alias("top"))
    )
    named = every.join(scratch.settle(mixed), "token")
    named = scratch.settle(named.withColumn("first", F.col("component") == F.col("top")).drop("top"))
    scratch.discard(every)
    named = named.join(detail, "node")
    reach = [F.col("n") * (percent / 100 * (1 - 1e-6)), F.col("n") * (100 / percent * (1 + 1e-6))]
    few = named.where("not first").withColumn(
        "band", F.explode(F.array_distinct(F.array(*(band(r, percent) for r in reach))))
    )
    few = few.drop("first")
    few = few.select(*(c if c in ("token", "band") else F.col(c).alias(f"{c}_1") for c in few.columns))
    fine = (
        (F.col("component") != F.col("component_1"))
        & (F.col("first") | (F.col("node_1") < F.col("node")))
        & (F.col("n") * 100 >= F.col("n_1") * percent)
        & (F.col("n_1") * 100 >= F.col("n") * percent)
    )
    fine = fine & close(lambda c: F.col(c), lambda c: F.col(f"{c}_1"))
    pairs = named.join(few, ["token", "band"]).where(fine)
    return ordered(pairs.select(F.col("node").alias("a"), F.col("node_1").alias("b"))).join(tried, ["a", "b"], "left_anti")

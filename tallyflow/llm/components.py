"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[np.fromiter(map(root, range(len(nodes))), np.int64, len(nodes))]


def _forest(batches):
    """Each batch's links as links to the smallest node of its batch-local group."""
    for batch in batches:
        node, low = union_find(batch["a"].to_numpy(), batch["b"].to_numpy())
        move = node != low
        yield pa.RecordBatch.from_arrays([pa.array(node[move], pa.int64()), pa.array(low[move], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """`links` has a and b. Returns node and component, the smallest node it reaches, for every node with a link.

    Each batch of links is joined up by itself first. Then alternating stars: a node sends its larger neighbours,
    then its smaller ones, to the smallest node it knows. Minima are aggregated before the shuffle, so a node with
    very many links is no hot group.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = scratch.keep(links.mapInArrow(_forest, "a long, b long").select(high.alias("a"), low.alias("b")).distinct(), f"{name}-0")
    sign = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
    seen = stars.agg(*sign).first()
    for k in count(1):
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, f"{name}-{k}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        stars = scratch.keep(small, f"{name}-{k}")
        state = stars.agg(*sign).first()
        if seen == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state


def joined(groups: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components of old `groups` (None: none) and more `links`; only the links between groups are followed."""
    if groups is None:
        return scratch.keep(components(links, scratch, name), f"{name}-all")
    if not links.head(1):
        return groups
    for side in "ab":
        known = groups.select(F.col("node").alias(side), F.col("component").alias("own"))
        links = links.join(known, side, "left").withColumn(side, F.coalesce("own", side)).drop("own")
    more = scratch.keep(components(scratch.keep(links.where("a <> b"), f"{name}-between"), scratch, f"{name}-new"), f"{name}-more")
    moved = groups.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = more.join(groups, "node", "left_anti").select("node", "component")
    return scratch.keep(moved.unionByName(fresh), f"{name}-all")

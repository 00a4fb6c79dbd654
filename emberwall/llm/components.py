"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def joined_components(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """found(node, component), as connected_components gives it, after more links(a, b).

    Only links between unlike components count, and these are joined as nodes of a graph of their own, so earlier
    links are not gone through again. Nodes that found doesn't hold are components by themselves.
    """
    of = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    sides = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = sides.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    moved = connected_components(between, scratch, name)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = found.join(to, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return scratch.write(old.unionByName(moved.join(found, "node", "left_anti")), f"{name}-all")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round takes the least label among neighbours (a partial aggregation, so a node with
    very many links is no bottleneck), then the label's own label, and is written to the
    shared folder. Rounds grow with the logarithm of the longest path, roughly.
    """
    links = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).dropDuplicates(["a", "b"]), f"{name}-links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
    step = f"{name}-0"
    labels = scratch.write(labels, step)
    for k in range(1, 1000):
        seen = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = lower.join(jump, lower["component"] == jump["via"], "left").select("node", F.least("component", "far").alias("component"), "old")
        new = scratch.write(new, f"{name}-{k}")
        changed = new.where("component <> old").limit(1).count()
        scratch.drop(step)
        labels, step = new.select("node", "component"), f"{name}-{k}"
        if not changed:
            break
    scratch.drop(f"{name}-links")
    return labels

"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node.

    Each round turns an edge's ends to the smallest label around them and then follows labels to their own labels, so
    that chains shorten by half. Every round is written to the shared folder, and the one before it dropped.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.keep(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{label}-0")
    step = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("beyond"))
        # A root takes over the smallest label that any of its members has found.
        roots = lower.groupBy(F.col("component").alias("node")).agg(F.min("now").alias("root"))
        moved = (
            lower.join(jump, "now", "left")
            .join(roots, "node", "left")
            .select("node", "component", F.least("now", F.coalesce("beyond", "now"), F.coalesce("root", "now")).alias("next"))
        )
        step += 1
        moved = scratch.keep(moved, f"{label}-{step}")
        changed = moved.where("next <> component").limit(1).count()
        scratch.drop(f"{label}-{step - 1}")
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            scratch.drop(f"{label}-edges")
            return labels

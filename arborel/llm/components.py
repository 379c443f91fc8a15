"""Connected components by contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its least node.

    In each round a node takes the first of its neighbours and their
    neighbours, in a random order drawn anew, or stays; nodes that took the
    same one become one, and the links between different ones remain.  A star
    closes in one round; chains shrink by a constant factor.  So the rounds
    grow with the logarithm of the largest component's diameter.

    labels, an earlier result, is taken on: links then add to it, and only the
    graph of its components is worked on.  Self-links and repeated links are
    allowed; no links give no rows beyond those of labels.
    """
    ends = links.select("a", "b")
    if labels is not None:
        old = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        ends = ends.join(old[0], "a", "left").join(old[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps, turn = [], 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first")).select("node", F.least("first", order("node")).alias("first")), "near")
        far = both.join(near.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("first").alias("further"))
        chosen = written(near.join(far.withColumnRenamed("a", "node"), "node").select("node", F.least("first", "further").alias("first")).select("node", F.col("first.to").alias("to")), "chosen")
        maps.append(chosen)
        x, y = (chosen.select(F.col("node").alias(k), F.col("to").alias(f"t{k}")) for k in "ab")
        edges = written(edges.join(x, "a").join(y, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        turn += 1
    if not maps:
        return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    found = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = written(found, "roots")
    least = written(found.groupBy("root").agg(F.min("node").alias("component")), "least")
    found = found.join(least, "root").select("node", "component")
    if labels is not None:
        newer = found.select(F.col("node").alias("component"), F.col("component").alias("newer"))
        kept = labels.join(newer, "component", "left").select("node", F.coalesce("newer", "component").alias("component"))
        found = kept.unionAll(found.join(labels.select("node"), "node", "left_anti").select("node", "component"))
    return written(found, "components")

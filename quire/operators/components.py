"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Rounds of smallest-neighbour hooking followed by pointer jumping, each written to the shared
    folder, so a chain of n nodes takes about log n rounds and no round depends on another's
    executors. Labels of a node are combined before they are shuffled, so one node with very many
    links costs no more than its links. Null ends and links of a node to itself add nothing; an
    empty table gives an empty result.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), name)
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), name)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        # the root of a node learns what the node's neighbours know
        hooks = near.join(labels, "node").where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        low = labels.join(near, "node").join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near", "hook").alias("label"))
        stepped = materialize(low, name)
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(stepped.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), name)
        changed = new.where("label <> old").limit(1).count()
        release(labels, stepped)
        labels = new
        if not changed:
            release(edges)
            return labels.select("node", F.col("label").alias("component"))

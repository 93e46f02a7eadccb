"""Connected components of a table of links, by contraction.

Every node takes the smallest node among itself and its neighbours as its parent; links are then drawn between parents, and
the same is done again until none is left. Nodes are only aggregated and joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): label is the same for nodes that links(a, b) connect. Only nodes with a link to another have a row."""
    edges = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), f"parents-{k}")
        dead = [edges, parents]
        if labels is None:
            new = parents.select("node", F.col("parent").alias("label"))
        else:
            step = parents.select(F.col("node").alias("label"), "parent")
            new = labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
            dead.append(labels)
        labels = staged(new, f"labels-{k}")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a parent may have a parent of its own: that link stays
        up = parents.select(F.col("node").alias("x"), F.col("parent").alias("a")).filter("x <> a")
        up = up.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("b")), "a").select("a", "b")
        edges = drawn.unionByName(up).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = staged(edges, f"links-{k}")
        discard(*dead)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        kind = dict(links.dtypes)["a"]
        return links.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    return labels

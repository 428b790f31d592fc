"""Connected components of an edge table: hook every node to its smallest neighbour, jump to the roots, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) of a forest (node, label) whose parents are smaller than their children: every label becomes the root of its tree.

    Pointer jumping: the number of passes is the logarithm of the depth.
    """
    now = parents
    while True:
        up = small(now.select(F.col("node").alias("label"), F.col("label").alias("higher")))
        jumped = materialize(now.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved")))
        now = jumped.select("node", "label")
        if not jumped.where("moved").take(1):
            return now


def relabel(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with the labels la and lb of their ends (a node without a label is its own), where these differ."""
    one = small(labels.select(F.col("node").alias(a), F.col("label").alias("la")))
    two = small(labels.select(F.col("node").alias(b), F.col("label").alias("lb")))
    out = pairs.join(one, a, "left").join(two, b, "left")
    return out.withColumn("la", F.coalesce("la", a)).withColumn("lb", F.coalesce("lb", b)).where("la != lb")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame | None:
    """(node, label) for every node that isn't the smallest of its component, label being that smallest node; None without edges.

    In a pass, a grouping with map-side minima hooks every node that has a smaller neighbour, so all but local minima go; the edges between
    the trees are the next pass's. Edges and labels stay in tables of the shared folder; a table is broadcast only where its counted
    rows are few, else the joins shuffle and adaptive execution splits a node with very many edges.
    """
    order = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = materialize(edges.where(F.col(a) != F.col(b)).select(*order(a, b)).distinct())
    labels = None
    while now.take(1):
        trees = roots(materialize(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))))
        if labels is None:
            labels = trees
        else:
            up = small(trees.select(F.col("node").alias("label"), F.col("label").alias("higher")))
            labels = materialize(labels.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label")).union(trees))
        now = materialize(relabel(now, trees, "u", "v").select(*order("la", "lb")).distinct())
    return labels

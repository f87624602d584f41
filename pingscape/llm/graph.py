"""Connected components from links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import few, stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node in a link: label is the smallest node that can be reached.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so
    chains halve. Rounds are cut by checkpoints, and one number per round tells the driver when to stop. Few labels
    are broadcast to the links, so that a round deals out rows once.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    edges = stored(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    sent = F.broadcast if few(labels) else lambda df: df
    while True:
        own = labels.select("node", F.col("label").alias("low"), "label")
        near = edges.join(sent(labels.toDF("other", "low")), "other").select("node", "low", F.lit(None).cast(labels.schema["label"].dataType).alias("label"))
        low = own.unionByName(near).groupBy("node").agg(F.min("low").alias("low"), F.max("label").alias("label"))
        moved = stored(low.join(sent(labels.toDF("low", "beyond")), "low", "left").select(
            "node", F.least("low", F.coalesce("beyond", "low")).alias("label"),
            (F.least("low", F.coalesce("beyond", "low")) < F.col("label")).alias("moved"),
        ))
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of all nodes after more links between nodes, which need not have had a label.

    Links inside a component change nothing; where all are of that kind, no round is run. Few labels are broadcast.
    """
    if labels is None:
        return components(links, "a", "b")
    sent = F.broadcast if few(labels) else lambda df: df
    up = stored(links.join(sent(labels.toDF("a", "la")), "a", "left").join(sent(labels.toDF("b", "lb")), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")
    ).filter("a <> b").distinct())
    if up.isEmpty():
        return labels
    more = components(up, "a", "b")
    sent = F.broadcast if few(more) else lambda df: df
    old = labels.join(sent(more.toDF("label", "beyond")), "label", "left").select("node", F.coalesce("beyond", "label").alias("label"))
    new = more.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return stored(old.unionByName(new))

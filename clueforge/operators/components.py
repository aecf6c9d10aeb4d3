"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): every node of an edge with the smallest id it is connected to.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the number of rounds
    grows with the logarithm of the diameter on most graphs. A round's labels are a written table; only the count of
    changed labels reaches the driver. Loops and repeated edges don't matter; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    both = durable(pairs.unionAll(pairs.select("v", "u")).distinct(), "edges")
    labels = durable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["u"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("id").alias("at"), F.col("label").alias("next"))
        jumped = lower.join(up, lower["label"] == up["at"], "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        jumped = durable(jumped, "labels")
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))

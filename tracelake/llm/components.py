"""Connected components of links between ids, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that a link (a, b) names; component: the smallest id it reaches.

    Each round a node takes the least label among its neighbours', and then the
    label of its label, which halves the distance that labels still have to go.
    Rounds are written out, so a lost executor repeats one at most. Only the number
    of changed labels comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, "edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        heard = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        best = labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("best"))
        up = labels.select(F.col("id").alias("best"), F.col("label").alias("jump"))
        moved = best.join(up, "best", "left").select("id", F.least("best", F.coalesce("jump", "best")).alias("new"), "label")
        moved = stored(moved, "labels")
        changed = moved.where("new <> label").limit(1).count()
        discard(labels)
        labels = moved.select("id", F.col("new").alias("label"))
        labels._stored_at = moved._stored_at
        if not changed:
            discard(edges)
            out = labels.select("id", F.col("label").alias("component"))
            out._stored_at = moved._stored_at
            return out

"""Connected components of a table of links, by contraction: no group of links is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node in links (a, b); root is one of the component's ids.

    Each round sends every node to its least neighbour, or itself, follows such pointers a few steps, and replaces
    links by the links between what the pointers reach. Nodes that stay are at most half, so rounds are logarithmic.
    Each round's tables are written to the shared folder, and go when the next round has read them. Links with a null or to
    themselves count for nothing; repeated links count once; without links there are no rows; other columns are ignored.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    kept: DataFrame | None = None  # what labels are read from
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("up"))
        up = stored(up, "pointers")
        for _ in range(2):
            over = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
            further = stored(up.join(over, up["up"] == over["_id"]).select("id", F.col("_up").alias("up")), "pointers")
            forget(up)
            up = further
        if labels is None:
            labels, now = up.select("id", F.col("up").alias("root")), up
        else:
            moved = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
            labels = now = stored(labels.join(moved, labels["root"] == moved["_id"], "left").select("id", F.coalesce("_up", "root").alias("root")), "labels")
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("x")), up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        left = stored(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        forget(edges, kept, up if now is not up else None)
        edges, kept = left, now
        if edges.isEmpty():
            forget(edges)
            return labels

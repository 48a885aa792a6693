"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every end of an edge; nodes that are reachable share ``comp``.

    ``edges`` has the columns ``a`` and ``b``. Each round every node moves to its smallest neighbour
    if that is smaller, the edges are renamed, loops and repeats go, and the shrunken graph is
    worked on. Labels are hashes, so a constant share of the nodes disappears each round. Only the
    shrinking tables are written; labels are their joins, made where the result is read. Nothing is
    collected; the driver sees one flag a round.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hop = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")), "hop")
        edges = stage(
            edges.join(hop, "a")
            .select(F.col("c").alias("x"), F.col("b").alias("a"))
            .join(hop, "a")
            .select(F.col("x").alias("a"), F.col("c").alias("b"))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        if labels is None:  # every end is in the first hop
            labels = hop.select(F.col("a").alias("node"), F.col("c").alias("comp"))
        else:
            moved = hop.select(F.col("a").alias("comp"), "c")
            labels = labels.join(moved, "comp", "left").select("node", F.coalesce("c", "comp").alias("comp"))
    return labels

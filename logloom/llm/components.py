"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _starred(pairs: DataFrame) -> DataFrame:
    """Each (node, other) with the smallest of the node and its others.

    The smallest ones are written first, so that both sides of the join are
    dealt anew and a node with very many links can be split.
    """
    least = saved(pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "least")
    return pairs.join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for the nodes
    of ``links`` (a, b) but the roots.

    Larger neighbours are hung on the smallest one, then smaller ones, until
    nothing changes, which takes about the logarithm of the longest path. Each
    round is written to shared storage. A node's neighbours are reduced to
    their smallest on the map side, and its links are joined with that one row.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        .filter("node > other")
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _starred(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = large.distinct()
        stars = _starred(large)
        small = stars.select(F.col("other").alias("node"), F.col("least").alias("other")).unionAll(
            stars.select("node", F.col("least").alias("other"))
        )
        edges = saved(small.filter("node > other").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "other"))).first()
        if now == before:
            return edges.withColumnRenamed("other", "root")
        before = now

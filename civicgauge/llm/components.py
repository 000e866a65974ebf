"""Connected components of links, for operators 7 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgauge.session import durable


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of each node with a link to another.

    ``links`` has the columns ``a`` and ``b``. Large-star and small-star steps alternate until nothing changes, so a chain
    of any length takes few rounds. A round is two aggregates and two joins on narrow rows; its links are written, so that
    a lost executor repeats one round at most. Only a count and two marks of all links come to the driver; marks are
    combined by exclusive or, as sums of many links would pass 64 bits.
    """
    edges = durable(_pointing_down(links), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select("a", "b", "m")
        # Each node below a goes to the smallest of them, and so does a.
        edges = durable(_pointing_down(small.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _pointing_down(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

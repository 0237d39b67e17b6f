"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import stage


def _directed(a: str, b: str):
    return F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: long): label is the smallest node reachable.

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller ones; rounds end when nothing
    changes, after a number of them that is logarithmic in the size. A node's neighbours never meet in one task: their
    minimum is aggregated before the shuffle and joined back, where a hot node's rows can be split. Every round's links
    are written to the shared folder. Links to oneself and repeated links change nothing; null ends are dropped.
    """
    edges, before = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None
    while True:
        both = edges.select(_directed("u", "v").alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = stage(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stage(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = now

"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Links that one task writes.
LINKS_A_TASK = 500_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours linked to the least of its neighbourhood.

    A node's neighbours are never gathered: only their minimum is, by an aggregate that Spark combines before it
    shuffles, and the join back is one that Spark splits if a node is hot.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Links are whole numbers or strings of one type; loops and repeats are ignored, and rows with a null are no links.
    The rounds end when the links are stars and no longer change; each round is written to the shared folder. An empty
    table gives an empty table.
    """
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = digest(links)
    while before[0]:
        # no more tasks and files than the links of the round before need
        tasks = -(-before[0] // LINKS_A_TASK)
        links = materialise(_star(_star(links, True), False).coalesce(tasks), name)
        after = digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

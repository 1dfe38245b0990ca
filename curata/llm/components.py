"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.shared import written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the least node of its component.

    Each round replaces every node's neighbours by links to the least of them: first the larger neighbours (large
    star), then the smaller ones (small star), so stars grow and paths shrink until nothing changes.  Links are at most
    as many as edges at any time; each round is written to the shared folder.
    """

    def stars(links: DataFrame) -> DataFrame:  # links: u > v
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return small.where("u > v").distinct()

    links = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct(), "links")
    # Done when every larger node has one link and no least node has a smaller one; sums tell a change of links.
    mark = None
    while True:
        links = written(stars(links), "links")
        now = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == (now["n"], now["x"]):
            break
        mark = (now["n"], now["x"])
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

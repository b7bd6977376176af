"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one aggregation of the smallest neighbour per node and one join
back; both combine or split a hot node's rows (map-side minimum; skew join).
Every step is written to the shared folder, so the lineage stays short, and
nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import discard, parallelism, staged

#: Links of one task at least, beyond one task a core.
ROWS = 100_000


def _summary(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the component's smallest node."""
    stars = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct(), "links")
    seen = _summary(stars)
    # a step of few links has few tasks, whatever the number of shuffle partitions
    tasks = min(parallelism(links.sparkSession), max(links.sparkSession.sparkContext.defaultParallelism, seen[0] // ROWS))
    while seen[0]:
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct())
        before, stars = stars, staged(small.coalesce(tasks), "stars")
        discard(before)
        now = _summary(stars)
        if now == seen:
            break
        seen = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

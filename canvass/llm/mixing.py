"""Operator 4: mixing sources to target weights by subset-sum budget fitting.

A source's target is its weight's share of all words, at most MAX_REPEATS times
its own words; the excess goes to the others by weight. A target is met by whole
repeats of the source and a remaining budget, which is fitted by exact lengths:
documents are counted by length, every length gives its share of the budget
(so the mix keeps the source's length distribution), and a bounded-knapsack
dynamic program over the documents left comes as near to what is still missing as they allow.
The shares are not given back, so another choice of all documents can now and then
come a few words nearer. Which documents of a length are taken is decided by
a seeded hash of their ids and texts.

What is planned on is one row per source and length, never a document. Documents
of one length are dealt into cells by their hash, so a length that holds a third
of all rows is split; only the cell where the count ends is ranked.

Defined cases: null, empty or blank text has size 0 and is taken as often as its
source is repeated (0 words each); a null source is a source of its own and
sorts last; rows that repeat an id count one by one; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.llm.common import prepare, read_table, staged

SEED = 20_240_501
MAX_REPEATS = 3
#: Documents of one source and length that share a cell, on average.
CELL = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str | None, int, float]]:
    """(source, size, target): sources in code point order, null last; excess over MAX_REPEATS sizes is reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    target, open_ = [0.0] * len(order), list(range(len(order)))
    budget = float(sum(n for _, n in order))
    while open_:
        share = sum(weight[i] for i in open_)
        over = [i for i in open_ if budget * weight[i] / share > MAX_REPEATS * order[i][1]]
        if not over:
            for i in open_:
                target[i] = budget * weight[i] / share
            break
        for i in over:
            target[i] = float(MAX_REPEATS * order[i][1])
        budget -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest to the budget from below.

    Shares first; then the longest that still fit, keeping back a reserve; then an
    exact bounded knapsack (bit i of a set: a sum of i can be reached).
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    spare = [c - t for c, t in zip(counts, take, strict=True)]
    reserve = max(lengths)
    heap = [(-n, i) for i, n in enumerate(lengths) if n > 0 and spare[i]]
    heapq.heapify(heap)
    while heap and left > reserve:
        n, i = heapq.heappop(heap)
        more = min(spare[i], (left - reserve) // -n)
        take[i] += more
        spare[i] -= more
        left -= more * -n
    # bounded knapsack over the spare documents, short ones first, by powers of two of each count
    mask, reach, steps = (1 << left + 1) - 1, 1, []
    for i in sorted((i for i in range(len(lengths)) if spare[i] and 0 < lengths[i] <= left), key=lambda i: lengths[i]):
        held, part = min(spare[i], left // lengths[i]), 1
        while held:
            part = min(part, held)
            steps.append((i, part, reach))
            reach |= reach << part * lengths[i] & mask
            held -= part
            part *= 2
        if reach >> left & 1:
            break
    goal = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += part
            goal -= part * lengths[i]
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every row."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col(text_col)
    narrow = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                                F.xxhash64(F.lit(seed), F.col(id_col), text).alias("dice")), "sizes")
    counted = staged(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    per_source = [(r["source"], r["words"]) for r in
                  counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]  # one row a source
    plan = spark.createDataFrame(targets(per_source, weights) or [], "source string, source_size long, target double")
    planned = counted.join(plan, counted["source"].eqNullSafe(plan["source"])).select(
        counted["source"], "size", "n", "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS)))
        .otherwise(F.lit(1)).cast("long").alias("repeats"))

    def fit_source(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        first = group.iloc[0]
        budget = round(first["target"] - first["repeats"] * first["source_size"]) if first["repeats"] < MAX_REPEATS else 0
        group["more"] = fit(group["size"].tolist(), group["n"].tolist(), max(0, int(budget))) if budget > 0 else 0
        return group[["source", "size", "n", "source_size", "target", "repeats", "more"]]

    fitted = staged(planned.groupBy("source").applyInPandas(
        fit_source, "source string, size long, n long, source_size long, target double, repeats long, more long"), "fitted")

    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL))
    rows = narrow.join(fitted, narrow["source"].eqNullSafe(fitted["source"]) & (narrow["size"] == fitted["size"])).select(
        "doc_id", narrow["source"], narrow["size"], "dice", "source_size", "target", "repeats", "more", "n",
        F.pmod("dice", cells).alias("cell"))
    # documents of the cells before each cell, for lengths of more than one cell
    split = (rows.where((F.col("n") > CELL) & (F.col("more") > 0)).groupBy("source", "size", "cell").agg(F.count("*").alias("m")))
    before = split.withColumn("before", F.sum("m").over(W.partitionBy("source", "size").orderBy("cell")) - F.col("m")).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), "before", "m")
    rows = rows.join(before, rows["source"].eqNullSafe(before["s"]) & (rows["size"] == before["z"]) & (rows["cell"] == before["c"]), "left")
    rows = rows.withColumn("wanted", F.col("more") - F.coalesce("before", F.lit(0)))
    held = F.coalesce("m", F.col("n"))
    sure = rows.where((F.col("wanted") <= 0) | (F.col("wanted") >= held)).withColumn("extra", (F.col("wanted") > 0).cast("long"))
    ranked = rows.where((F.col("wanted") > 0) & (F.col("wanted") < held)).withColumn("rank", F.row_number().over(
        W.partitionBy("source", "size", "cell").orderBy("dice", "doc_id"))).withColumn(
        "extra", (F.col("rank") <= F.col("wanted")).cast("long")).drop("rank")
    copies = F.col("repeats") + F.col("extra")
    return sure.unionByName(ranked).select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                                           (copies * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: words of each that the mix takes."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""Exact medians per group, without sorting a group.

A group with a third of all rows cannot be sorted by one task. The order statistics are found by
counting instead: values (whole numbers, such as cents) are read as digits of ``DIGIT_BITS`` bits,
most significant first. Each round counts the values of each group by their next digit, among those
that still share the digits chosen so far, and picks the digit under which the wanted rank falls. The
counts combine on the map side, so a group is at most ``2 ** DIGIT_BITS`` small rows a task however many values it has;
a range of 32 bits takes two rounds.

Null values do not count; a group without a value has no row. An even group's median is the mean of its two
middle values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

DIGIT_BITS = 16

#: Rows (two a group) of the chosen prefixes that may be broadcast.
MAX_BROADCAST_TARGETS = 100_000


def group_medians(df: DataFrame, group_cols: Sequence[str], value_col: str, median_col: str = "median",
                  digit_bits: int = DIGIT_BITS) -> DataFrame:
    """One row per group: (group_cols..., n_values, median as double). No group column: one row for the whole table."""
    groups = list(group_cols)
    # groups under names of their own, so that columns cannot clash
    keys = [f"_md_g{i}" for i in range(len(groups))] or ["_md_all"]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_md_all")]
    values = reliable_checkpoint(df.where(F.col(value_col).isNotNull()).select(*named, F.col(value_col).cast("long").alias("_md_v")))
    edge = values.agg(F.min("_md_v").alias("lo"), F.max("_md_v").alias("hi")).first()
    low = 0 if edge.lo is None else edge.lo
    rounds = max(1, -(-(0 if edge.lo is None else edge.hi - low).bit_length() // digit_bits))
    values = values.withColumn("_md_u", F.col("_md_v") - F.lit(low))

    sizes = values.groupBy(*keys).agg(F.count("*").alias("_md_n"))
    ranks = F.explode(F.array_distinct(F.array(F.expr("(_md_n - 1) div 2"), F.expr("_md_n div 2"))))
    # wanted: the 0-based rank among the values that share the digits of `prefix`
    wanted = sizes.select(*keys, "_md_n", F.lit(0).cast("long").alias("prefix"), ranks.alias("rank"))
    for turn in range(rounds):
        shift = digit_bits * (rounds - 1 - turn)
        wanted = reliable_checkpoint(wanted)
        prefix = F.shiftright("_md_u", shift + digit_bits) if shift + digit_bits < 64 else F.lit(0).cast("long")
        digit = F.shiftright("_md_u", shift).bitwiseAND(F.lit((1 << digit_bits) - 1))
        rows = values.select(*keys, prefix.alias("prefix"), digit.alias("digit"))
        if turn:
            asked = wanted.select(*keys, "prefix").distinct()
            if asked.count() <= MAX_BROADCAST_TARGETS:
                asked = F.broadcast(asked)
            rows = rows.join(asked, on=_same(rows, asked, [*keys, "prefix"]), how="left_semi")
        counts = rows.groupBy(*keys, "prefix", "digit").agg(F.count("*").alias("here"))
        upto = Window.partitionBy(*keys, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("here").over(upto))
        found = wanted.join(counts, on=_same(wanted, counts, [*keys, "prefix"])).where(
            (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("here")))
        wanted = found.select(*[wanted[k] for k in keys], "_md_n",
                              (F.shiftleft(wanted["prefix"], digit_bits) + F.col("digit")).alias("prefix"),
                              (F.col("rank") - F.col("upto") + F.col("here")).alias("rank"))
    middle = wanted.groupBy(*keys, "_md_n").agg(((F.min("prefix") + F.max("prefix")).cast("double") / 2 + F.lit(float(low))).alias(median_col))
    return middle.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("_md_n").alias("n_values"), median_col)


def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    """Null-safe equality of some columns (a null group is a group)."""
    on = None
    for c in cols:
        one = left[c].eqNullSafe(right[c])
        on = one if on is None else on & one
    return on

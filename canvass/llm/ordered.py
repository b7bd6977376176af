"""Documents in a total order without a global sort in one task.

Ranges of the id come from approximate quantiles (one narrow pass over the id
column); the ranges are at most the session's shuffle partitions, which bounds
every list that reaches the driver here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import parallelism


def range_bounds(df: DataFrame, id_col: str) -> list[int]:
    """Ascending cut points of the id, fewer than the shuffle partitions."""
    n = parallelism(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    if not probs:
        return []
    cuts = df.select(F.col(id_col).cast("double").alias("v")).approxQuantile("v", probs, 0.25 / n) or []
    return sorted({int(c) for c in cuts})


def range_number(id_col: str, bounds: list[int]) -> Column:
    """Number of the id's range, ascending; a null id belongs to the last one."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    number = F.size(F.filter(cuts, lambda b: b <= F.col(id_col)))
    return F.when(F.col(id_col).isNull(), F.lit(len(bounds))).otherwise(number)


def deal(df: DataFrame, range_col: str, n_ranges: int, order: list) -> DataFrame:
    """One partition per range, sorted inside."""
    return df.repartitionById(n_ranges, F.col(range_col).cast("int")).sortWithinPartitions(*order)

"""Ranking operators: contiguous ranks, global ranks, first/last row per key.

Ranks (W1, W2, W4, W6)
----------------------
``Window.partitionBy(segment).orderBy(...)`` puts a whole segment into one
task. With a handful of industry segments and one of them holding a third of
all companies that task would sort terabytes. ``contiguous_rank`` therefore
offers a *distributed* strategy, the default:

1. ``repartitionByRange`` on (group, order keys, unique tie-breaker): Spark
   samples the keys and cuts the data into equal ranges, so a hot group is
   spread over many tasks; ``sortWithinPartitions`` orders each range.
2. Each row gets its partition id and a per-partition monotonically
   increasing id; the frame is written with a reliable ``checkpoint()`` so
   those ids are fixed even if an executor is lost and a stage re-runs.
3. A tiny table of (partition, group) -> (row count, first id) is built by an
   aggregation (at most partitions + groups rows), and a window over it gives
   each (partition, group) its starting offset.
4. The offsets are counted and, up to ``MAX_BROADCAST_OFFSETS`` rows, broadcast
   to the ranked rows, which therefore keep their range partitioning and are
   not shuffled a second time. Beyond that they meet by a shuffled join.

rank = offset + (id - first id in partition for the group) + 1.

``strategy="window"`` is the plain window, right for groups known to be small.
Both strategies give the same numbers; the order must be total (the caller
passes a unique tie-breaker as the last key).

First / last row per key (A12, W5, J4, J6)
-----------------------------------------
``first_per_key`` and ``last_per_key`` pack the order keys into one fixed-width
number (``decimal(38,0)``), whose minimum or maximum per key is a hash aggregation
with a map-side partial step: a key with a third of all rows is one number a map
task before the shuffle. The other columns are fetched by one join on the key, however wide
they are. Ties of the order keys go by a hash of the row, so the choice does not depend
on the run; equal rows are interchangeable. Order keys that do not fit the number (texts, doubles)
are compared as a struct instead, which Spark aggregates by sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

_PID = "_cv_pid"
_MID = "_cv_mid"
_CNT = "_cv_n"
_MIN = "_cv_m0"
_OFF = "_cv_off"

#: Offset rows (a group key and three numbers each) that may be broadcast.
MAX_BROADCAST_OFFSETS = 200_000


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def contiguous_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                    rank_col: str = "rank", strategy: str = "distributed",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1..n inside each group in the given total order.

    ``group_cols`` may be empty (one global ranking, W2). Rows whose group key
    is null form their own group (null-safe); callers that must drop them
    filter first.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    if strategy == "window":
        w = Window.partitionBy(*group_cols).orderBy(*order_cols) if group_cols \
            else Window.orderBy(*order_cols)
        return df.withColumn(rank_col, F.row_number().over(w))
    if strategy != "distributed":
        raise ValueError(f"unknown strategy {strategy!r}")

    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_keys = [F.col(c).asc_nulls_first() for c in group_cols] + order_cols
    keyed = (df.repartitionByRange(n, *sort_keys)
               .sortWithinPartitions(*sort_keys)
               .withColumn(_PID, F.spark_partition_id())
               .withColumn(_MID, F.monotonically_increasing_id()))
    keyed = reliable_checkpoint(keyed)

    counts = reliable_checkpoint(
        keyed.groupBy(_PID, *group_cols).agg(F.count(F.lit(1)).alias(_CNT), F.min(_MID).alias(_MIN)))
    few = counts.count() <= MAX_BROADCAST_OFFSETS
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))) \
        .orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # fresh column names on the small side: no self-join ambiguity
    gnames = [f"_cv_g{i}" for i in range(len(group_cols))]
    offsets = counts.select(
        F.col(_PID).alias("_cv_pid_o"), *[F.col(c).alias(g) for c, g in zip(group_cols, gnames)],
        F.col(_MIN).alias("_cv_m0_o"), F.coalesce(F.sum(_CNT).over(w), F.lit(0)).alias(_OFF))

    cond = [F.col(_PID) == F.col("_cv_pid_o")] + [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group_cols, gnames)]
    joined = keyed.join(F.broadcast(offsets) if few else offsets, on=cond, how="inner")
    rank_expr = (F.col(_OFF) + (F.col(_MID) - F.col("_cv_m0_o")) + F.lit(1)).cast("long").alias(rank_col)
    out = joined.select(*[F.col(c) for c in df.columns if c != rank_col], rank_expr)
    if rank_col in df.columns:
        out = out.select(*df.columns)
    return out


def first_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str | Column],
                  value_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the row with the smallest (order_cols...) tuple, nulls first. Rows with a null key go."""
    return _extreme_per_key(df, key_cols, order_cols, value_cols, F.min)


def last_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str | Column],
                 value_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the row with the largest (order_cols...) tuple
    (dictionary semantics: the last assignment wins). Rows with a null key go."""
    return _extreme_per_key(df, key_cols, order_cols, value_cols, F.max)


#: Digits that an order key of each type takes in the packed order, and what makes it positive.
_DIGITS = {"boolean": (1, 1), "tinyint": (3, 129), "smallint": (5, 32_769), "int": (10, 2 ** 31 + 1), "date": (10, 2 ** 31 + 1),
           "bigint": (20, 2 ** 63 + 1), "timestamp": (20, 2 ** 63 + 1), "timestamp_ntz": (20, 2 ** 63 + 1)}
_PACKED_DIGITS = 38


def packed_order(df: DataFrame, order_cols: Sequence[str | Column], tie_cols: Sequence[str]) -> Column | None:
    """The order keys, and a hash of ``tie_cols`` in the digits that are left, as one number; None if they do not fit."""
    order = _as_cols(order_cols)
    parts, room = [], _PACKED_DIGITS
    for (name, kind), o in zip(df.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)]).dtypes, order):
        if kind.startswith("decimal") and kind.endswith(",0)"):  # a scan order: not negative
            digits, value = int(kind[8:-3]) - (int(kind[8:-3]) == _PACKED_DIGITS), o
        elif kind in _DIGITS:
            digits, shift = _DIGITS[kind]
            whole = F.unix_date(o) if kind == "date" else F.unix_micros(o.cast("timestamp")) if kind.startswith("timestamp") else o
            value = whole.cast("long").cast("decimal(20,0)") + F.lit(str(shift)).cast("decimal(20,0)")
        else:
            return None
        room -= digits
        if room < 0:
            return None
        parts.append((digits, F.coalesce(value.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))))
    tie = min(room, 18)
    packed = F.lit(0).cast("decimal(38,0)")
    for digits, value in parts:
        packed = packed * F.lit(str(10 ** digits)).cast("decimal(38,0)") + value
    if tie > 0 and tie_cols:
        packed = packed * F.lit(str(10 ** tie)).cast("decimal(38,0)") + F.pmod(F.xxhash64(*tie_cols), F.lit(10 ** tie)).cast("decimal(38,0)")
    return packed.cast("decimal(38,0)")


def _extreme_per_key(df, key_cols, order_cols, value_cols, agg):
    key_cols = list(key_cols)
    value_cols = [c for c in (value_cols or df.columns) if c not in key_cols]
    order = packed_order(df, order_cols, value_cols)
    if order is not None:
        rows = df.select(*key_cols, *value_cols, order.alias("_cv_order")).dropna(subset=key_cols)
        best = rows.groupBy(*key_cols).agg(agg("_cv_order").alias("_cv_best"))
        # nothing lies beyond the extreme; as an equality it would be a key of the join, which then would
        # deal the rows by the order, too, and the next step deal them by the key again
        extreme = F.col("_cv_order") <= F.col("_cv_best") if agg is F.min else F.col("_cv_order") >= F.col("_cv_best")
        kept = rows.join(best, on=key_cols).where(extreme)
        # only equal rows are left of a key; the join has dealt and sorted them by it
        one = F.row_number().over(Window.partitionBy(*key_cols).orderBy(*key_cols))
        return kept.withColumn("_cv_one", one).where(F.col("_cv_one") == 1).select(*key_cols, *value_cols)
    order = _as_cols(order_cols)
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      *[F.col(c).alias(c) for c in value_cols]).alias("_cv_row")
    out = df.dropna(subset=key_cols).groupBy(*key_cols).agg(agg(packed).alias("_cv_row"))
    return out.select(*key_cols, *[F.col(f"_cv_row.{c}").alias(c) for c in value_cols])


def rank_within_segments(df: DataFrame, segment_col: str = "primary_naics",
                         score_col: str = "score", rank_col: str = "segment_rank",
                         id_col: str = "company_id", strategy: str = "distributed") -> DataFrame:
    """Contiguous rank per segment by score desc, old rank asc, id.

    Rows with a null segment are dropped, as a group-by on the segment drops
    them (their count is reported by ``segment_drop_count``).
    """
    kept = df.filter(F.col(segment_col).isNotNull())
    order = [F.col(score_col).desc_nulls_last(), F.col(rank_col).asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return contiguous_rank(kept, [segment_col], order, rank_col=rank_col, strategy=strategy)


def global_rank(df: DataFrame, score_col: str = "score", rank_col: str = "global_rank",
                id_col: str = "company_id", strategy: str = "distributed") -> DataFrame:
    """1..n over all rows by score desc (ties by id)."""
    order = [F.col(score_col).desc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return contiguous_rank(df, [], order, rank_col=rank_col, strategy=strategy)


def cap_per_group(df: DataFrame, group_col: str, cap_col: str, order_cols: Sequence[Column],
                  most: int | None = None) -> DataFrame:
    """Keep at most ``cap_col`` rows per group in the given order.

    ``most`` is a bound of all caps (a config value). The rank is compared with it as a literal, so every
    map task keeps its first ``most`` rows of a group before the shuffle (a window group limit), and no
    group is ranked as a whole. Without it the distributed rank is used.
    """
    if most is None:
        ranked = contiguous_rank(df, [group_col], order_cols, rank_col="_cv_pos")
    else:
        w = Window.partitionBy(group_col).orderBy(*order_cols)
        ranked = df.withColumn("_cv_pos", F.row_number().over(w)).where(F.col("_cv_pos") <= int(most))
    return ranked.filter(F.col("_cv_pos") <= F.col(cap_col)).drop("_cv_pos")

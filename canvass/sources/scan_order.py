"""The order of rows in their files, as a column.

A file has a first and a last row of a key; a Spark table has none unless the scan says so.
``with_scan_order`` adds one number per row from the hidden file metadata: the file's place in the list of names,
then the row's place in the file (``row_index`` of Parquet), or where a text format has none, the
start of the file's block and the row's number in its task, which reads a block from front to back.
It must be added to the scan itself, before any other step.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN_ORDER = "_scan_order"

#: Files of one table whose names are broadcast with their numbers.
MAX_BROADCAST_FILES = 100_000

# digits of the packed order: file, place in the file, row of the block
_ROWS, _PLACES = 10 ** 10, 10 ** 18


def with_scan_order(df: DataFrame, name: str = SCAN_ORDER) -> DataFrame:
    """``df`` (a file scan) with the column ``name``, decimal(38,0), ascending in file order and unique."""
    def big(x):
        return F.lit(str(x)).cast("decimal(38,0)")

    # the metadata column writes local paths with one slash
    files = sorted(re.sub("^file:/+", "file:/", f) for f in df.inputFiles())
    fields = df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    if "row_index" in fields:
        place, row = F.col("_metadata.row_index"), F.lit(0).cast("long")
    else:
        place, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    scan = df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_so_file"), place.alias("_so_place"), row.alias("_so_row"))
    if len(files) > 1:
        numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "_so_number long, _so_file string")
        scan = scan.join(F.broadcast(numbers) if len(files) <= MAX_BROADCAST_FILES else numbers, on="_so_file", how="left")
    else:
        scan = scan.withColumn("_so_number", F.lit(0).cast("long"))
    order = ((F.col("_so_number").cast("decimal(38,0)") * big(_PLACES) + F.col("_so_place").cast("decimal(38,0)")) * big(_ROWS)
             + F.col("_so_row").cast("decimal(38,0)"))
    return scan.select(*[F.col(c) for c in df.columns], order.cast("decimal(37,0)").alias(name))


def scan_order_of(df: DataFrame, order_col: str | None = None) -> str | None:
    """The column that orders the rows of ``df``: the given one, else its scan order if it has one."""
    return order_col or (SCAN_ORDER if SCAN_ORDER in df.columns else None)

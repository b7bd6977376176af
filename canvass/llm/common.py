"""Shared helpers of the training-data operators: sessions, staged tables, Arrow batches.

Every operator selects the columns it names before it adds its own, so extra
input columns can never clash with an internal one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import ensure_checkpoint_dir

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of one Arrow batch. A batch is held in memory on both sides of the pipe, so it must stay
#: small when texts are long.
ARROW_ROWS = 512

#: Bytes of text a kernel handles at once (its numpy temporaries are several times this).
SLICE_BYTES = 2 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, and make sure that the shared folder and this package are found.

    The Python workers of a local session look for the package where the driver
    has it; on a cluster it is installed or shipped like any other package.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, ROOT]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    # rows that hold whole blocks of places are larger than texts
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))
    ensure_checkpoint_dir(spark)


#: What lets go of caches that kernels keep in a worker from task to task.
RELEASE: list[Callable[[], None]] = []


def release() -> None:
    """Called by tasks that need no such cache, since a worker serves the tasks of all steps."""
    for clear in RELEASE:
        clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given Parquet tables by Spark's own reader."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor re-reads files that every executor
    sees, and steps that use the table several times do not compute it again.
    onto: a staged table of the same columns whose files the rows are added to.
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = onto.staged_at if onto is not None else f"{base}/canvass-{label}-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def staged_bytes(df: DataFrame) -> int:
    """Bytes of a staged table's files."""
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*tables: DataFrame | None) -> None:
    """Remove staged tables that no later step reads, and let go of the shuffle files of the steps behind them.

    Spark removes a finished step's shuffle files when the driver's collector finds its handle unused.
    """
    context = SparkSession.active().sparkContext
    for df in tables:
        paths = getattr(df, "staged_at", None) or []
        for path in [paths] if isinstance(paths, str) else paths:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    context._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None],
              schema: str, bytes_col: str | None = None) -> DataFrame:
    """``mapInArrow`` of a per-batch kernel; batches are cut so that ``bytes_col`` stays small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in cut(batch, bytes_col):
                out = kernel(part)
                if out is None:
                    continue
                yield from out if isinstance(out, list) else [out]
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, bytes_col: str | None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most SLICE_BYTES in ``bytes_col`` (a longer value makes a slice of its own)."""
    if batch.num_rows == 0:
        return
    if bytes_col is None:
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(bytes_col)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        floor = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, floor + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def total_order_key(col: str):
    """Rows with a null key sort last."""
    return [F.col(col).isNull(), F.col(col)]

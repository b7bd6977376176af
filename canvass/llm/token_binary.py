"""Operator 7: token ids of documents as Simple-8b pages on shared storage, and back.

A page holds consecutive whole documents (by ascending id) and their Simple-8b
coded ids (`simple8b`); a table of pages is written through Spark, so any store
that Spark can write holds it and a lost task is simply written again.

Defined cases: a null or empty text is only its end id; rows with a null id
come after all others; rows that repeat an id stand in the order of their
texts, nulls last; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import simple8b
from canvass.llm.common import cut, prepare, read_table, staged
from canvass.llm.ordered import deal, range_bounds, range_number
from canvass.llm.tokens import END_ID, encode_column, tokenizer_path

#: A page is closed when it holds this many ids (its last document may exceed it).
PAGE_IDS = 256 * 1024

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 6 * 1024 * 1024

PAGES = ("range int, ids_before long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, page binary")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some ENCODE_BYTES of text: each distinct piece of one is looked up once."""
    held, size = [], 0
    for batch in batches:
        for part in cut(batch, "text"):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= ENCODE_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write the pages in ascending id order; returns the table of pages, read back."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bounds = range_bounds(narrow, "doc_id")
    dealt = deal(narrow.withColumn("range", range_number("doc_id", bounds)), "range", len(bounds) + 1,
                 [F.col("range"), F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, n, docs_, sizes, ids = None, 0, 0, [], [], []

        def close():
            nonlocal before, n, docs_, sizes, ids
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()),
                     pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                     pa.array([simple8b.encode(np.concatenate(ids))], pa.binary())],
                    names=["range", "ids_before", "n_ids", "doc_ids", "doc_sizes", "page"])
                before, n, docs_, sizes, ids = before + n, 0, [], [], []

        for part in together(batches):
            rows = zip(part.column("range").to_pylist(), part.column("doc_id").to_pylist(),
                       encode_column(part.column("text"), path, end_id), strict=True)
            for r, doc, got in rows:
                if r != number:
                    yield from close()
                    number, before = r, 0
                docs_.append(doc)
                sizes.append(len(got))
                ids.append(got)
                n += len(got)
                if n >= PAGE_IDS:
                    yield from close()
        yield from close()

    return staged(dealt.mapInArrow(run, PAGES), "tokens")


def read_documents(pages: DataFrame) -> DataFrame:
    """Decode pages: (doc_id, start, n_tokens, ids_crc32), `start` counted over all documents before."""
    totals = {r["range"]: r["n"] for r in pages.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}  # one row a range
    first, offsets = 0, []
    for number in range(max(totals, default=-1) + 1):
        offsets.append(first)
        first += totals.get(number, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = simple8b.decode(one["page"]).astype("<u4")
                ends = np.cumsum(np.array(one["doc_sizes"], dtype=np.int64))
                begins = ends - np.array(one["doc_sizes"], dtype=np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one["doc_ids"], pa.int64()), pa.array(begins + one["ids_before"] + offsets[one["range"]]),
                     pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return pages.select("range", "ids_before", "doc_ids", "doc_sizes", "page").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as Simple-8b pages and read them back."""
    return read_documents(write_pages(read_table(spark, sf_dir, "documents")))

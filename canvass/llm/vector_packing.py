"""Operator 10: vector bin packing of token sequences.

Every document becomes ids (with its end id). Full sequences are cut off first;
the rests are items with a demand in three dimensions (tokens, segments, tokens
that bear loss) and are placed by the dot-product heuristic: into the open
sequence goes the item whose demand has the largest dot product with the
remaining capacities, until none fits. A gap that no item fits is filled by
cutting the longest item left.

Each task packs its own rows in blocks of BLOCK_ITEMS items, so nothing is
shuffled, no key can gather rows, and memory is bounded; each task's last block
leaves at most one short sequence.

Defined cases: a null or empty text is one end id; repeated ids are documents of
their own; an empty table gives an empty table; other columns are ignored.
A sequence id is partition * 2^40 + a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import cut, prepare, read_table
from canvass.llm.tokens import END_ID, encode_column, tokenizer_path

#: Sequence limits: tokens, segments and loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 128, 1024
#: Items that are packed together.
BLOCK_ITEMS = 4096

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")


def pack_items(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)):
    """Place items (each within the limits) into bins; yields one list of (item, begin, end) a bin.

    The dot product weighs an item's demands, as shares of the limits, by the
    bin's remaining shares. Items may be cut; begin and end are token positions
    in the item, and the loss of a cut item is taken from its end.
    """
    item = np.lexsort((np.arange(len(tokens)), -np.asarray(tokens, dtype=np.int64)))
    left = np.asarray(tokens, dtype=np.int64)[item]  # longest first, also later on
    free = np.asarray(loss, dtype=np.int64)[item]  # loss-bearing tokens left, at the item's end
    begin, alive, open_ = np.zeros(len(item), dtype=np.int64), np.ones(len(item), dtype=bool), len(item)
    while open_:
        if 2 * open_ < len(item):
            item, left, free, begin = item[alive], left[alive], free[alive], begin[alive]
            alive = np.ones(open_, dtype=bool)
        room, placed = list(limits), []
        while room[0] > 0 and room[1] > 0 and open_:
            a = int(np.searchsorted(-left, -room[0]))
            fits = alive[a:] & (free[a:] <= room[2])
            # every item takes one segment, so that part of the product is the same for all
            score = np.where(fits, left[a:] * (room[0] / limits[0] ** 2) + free[a:] * (room[2] / limits[2] ** 2), -1.0)
            if not len(score) or score[pick := int(np.argmax(score))] < 0:
                break
            pick += a
            placed.append((int(item[pick]), int(begin[pick]), int(begin[pick] + left[pick])))
            room = [room[0] - int(left[pick]), room[1] - 1, room[2] - int(free[pick])]
            alive[pick] = False
            open_ -= 1
        if room[0] > 0 and room[1] > 0 and open_:
            # no whole item fits: cut one, taking no more loss than is left
            take = np.where(alive, np.minimum(room[0], left - free + room[2]), -1)
            pick = int(np.argmax(take))
            n = int(take[pick])
            if n > 0:
                placed.append((int(item[pick]), int(begin[pick]), int(begin[pick]) + n))
                rest = (item[pick], left[pick] - n, min(free[pick], left[pick] - n), begin[pick] + n, True)
                to = int(np.searchsorted(-np.delete(left, pick), -rest[1]))
                item, left, free, begin, alive = (np.insert(np.delete(x, pick), to, v)
                                                  for x, v in zip((item, left, free, begin, alive), rest, strict=True))
        yield placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         end_id: int = END_ID, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS),
         loss_from: str | None = None) -> DataFrame:
    """Pieces of all documents: one row per piece with its place in a sequence.

    loss_from: a column with the number of leading tokens that bear no loss (a
    prompt); without it every token does.
    """
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         (F.coalesce(F.col(loss_from), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("prompt"))
    max_tokens, _, max_loss = limits
    step = min(max_tokens, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        items, rows = [], []  # items: (doc, start, ids, doc_tokens, loss)

        def emit(doc, start, ids, size, number, offset, loss):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, number, offset, loss))

        def out():
            nonlocal rows
            if rows:
                cols = list(zip(*rows, strict=True))
                rows = []
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=[f.split()[0] for f in PIECES.split(", ")])

        def close():
            nonlocal items, sequence
            got = items
            items = []
            sizes = np.array([len(x[2]) for x in got], dtype=np.int64)
            for placed in pack_items(sizes, np.array([x[4] for x in got], dtype=np.int64), limits):
                offset = 0
                for item, a, b in placed:
                    doc, start, ids, size, loss = got[item]
                    emit(doc, start + a, ids[a:b], size, sequence, offset, max(0, min(b - a, b - (len(ids) - loss))))
                    offset += b - a
                sequence += 1

        for batch in batches:
            for part in cut(batch, "text"):
                ids_of = encode_column(part.column("text"), path, end_id)
                for doc, prompt, ids in zip(part.column("doc_id").to_pylist(), part.column("prompt").to_pylist(), ids_of, strict=True):
                    size, at = len(ids), 0
                    while size - at >= step:  # full sequences of one document
                        emit(doc, at, ids[at:at + step], size, sequence, 0, max(0, min(step, at + step - prompt)))
                        sequence += 1
                        at += step
                    if at < size:
                        items.append((doc, at, ids[at:].copy(), size, max(0, min(size - at, size - prompt))))
                    if len(items) >= BLOCK_ITEMS:
                        close()
                yield from out()
        close()
        yield from out()

    return narrow.mapInArrow(run, PIECES)


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))

"""Operator 1: document fingerprints by winnowing.

A text's k-grams of code points get rolling 64-bit hashes. From every window of
w consecutive hashes the smallest is chosen, the rightmost one on ties, and its
position is kept. Two texts that share a run of k + w - 1 code points share a
chosen hash, and matches shorter than k are never reported.

Defined cases: a text shorter than k is one gram (the whole text); fewer than w
grams are one window; an empty or null text has no marks, and two such texts
have likeness 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import cut, map_arrow, prepare, read_table
from canvass.llm.ordered import deal, range_bounds, range_number
from canvass.llm.words import U64, mix, random64

#: Code points of a gram, grams of a window: runs of 16 + 15 = 31 code points are always found.
K, W = 16, 16

_BASE = U64(0xD1342543DE82EF95)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SEED = random64(71, 1)[0]
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        grown = np.full(max(n, 1 << 15), base, dtype=U64)
        grown[0] = 1
        held = _POWERS[int(base)] = np.cumprod(grown, dtype=U64)
    return held[:n]


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Rolling hash of every k-gram: differences of running sums, brought to one power."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    n = len(points)
    if not n:
        return np.zeros(0, dtype=U64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        value = mix(points + _SEED)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(value * _powers(_BASE, n), dtype=U64)))
        rolled = (sums[k:] - sums[:n - k + 1]) * _powers(_BASE_INVERSE, n - k + 1)
        return mix(rolled + U64(k))


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen grams, in text order."""
    hashes = gram_hashes(text or "", k)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes
    w = min(w, n)
    # place of the rightmost smallest hash of each window, by doubling spans
    best, span = np.arange(n), 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    chosen = np.unique(best)
    return chosen, hashes[chosen]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of chosen hashes; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(marks: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex digest of positions and hashes: equal marks, equal digest."""
    return hashlib.sha256(marks[0].astype("<i8").tobytes() + marks[1].astype("<u8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, n_chars, positions, hashes) of every row; ids may be null or repeat, other columns are ignored."""
    prepare(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        marks = [winnow(t, k, w) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()),
             pa.array([m[0] for m in marks], pa.list_(pa.int64())),
             pa.array([m[1].view(np.int64) for m in marks], pa.list_(pa.int64()))],
            names=["doc_id", "n_chars", "positions", "hashes"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel,
                     "doc_id long, n_chars long, positions array<bigint>, hashes array<bigint>", "text")


def with_successor(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (range, tail, doc_id, text), sorted by descending id inside one partition per id range.

    A range's last row is followed by its successor, marked `tail`: the first
    rows of the next lower range that has any, and for the lowest range those
    of the highest one.
    """
    bounds = range_bounds(docs, "doc_id")
    ranged = docs.withColumn("range", range_number("doc_id", bounds))
    # one row a range; null ids stand below all others in descending order, so they go to the lowest range
    ranged = ranged.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("range")))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    held = sorted(tops)
    goes = {}  # top id of a range -> the range that it follows
    for i, number in enumerate(held):
        follows = held[(i + 1) % len(held)]
        goes.setdefault(tops[number], []).append(follows)
    extra = F.array().cast("array<struct<range:int,tail:boolean>>")
    for top, follows in goes.items():
        more = F.array(*[F.struct(F.lit(f).cast("int").alias("range"), F.lit(True).alias("tail")) for f in follows])
        extra = F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")), more).otherwise(extra)
    own = F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("tail")))
    placed = ranged.withColumn("place", F.explode(F.concat(own, extra)))
    rows = placed.select("place.range", "place.tail", "doc_id", "text")
    n = len(bounds) + 1
    return deal(rows, "range", n, [F.col("range"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_last()]), n


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_marks long, n_edited_marks long")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text (end replaced by the next document's beginning)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = with_successor(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, None  # the row that waits for its successor: (doc_id, text, marks)
        for batch in batches:
            for part in cut(batch, "text"):
                out = []
                for r, tail, doc, text in zip(*(part.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")), strict=True):
                    if r != number:
                        held, number = None, r
                    if tail and held is None:
                        continue
                    text = text or ""
                    marks = winnow(text)
                    if held is not None:
                        own_id, own, own_marks = held
                        n = len(own) // 3
                        edited = own[:len(own) - n] + text[:n]
                        edited_marks = own_marks if edited == own else winnow(edited)
                        out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                    digest(own_marks), digest(edited_marks), likeness(own_marks[1], edited_marks[1]),
                                    likeness(own_marks[1], marks[1]), len(own_marks[0]), len(edited_marks[0])))
                    held = None if tail else (doc, text, marks)
                if out:
                    cols = zip(*out, strict=True)
                    names = [f.split() for f in EDITED.split(", ")]
                    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, names, strict=True)],
                                                     names=[n for n, _ in names])

    return rows.mapInArrow(run, EDITED)

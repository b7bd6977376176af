"""Operator 13: removal of repeated byte strings by suffix arrays built from Lyndon-prefix groups.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else, in the same document or
another one. Which strings (windows) repeat is read off suffix arrays: equal windows are
neighbours there. `suffix_groups` builds them; this module deals the corpus so that
every window meets its equals in one bounded suffix array.

1. Each window is owned by the least hashed GRAM-byte string in it (the leftmost of equal ones), which
   depends on its bytes only. Neighbouring windows of one owner form a context. A window can
   only repeat if its owner's gram occurs twice, so other contexts go.
2. Contexts are dealt by gram. Equal contexts are one with a count; with a count of 2 or more all
   their windows repeat, which takes care of copies before anything is gathered.
3. Grams whose contexts differ are the shards. A shard of more than SHARD different contexts is split:
   its windows by the place of the gram in them (four ranges), and each range by the bytes that all its windows
   share. A range of one place shares the whole window, so this ends after few rounds, and a line or
   passage that any number of documents share is never gathered in one task.
4. Each shard's contexts are sorted as one text by linear grouping; neighbouring windows with equal
   bytes repeat.

Identical texts have identical results, so rows are named by a 128-bit hash of their text inside.

Defined cases: null text is empty; a text shorter than LENGTH loses nothing; rows that repeat, also by
id, are texts of their own, so both lose what they share; a null id is kept as it is; bytes are
judged on the input, so all copies of a passage go; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import SLICE_BYTES, map_arrow, parallelism, prepare, read_table, staged
from canvass.llm.suffix_groups import Suffixes, ranges
from canvass.llm.words import BYTE_VALUE, MULTIPLIER, U64, mix, random64, text_bytes

#: Bytes of a window; bytes of the gram that owns it.
LENGTH, GRAM = 200, 32
#: Places of the gram in a window.
PLACES = LENGTH - GRAM + 1
#: Different contexts of one suffix array, and bytes of contexts that a task sorts in one go.
SHARD, SORT_BYTES = 16, 2 * SLICE_BYTES
#: Parts into which a range of places is split.
PARTS = 4

_ROW, _OTHER = random64(13, 2)
_LOW = U64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the `gram` (a power of two) bytes from each byte on."""
    with np.errstate(over="ignore"):
        out, width, power = BYTE_VALUE[data], 1, MULTIPLIER
        while width < gram:
            out = out[:-width] * power + out[width:] if len(out) > width else out[:0]
            power, width = power * power, 2 * width
        return mix(out)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~U64(0), dtype=U64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def contexts_of(data: np.ndarray, bounds: np.ndarray):
    """(text, first window, last window, owner, gram, a, b) of each context; positions in `data`, (a, b) names its bytes and owner's place."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, dtype=d) for d in (np.int64,) * 4 + (U64,) * 3)
    hashes = gram_hashes(data)
    owner = (least_of((hashes & ~_LOW) | np.arange(len(hashes), dtype=U64), PLACES) & _LOW).astype(np.int64)
    size = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    windows = ranges(bounds[:-1], size)
    text = np.repeat(np.arange(len(size)), size)
    own = owner[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first, last = windows[at], windows[np.append(at[1:], len(windows)) - 1]
    own, text = own[at], text[at]
    with np.errstate(over="ignore"):
        a = mix((last - first).astype(U64) * U64(1 << 32) + (own - first).astype(U64))
        b = a ^ _OTHER
        for step in range(0, LENGTH + PLACES - 1, GRAM):
            here = hashes[np.minimum(first + step, last + LENGTH - GRAM)]
            a, b = mix(a * _ROW + here), mix((b ^ here) * _OTHER + U64(step))
    return text, first, last, own, hashes[own], a, b


def named(docs: DataFrame, text_col: str) -> list:
    """Columns (t1, t2): a 128-bit hash of the text, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(13), text).alias("t2")]


def context_table(texts: DataFrame) -> DataFrame:
    """(gram, a, b, t1, t2, first, windows, place) of every context of (t1, t2, text)."""
    names = ["gram", "a", "b", "t1", "t2", "first", "windows", "place"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = text_bytes(batch.column("text"))
        text, first, last, own, gram, a, b = contexts_of(data, bounds)
        t1, t2 = (batch.column(c).to_numpy()[text] for c in ("t1", "t2"))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x.view(np.int64)) for x in (gram, a, b)), pa.array(t1), pa.array(t2),
             pa.array((first - bounds[text]).astype(np.int32)), pa.array((last - first + 1).astype(np.int16)), pa.array((own - first).astype(np.int16))],
            names=names)

    return map_arrow(texts.where(F.octet_length("text") >= LENGTH), kernel,
                     "gram long, a long, b long, t1 long, t2 long, first int, windows short, place short", "text")


def shard_rows(contexts: DataFrame, texts: DataFrame) -> DataFrame:
    """(shard, lo, hi, n, t1, t2, first, place, bytes) of one row of each context, with its bytes."""
    asked = contexts.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "n", "first", "windows", "place")).alias("asked"))
    rows = texts.hint("merge").join(asked, ["t1", "t2"]).select("t1", "t2", "text", "asked")

    def kernel(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out, seen = [], set()
        for t1, t2, text, asked in zip(*(batch.column(c) for c in ("t1", "t2", "text", "asked")), strict=True):
            # identical texts lie together and would bring the same contexts
            if (t1, t2) in seen:
                continue
            seen.add((t1, t2))
            body, asked = text.as_buffer(), asked.values
            cols = {k: asked.field(k).to_numpy() for k in ("gram", "n", "first", "windows", "place")}
            view = memoryview(body)
            size = len(cols["gram"])
            out.append(pa.RecordBatch.from_pydict({
                "shard": pa.array([int(g).to_bytes(8, "little", signed=True) for g in cols["gram"]], pa.binary()),
                "lo": np.zeros(size, np.int16), "hi": np.full(size, PLACES - 1, np.int16), "n": cols["n"],
                "t1": pa.array([t1.as_py()] * size, pa.int64()), "t2": pa.array([t2.as_py()] * size, pa.int64()),
                "first": cols["first"], "place": cols["place"],
                "bytes": pa.array([bytes(view[f:f + w + LENGTH - 1]) for f, w in zip(cols["first"].tolist(), cols["windows"].tolist(), strict=True)], pa.binary())}))
        return out

    found = map_arrow(rows, kernel, "shard binary, lo short, hi short, n long, t1 long, t2 long, first int, place short, bytes binary", "text")
    return found.groupBy("shard", "lo", "hi", "place", "bytes").agg(F.max("n").alias("n"), *(F.first(c).alias(c) for c in ("t1", "t2", "first")))


def split(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows of oversized shards by ranges of the gram's place, each range by the bytes that all its windows share."""
    names = ["shard", "lo", "hi", "n", "t1", "t2", "first", "place", "bytes"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for shard, lo, hi, n, t1, t2, first, place, body in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            windows = len(body) - LENGTH + 1
            width = -(-(hi - lo + 1) // parts)
            for low in range(lo, hi + 1, width):
                high = min(hi, low + width - 1)
                a, b = max(0, place - high), min(windows - 1, place - low)
                if a <= b:
                    key = hashlib.blake2b(shard + bytes([low]) + body[place - low:place - high + LENGTH], digest_size=16)
                    out.append((key.digest(), low, high, n, t1, t2, first + a, place - a, body[a:b + LENGTH]))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(),
                                                                                 pa.int32(), pa.int16(), pa.binary()), strict=True)], names=names)

    return map_arrow(rows.select(*names), kernel, "shard binary, lo short, hi short, n long, t1 long, t2 long, first int, place short, bytes binary")


def repeated_windows(bodies: list[bytes], shards: list[int]) -> list[np.ndarray]:
    """For each body, which of its windows occur twice among the bodies of its shard (numbers ascending), by suffix arrays."""
    shards_ = np.array(shards)
    edge = np.flatnonzero(np.concatenate(([True], shards_[1:] != shards_[:-1])))
    texts = [b"".join(bodies[a:b]) for a, b in zip(edge, np.append(edge[1:], len(bodies)), strict=True)]
    found = Suffixes(texts)
    sizes = np.array([len(b) for b in bodies])
    # where each body starts among the positions, which have an end mark before each text
    begin = np.cumsum(sizes) - sizes + 1 + np.cumsum(np.isin(np.arange(len(bodies)), edge)) - 1
    window = np.zeros(len(found.data), dtype=bool)
    window[ranges(begin, sizes - LENGTH + 1)] = True
    rows = found.order[window[found.order]]
    text = np.searchsorted(found.stop, rows)
    data = found.data
    eight = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(U64).ravel() if len(data) >= 8 else np.zeros(0, U64)
    pairs = np.flatnonzero(text[1:] == text[:-1])
    for at in (LENGTH - 8, *range(0, LENGTH - 8, 8)):
        pairs = pairs[eight[rows[pairs] + at] == eight[rows[pairs + 1] + at]]
    twice = np.zeros(len(data), dtype=bool)
    twice[rows[pairs]] = True
    twice[rows[pairs + 1]] = True
    return [twice[b:b + s - LENGTH + 1] for b, s in zip(begin, sizes, strict=True)]


def sorted_spans(rows: DataFrame) -> DataFrame:
    """(t1, t2, start, stop): bytes of single contexts that repeated windows cover, from each shard's suffix array."""
    n = parallelism(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(part: list[dict]) -> pa.RecordBatch:
            number, shards = 0, []
            for i, r in enumerate(part):
                number += i > 0 and r["shard"] != part[i - 1]["shard"]
                shards.append(number)
            spans = []
            for r, twice in zip(part, repeated_windows([r["bytes"] for r in part], shards), strict=True):
                if r["n"] == 1 and twice.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], twice.view(np.int8), [0]))))
                    spans += [(r["t1"], r["t2"], r["first"] + int(a), r["first"] + int(b) - 1 + LENGTH) for a, b in edge.reshape(-1, 2)]
            cols = list(zip(*spans, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["t1", "t2", "start", "stop"])

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SORT_BYTES and row["shard"] != held[-1]["shard"]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield out(held)

    dealt = rows.select("shard", "n", "t1", "t2", "first", "bytes").repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "t1 long, t2 long, start long, stop long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(t1, t2, start, stop) of (t1, t2, text): overlapping byte ranges that repeated windows cover."""
    places = staged(context_table(texts), "contexts")
    twice = staged(places.groupBy("gram").agg(F.count("*").alias("of_gram")).where("of_gram > 1").select("gram"), "grams")
    places = staged(places.hint("merge").join(twice, "gram"), "shared")
    contexts = staged(places.groupBy("gram", "a", "b").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("t1", "t2", "first", "windows", "place"))),
                      "different")
    whole = F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") + (LENGTH - 1)).cast("long").alias("stop")
    spans = [places.hint("merge").join(contexts.where("n > 1").select("gram", "a", "b"), ["gram", "a", "b"]).select("t1", "t2", *whole)]

    mixed = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.count(F.expr("if(n = 1, 1, null)")).alias("single")).where("m > 1 and single > 0")
    rows = staged(shard_rows(contexts.hint("merge").join(mixed.select("gram"), "gram"), texts), "rows")
    while True:
        sizes = rows.groupBy("shard").agg(F.count("*").alias("m"), F.count(F.expr("if(n = 1, 1, null)")).alias("single"))
        sizes = staged(sizes.where("m > 1 and single > 0"), "shards")
        spans.append(sorted_spans(rows.hint("merge").join(sizes.where(F.col("m") <= SHARD).select("shard"), "shard")))
        large = sizes.where(F.col("m") > SHARD).select("shard")
        if large.isEmpty():
            break
        parts = staged(split(rows.hint("merge").join(large, "shard")), "parts")
        key = ["shard", "lo", "hi", "place", "bytes"]
        equal = staged(parts.groupBy(*key).agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("t1", "t2", "first"))), "rows")
        # single contexts whose part is equal to another's repeat there
        spans.append(parts.where("n = 1").hint("merge").join(equal.where("n > 1").select(*key), key).select(
            "t1", "t2", F.col("first").cast("long").alias("start"), (F.col("first") + F.length("bytes")).cast("long").alias("stop")))
        rows = equal
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    return found


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's bytes without the repeated ones; `kept` is binary, for a cut may split a character."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), *named(docs, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = (repeated_spans(texts.select("t1", "t2", "text")).groupBy("t1", "t2")
             .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")))
    rows = texts.hint("merge").join(staged(spans, "spans"), ["t1", "t2"], "left")
    whole = rows.where("spans is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                               F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            view = memoryview(text.as_buffer()) if len(text.as_py()) else memoryview(b"")
            start, stop = (spans.values.field(c).to_numpy() for c in ("start", "stop"))
            reach = np.maximum.accumulate(stop)
            new = np.concatenate(([True], start[1:] > reach[:-1]))
            start, stop = start[new], reach[np.append(np.flatnonzero(new)[1:], len(reach)) - 1]
            kept = b"".join(view[a:b] for a, b in zip(np.append(0, stop), np.append(start, len(view)), strict=True))
            out.append((len(view), int((stop - start).sum()), len(start), kept))
        n_bytes, n_removed, n_spans, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = dict(texts.dtypes)["doc_id"]
    touched = map_arrow(rows.where("spans is not null").select("doc_id", "text", "spans"), kernel,
                        f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary", "text")
    return whole.unionByName(touched)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that occur twice in the corpus."""
    return deduplicated(read_table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Operator 2: MinHash near-duplicates by a multi-index Hamming join.

Signature: POSITIONS minwise hashes of a document's word shingles, of b = 16
bits each. Its distance is the number of positions that differ. The signature is
split into CHUNKS chunks; if two signatures differ in at most
CHUNKS * (ERRORS + 1) - 1 = 15 positions, some chunk differs in at most ERRORS
(pigeonhole). Enumerating which position of a chunk may be wrong gives the join
keys, so every pair within that distance shares a key. A pair at the link
threshold 0.85 differs in 4.8 of 32 positions on average and is beyond 15 with
probability 4e-6. Every link is then confirmed on the full shingle sets.

Documents with equal sets are one class with one representative. Links are
only needed up to connection, so no group is expanded into pairs: in each round
the members of a key are compared with one centre of the key unless they are connected
already. The first centre is the key's most connected member (the one whose keys hold most
documents); each later round takes another, so two parts of a group that one centre
did not join meet through the next. When rounds bring nothing more, what is still apart is compared through an
exact prefix filter on the full sets: first one member of each component against the
others, again with other members as long as that joins components, then all members of the components that are still
apart, if their signatures are within the distance. So no link between components is lost.

Defined cases: null or empty text (or text of blanks) has an empty set and is
linked with nothing; fewer than k words are one shingle; rows that repeat an id
are alike; a row with a null id takes part by its text and is never kept; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import discard, map_arrow, prepare, read_table, staged
from canvass.llm.components import connected
from canvass.llm.words import BLANKS, LOWER, U64, doc_shingles, mix, random64, text_bytes, word_bounds, word_hashes

SHINGLE = 5
POSITIONS, CHUNKS, ERRORS = 32, 8, 1
#: 100 * intersection >= LINK * union
LINK = 85
#: Rounds of comparing with a centre of each key at most, and rounds in a row that may join nothing.
ROUNDS, IDLE = 4, 1
#: Rounds of the prefix filter on one member of each component at most.
SAMPLED = 1
#: Set sizes of one class of the prefix filter differ by less than this factor.
SIZE_STEP = 1.03
#: 64-bit words of a set's parity bitmap; a power of two.
BITMAP = 8

_SALT = random64(5, POSITIONS)
_ODD = random64(6, POSITIONS) | U64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ASCII lower case, words between blanks."""
    data, bounds = text_bytes(column)
    data = LOWER[data]
    begin, end, at = word_bounds(data, bounds, BLANKS)
    hashes = word_hashes(data, begin, end)
    return [doc_shingles(hashes[a:b], k) for a, b in itertools.pairwise(at)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS 16-bit minwise hashes of a non-empty set."""
    with np.errstate(over="ignore"):
        return np.array([(((shingles ^ s) * o) >> U64(16)).min() & U64(0xFFFF) for s, o in zip(_SALT, _ODD, strict=True)], dtype=np.uint16)


def _names(shingles: np.ndarray) -> tuple:
    """Two 64-bit hashes that name a set."""
    with np.errstate(over="ignore"):
        return mix(shingles).sum(dtype=U64), mix(shingles + U64(77)).sum(dtype=U64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sign) of every row; set_a and set_b are a 128-bit hash of the set."""
    prepare(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), k)
        a, b = np.array([_names(s) for s in sets], dtype=U64).reshape(-1, 2).T.copy()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
             pa.array([signature(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "sign"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel,
                     "doc_id long, n_shingles long, set_a long, set_b long, sign binary", "text")


def _keyed(reps: DataFrame) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs = [np.frombuffer(s, "<u2") for s in batch.column("sign").to_pylist()]
        m = np.stack(signs).astype(U64)
        size = POSITIONS // CHUNKS
        keys = []
        for chunk in range(CHUNKS):
            for wrong in itertools.combinations(range(size), ERRORS):
                value = np.full(len(m), chunk * 64 + sum(1 << p for p in wrong), dtype=U64)
                with np.errstate(over="ignore"):
                    for p in range(size):
                        if p not in wrong:
                            value = mix(value ^ (m[:, chunk * size + p] + U64(0x9E3779B97F4A7C15)))
                keys.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("rep").to_numpy(), len(keys))), pa.array(np.stack(keys, axis=1).ravel().view(np.int64))],
            names=["rep", "key"])

    return map_arrow(reps.select("rep", "sign"), kernel, "rep long, key long")


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most CHUNKS * (ERRORS + 1) - 1 positions."""
    limit = CHUNKS * (ERRORS + 1) - 1
    signs = reps.select("rep", "sign")
    both = (pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, POSITIONS) for c in ("sign_a", "sign_b"))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
            pa.array((a != b).sum(axis=1) <= limit))

    return map_arrow(both.select("a", "b", "sign_a", "sign_b"), kernel, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Pairs whose full sets are alike: 100 * intersection >= link * union."""
    both = pairs.join(sets.toDF("a", "set_of_a"), "a").join(sets.toDF("b", "set_of_b"), "b")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("set_of_a"), batch.column("set_of_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if 100 * min(len(x), len(y)) < link * max(len(x), len(y)):
                keep.append(False)
                continue
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            keep.append(100 * common >= link * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "set_of_a", "set_of_b"), kernel, "a long, b long", "set_of_a")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(signatures(narrow, k=k), "signatures")
    # one node per distinct set: `rep` names the set, `doc_id` is its smallest document
    # (equal sets have equal signatures, which are part of the grouping only to be carried along)
    reps = staged(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "sign").agg(F.min("doc_id").alias("doc_id"))
                  .select(F.col("set_a").alias("rep"), "set_b", "doc_id", "sign"), "classes")
    keyed = _keyed(reps)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(keyed.join(shared, "key"), "members")
    sets = _full_sets(narrow, reps.join(members.select("rep").distinct(), "rep", "left_semi"), k)

    links = roots = tried = None
    turn = idle = 0

    def joined(pairs: DataFrame) -> bool:
        """Confirm pairs that were not tried yet; whether a link was among them."""
        nonlocal links, roots, tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(_near(pairs, reps), "pairs")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.union(pairs)
        found = staged(_confirmed(pairs, sets, link), "found")
        if found.isEmpty():
            return False
        links = found if links is None else links.union(found)
        roots = connected(links)
        return True

    def still_apart() -> DataFrame:
        """(key, rep, n, root) of the keys whose members are not all connected."""
        here = members.withColumn("root", F.col("rep"))
        if roots is not None:
            here = members.join(roots, members["rep"] == roots["node"], "left").select(
                "key", "rep", "n", F.coalesce("root", "rep").alias("root"))
        open_keys = here.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return staged(here.join(open_keys, "key", "left_semi"), "open")

    here = still_apart()
    while not here.isEmpty() and turn < ROUNDS and idle < IDLE:
        idle = 0 if joined(_with_centres(here, turn)) else idle + 1
        turn += 1
        if not idle:
            before, here = here, still_apart()
            discard(before)
    if not here.isEmpty():
        nodes = here.select("rep", "root").distinct()
        for sample in range(SAMPLED):
            one = nodes.groupBy("root").agg(F.min(_shuffled("rep", turn + sample)).alias("x")).select(_shuffled("x", turn + sample).alias("rep"), "root")
            if not joined(_sharing_prefix(one, sets, link)):
                break
            before, here = here, still_apart()
            discard(before)
            nodes = here.select("rep", "root").distinct()
        if not here.isEmpty():
            joined(_sharing_prefix(nodes, sets, link))

    labelled = reps.select("rep", "set_b", "doc_id", F.col("rep").alias("root"))
    if roots is not None:
        labelled = reps.join(roots, reps["rep"] == roots["node"], "left").select(
            "rep", "set_b", "doc_id", F.coalesce("root", "rep").alias("root"))
    component = labelled.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = labelled.join(component, "root").select(F.col("rep").alias("set_a"), "set_b", "component")
    out = signed.join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


_MASK = [int(x) for x in random64(7, 64).view(np.int64)]


def _shuffled(rep: str, turn: int) -> Column:
    """The hash `rep` with some bits flipped: another order of the same numbers each turn, and its own inverse."""
    return F.col(rep).bitwiseXOR(F.lit(_MASK[turn % len(_MASK)]))


def _with_centres(here: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of the members of each key with its centre of this turn, if they are not connected."""
    if turn == 0:
        # the member whose keys hold most documents; degree and member in one number, which a hash aggregation can compare
        degree = here.groupBy("rep").agg(F.sum("n").alias("degree"))
        wide = "cast(18446744073709551616 as decimal(38,0))"
        packed = F.expr(f"cast(degree as decimal(38,0)) * {wide} + (cast(rep as decimal(38,0)) + cast(9223372036854775808 as decimal(38,0)))")
        best = here.join(degree, "rep").groupBy("key").agg(F.max(packed.cast("decimal(38,0)")).alias("x"))
        centre = best.select("key", F.expr(f"cast(x % {wide} - cast(9223372036854775808 as decimal(38,0)) as bigint)").alias("b"))
    else:
        centre = here.groupBy("key").agg(F.min(_shuffled("rep", turn)).alias("x")).select("key", _shuffled("x", turn).alias("b"))
    root = here.select(F.col("rep").alias("b"), F.col("root").alias("root_b")).distinct()
    return here.join(centre.join(root, "b"), "key").where("root <> root_b").select(
        F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))


def _sharing_prefix(nodes: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Pairs (a, b) of nodes (rep, root) of different roots that may be linked, by exact prefix filtering.

    Sets of x <= y shingles are linked if they share at least link * (x + y) /
    (100 + link). With shingles in one order, rarest first, they then share one
    of the first x - shared + 1 and y - shared + 1. The smaller set is listed
    under its size class, with the prefix that a partner of its own size needs;
    the larger one asks each size class that it can be linked with, with the
    prefix that the class's least size needs. A common shingle counts if what
    follows it on either side still suffices, and if the sets can differ in few
    enough shingles: those that only one node has, and at least as many others
    as bits of the sets' parity bitmaps differ (a bitmap filter).

    A shingle that only one node has cannot be shared: it takes a place of the
    prefix and no row, so the members of a large group that differ in words of
    their own meet nobody.
    """
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("shingles")]
        size = np.array([len(x) for x in parts])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("rep").to_numpy(), size)), pa.array(np.repeat(batch.column("root").to_numpy(), size)),
             pa.array(np.repeat(size, size)), pa.array(np.concatenate(parts))], names=["rep", "root", "size", "shingle"])

    rows = map_arrow(nodes.join(sets, "rep").select("rep", "root", "shingles"), kernel,
                     "rep long, root long, size long, shingle long", "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 1")
    ranked = (rows.join(common, "shingle").groupBy("rep", "root", "size")
              .agg(F.sort_array(F.collect_list(F.struct("n", "shingle", (F.col("lo") < F.col("hi")).alias("open")))).alias("shared"),
                   *(F.expr(f"bit_xor(if((shingle & {BITMAP - 1}) = {i}, shiftleft(1L, cast(shiftright(shingle, 8) & 63 as int)), 0L))").alias(f"bits{i}")
                     for i in range(BITMAP)))
              .withColumn("alone", F.col("size") - F.size("shared")))
    # the longest prefix, that for the smallest partner
    least = F.expr(f"({link} * size + 99) div 100")
    places = F.col("size") - least + 1 - F.col("alone")
    bits = [f"bits{i}" for i in range(BITMAP)]
    heads = staged(ranked.where(places > 0).select("rep", "root", "size", "alone", *bits, F.slice("shared", F.lit(1), places.cast("int")).alias("head")),
                   "heads")

    def needed(x: str, y: str) -> str:
        return f"(({link} * ({x} + {y}) + {99 + link}) div {100 + link})"

    def listed(df: DataFrame, partner: str) -> DataFrame:
        """One row a shingle of the prefix for partners of at least `partner` shingles; `rest`: shingles from it on."""
        n = F.expr(f"cast(size - {needed('size', partner)} + 1 - alone as int)")
        return (df.withColumn("n", n).where("n > 0")
                .select("rep", "root", "size", "alone", *bits, "class", F.posexplode(F.slice("head", F.lit(1), F.col("n"))).alias("at", "x"))
                .where("x.open").select("rep", "root", "size", "alone", *bits, F.expr("size - alone - at").alias("rest"), "class", "x.shingle"))

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size) / math.log(SIZE_STEP))

    smaller = listed(heads.withColumn("class", size_class(F.col("size"))), "size")
    asked = heads.withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.col("size")))))
    # a little below the class's edge, so that rounding loses no size
    floor = F.greatest(least, F.ceil(F.pow(F.lit(SIZE_STEP), "class") * (1 - 1e-9)).cast("long"))
    larger = listed(asked.withColumn("floor", floor), "floor")
    larger = larger.withColumnsRenamed({c: f"{c}_b" for c in larger.columns if c not in ("shingle", "class")})
    differing = " + ".join(f"bit_count({b} ^ {b}_b)" for b in bits)
    fits = ((F.struct("size", "rep") < F.struct("size_b", "rep_b")) & (F.col("root") != F.col("root_b"))
            & (F.least("rest", "rest_b") >= F.expr(needed("size", "size_b")))
            & F.expr(f"alone + alone_b + {differing} <= size + size_b - 2 * {needed('size', 'size_b')}"))
    return smaller.join(larger, ["shingle", "class"]).where(fits).select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"))


def _full_sets(narrow: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, shingles): the full set of each wanted class, from its smallest document."""
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), k)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([_names(s)[0] for s in sets], dtype=U64).view(np.int64)),
             pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])

    texts = narrow.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    found = map_arrow(texts, kernel, "rep long, shingles binary", "text")
    # an id that rows repeat brings texts of other classes along
    return staged(found.join(wanted.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "sets")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))

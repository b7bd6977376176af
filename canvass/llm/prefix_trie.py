"""Operator 12: the prefix trie of rebuilt conversations, as a burst trie.

A conversation is the sequence of its turns' ids (16 bytes of role and text). Equal sequences are one
entry with a count. A container holds the suffixes of all sequences under one trie head. It starts as
one container under the root; a container of more than `limit` distinct suffixes is burst by their
next turn id into a container for each, and its head becomes a node above them. What remains
is dealt by head, sorted, and swept with a stack into nodes: a node ends where the next suffix leaves
its prefix, and hands its sums to its parent. Burst heads get the sums of the containers below them
by one aggregation over each container's list of heads above.

Size: a container is at most `limit` suffixes in one task, whatever turn or conversation is common;
each round bursts all oversized containers at once, so there are as many rounds as turns in the longest
prefix that more than `limit` distinct conversations share. One conversation's turn ids must fit in a
row; texts are never shuffled. The ids that end at one node are hashed in one stream, as SHA-256
needs, from chunks that sorted ranges have joined; nothing holds them all.

Defined cases: rows with a null conv_id belong to no conversation and are left out; turns of one
number are ordered by the MD5 of role and text, repeated rows stay turns of their own; null role or text is
empty; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.common import parallelism, prepare, read_table, staged

#: Distinct suffixes that one container may hold.
LIMIT = 1000
#: Conversations of one family share the first one's head, of at most HEADS - 1 turns.
FAMILY, HEADS = 5, 9
#: Burst containers whose sizes are broadcast at most.
FEW = 100_000
#: Ids in one chunk of a node's list of ends.
CHUNK = 4096


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id, bytes) of every turn, places from 1."""
    named = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = named.select("conv_id", "turn", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("turn_id"),
                         F.octet_length("text").cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return named.withColumn("place", F.row_number().over(order)).drop("turn")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation with the head of its family's first one, as turn ids and bytes."""
    convs = numbered.select("conv_id").distinct().select(
        "conv_id", F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"),
        F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {HEADS} as int)").alias("head"))
    own = numbered.join(convs, "conv_id").where("place > head").select("conv_id", F.lit(1).alias("part"), "place", "turn_id", "bytes")
    first = numbered.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("place <= head").select("conv_id", F.lit(0).alias("part"), "place", "turn_id", "bytes")
    found = heads.unionByName(own).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "place", "turn_id", "bytes"))).alias("t"))
    none = F.array().cast("array<binary>"), F.array().cast("array<bigint>")
    return convs.select("conv_id").join(found, "conv_id", "left").select(
        "conv_id", F.coalesce(F.col("t.turn_id"), none[0]).alias("path"), F.coalesce(F.col("t.bytes"), none[1]).alias("sizes"))


def ends_of(members: DataFrame) -> DataFrame:
    """(leaf, ends_sha256) of (leaf, conv_id): the hash of a leaf's ids, ascending, comma-joined."""
    n = parallelism(members.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def row():
            return pa.RecordBatch.from_pydict({"leaf": pa.array([held], pa.binary()), "first": pa.array([ids[0]], pa.int64()),
                                               "ids": [",".join(map(str, ids))]})
        for batch in batches:
            for leaf, conv in zip(batch.column("leaf").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (leaf != held or len(ids) == CHUNK):
                    yield row()
                    ids = []
                held = leaf
                ids.append(conv)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state = None

        def row():
            return pa.RecordBatch.from_pydict({"leaf": pa.array([held], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for leaf, ids in zip(batch.column("leaf").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if state is not None and leaf == held:
                    state.update(b",")
                else:
                    if state is not None:
                        yield row()
                    held, state = leaf, hashlib.sha256()
                state.update(ids.encode())
        if state is not None:
            yield row()

    ranges = members.repartitionByRange(n, "leaf", "conv_id").sortWithinPartitions("leaf", "conv_id")
    joined = ranges.mapInArrow(chunks, "leaf binary, first long, ids string")
    return joined.repartition(n, "leaf").sortWithinPartitions("leaf", "first").mapInArrow(hashed, "leaf binary, ends_sha256 string")


class Node:
    """A node of a container while it is swept."""

    def __init__(self, depth: int, size: int, parent: Node | None):
        self.depth, self.size, self.parent = depth, size, parent
        self.conv, self.convs, self.children, self.leaves, self.saved, self.leaf = None, 0, 0, 0, 0, None

    def add(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def close(self) -> None:
        """All below is in: hand the sums up."""
        self.leaves = self.leaves or 1
        self.saved += (self.convs - 1) * self.size
        if self.parent:
            self.parent.add(self.conv, self.convs)
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def sweep(rows: list[dict]) -> list[Node]:
    """Nodes of one container, its head first: rows (depth, head_size, path, sizes, n, conv_id, leaf) sorted by path."""
    top = Node(rows[0]["depth"], rows[0]["head_size"], None)
    nodes, stack, before = [top], [top], []
    for row in rows:
        path, same = row["path"], 0
        while same < len(before) and same < len(path) and before[same] == path[same]:
            same += 1
        while len(stack) > same + 1:
            stack.pop().close()
        for size in row["sizes"][same:]:
            stack.append(Node(stack[-1].depth + 1, size, stack[-1]))
            nodes.append(stack[-1])
        stack[-1].add(row["conv_id"], row["n"])
        stack[-1].leaf = row["leaf"]
        before = path
    while stack:
        stack.pop().close()
    return nodes


NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                  ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("leaf", pa.binary()), ("above", pa.list_(pa.binary()))])


def swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers; `above` is the heads over a container's own head, null for other nodes."""
    n = parallelism(containers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out():
            nodes = sweep(held)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                [y.conv for y in nodes], [y.depth for y in nodes], [y.parent.conv if y.parent else held[0]["parent_conv"] for y in nodes],
                [y.convs for y in nodes], [y.children for y in nodes], [y.leaves for y in nodes], [y.saved for y in nodes],
                [y.leaf for y in nodes], [None if y.parent else held[0]["above"] for y in nodes]), NODE, strict=True)], schema=NODE)
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["head"] != held[0]["head"]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    dealt = containers.repartition(n, "head").sortWithinPartitions("head", "path")
    return dealt.mapInArrow(run, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                 "saved_tokens long, leaf binary, above array<binary>")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    prepare(conversations.sparkSession)
    leaf = F.expr("unhex(md5(array_join(transform(path, x -> hex(x)), '')))")
    sequences = staged(rebuilt(turns(conversations)).withColumn("leaf", leaf), "sequences")
    # equal sequences are one entry
    entries = sequences.groupBy("leaf", "path", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    several = entries.where("n > 1").select("leaf")
    ends = (entries.where("n = 1").select("leaf", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
            .union(ends_of(sequences.join(several, "leaf", "left_semi").select("leaf", "conv_id"))))

    state = entries.select(F.lit(b"").alias("head"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("head_size"),
                           F.lit(None).cast("long").alias("parent_conv"), F.array().cast("array<binary>").alias("above"),
                           "path", "sizes", "n", "conv_id", "leaf")
    whole, burst = None, None
    while True:
        state = staged(state, "containers")
        over = staged(state.groupBy("head").agg(F.count("*").alias("entries"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("first_conv"))
                      .where(F.col("entries") > limit), "oversized")
        n_over = over.count()
        if n_over <= FEW:
            over = F.broadcast(over)
        small = state.join(over, "head", "left_anti") if n_over else state
        whole = small if whole is None else whole.unionByName(small)
        if not n_over:
            break
        large = state.join(over, "head")
        here = large.groupBy("head", "depth", "head_size", "parent_conv", "above", "n_convs", "first_conv").agg(
            F.max(F.when(F.size("path") == 0, F.col("leaf"))).alias("leaf"))
        burst = here if burst is None else burst.unionByName(here)
        state = large.where(F.size("path") > 0).select(
            F.unhex(F.md5(F.concat("head", F.element_at("path", 1)))).alias("head"), (F.col("depth") + 1).alias("depth"),
            F.element_at("sizes", 1).alias("head_size"), F.col("first_conv").alias("parent_conv"),
            F.concat("above", F.array("head")).alias("above"), F.expr("slice(path, 2, size(path))").alias("path"),
            F.expr("slice(sizes, 2, size(sizes))").alias("sizes"), "n", "conv_id", "leaf")

    nodes = swept(whole)
    if burst is not None:
        nodes, burst = staged(nodes, "nodes"), staged(burst, "heads")
        own = F.expr("(n_convs - 1) * head_size")
        tops = nodes.where("above is not null")
        below = (tops.select(F.explode("above").alias("head"), "n_leaves", "saved_tokens")
                 .unionByName(burst.select(F.explode(F.concat("above", F.array("head"))).alias("head"), F.lit(0).alias("n_leaves"), own.alias("saved_tokens")))
                 .groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        parent = F.element_at("above", -1).alias("head")
        children = (tops.select(parent).unionByName(burst.where(F.size("above") > 0).select(parent))
                    .groupBy("head").agg(F.count("*").alias("n_children")))
        heads = burst.join(below, "head").join(children, "head").select(
            F.col("first_conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", "saved_tokens", "leaf")
        nodes = nodes.drop("above").unionByName(heads)
    return nodes.join(ends, "leaf", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie(read_table(spark, sf_dir, "conversations"))


#: crc32 of a decimal in SQL: each bit step divides by the reflected polynomial 0xEDB88320.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''), "
        "lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295)")

# the first element starts the reduction, so the first step already takes the first digit
OP12_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         octet_length(encode(coalesce(text, '')))::BIGINT AS nb
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM r),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM r)),
m AS (
  SELECT c.conv_id, 0 AS part, place, id, nb FROM c JOIN t ON t.conv_id = c.base WHERE place <= h
  UNION ALL
  SELECT c.conv_id, 1, place, id, nb FROM c JOIN t ON t.conv_id = c.conv_id WHERE place > h),
s AS (
  SELECT c.conv_id, coalesce(x.ids, []) AS ids, coalesce(x.nbs, []) AS nbs
  FROM c LEFT JOIN (SELECT conv_id, list(id ORDER BY part, place) AS ids, list(nb ORDER BY part, place) AS nbs FROM m GROUP BY conv_id) x
  ON x.conv_id = c.conv_id),
p AS (SELECT conv_id, d, ids[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE nbs[d] END AS nb, d = len(ids) AS ends
      FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM s)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(nb) AS saved,
         sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY path, d),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
q AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(generate_series(0, depth)) AS a FROM q) GROUP BY 1)
SELECT q.conv_id, q.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, q.n_convs, q.n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, q.ends_sha256
FROM q JOIN u ON u.path = q.path LEFT JOIN n o ON q.depth > 0 AND o.path = q.path[1:q.depth - 1] AND o.depth = q.depth - 1
"""

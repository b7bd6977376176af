"""Operator 11: phrase collocations by best-first branch-and-bound growth, per language.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and into words between
blanks and tabs. A phrase of 2 or 3 words that occurs `least` times or more scores
floor(1000000 * a * a / (l * r)) at its worst cut; a phrase that lies in a longer one with at least
half its occurrences is dropped; the `top` best of each language are the result.

Words and pairs are counted first. A pair is then a prefix to grow: each phrase that starts with it
has a <= f(pair) and r >= a at the cut after one word, so its score is at most
floor(1000000 * f(pair) / f(first word)): an admissible bound. Growth is best-first: the frontier is
all prefixes whose bound reaches a threshold, which starts at the score of each language's
2 * `top`-th pair. One pass over the texts counts the words that follow the frontier's prefixes, and
those that precede the pairs which score at the threshold or better (their longer phrases decide
whether they survive). All phrases that score at the threshold or better are then known. A
language with `top` survivors at its threshold is settled, ties included; the others go on with a
lower threshold, down to zero, where the frontier is every prefix.

Size: words and pairs meet as counts that each batch of texts adds up first, so a hot word, pair or
language is a few rows a task. A pass takes at most BLOCK frontier prefixes as 64-bit hashes to the
tasks; a larger frontier takes several passes over all texts. A false match of such a hash only counts
a phrase that was not asked for. The words of a phrase are named by 64-bit hashes; the vocabulary
is checked for two words of one hash, which raises an error.

Defined cases: null or empty text has no words; a null language is `und`; a word or piece may be as long
as a text; repeated rows count again; ties in score are ordered by occurrences, then by
phrase; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.common import map_arrow, prepare, read_table, staged
from canvass.llm.words import LOWER, U64, mix, text_bytes, word_bounds, word_hashes

#: Occurrences that make a phrase a candidate; phrases of a language in the result.
LEAST, TOP = 10, 2000
#: A phrase is dropped if a longer one has this share (in percent) of its occurrences.
INSIDE = 50
#: Score of a phrase whose parts never occur without each other.
UNIT = 1_000_000
#: Prefixes of the frontier that one pass over the texts takes to the tasks.
BLOCK = 1 << 19
#: Language of rows without one.
NO_LANG = "und"

#: `[.,;:!?\x0A-\x0D]`, and with blank and tab what lies between words.
PIECE_ENDS = np.zeros(256, dtype=bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = PIECE_ENDS.copy()
BETWEEN[[0x20, 0x09]] = True

_ODD = U64(0x9E3779B97F4A7C15)


class Words:
    """The words of one language in a batch: their distinct hashes, and each word's number among them."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, same_piece: np.ndarray):
        self.hashes, self.first, self.number, self.count = np.unique(
            word_hashes(data, begin, end), return_index=True, return_inverse=True, return_counts=True)
        self.data, self.begin, self.end = data, begin, end
        #: number of the first word of each pair of neighbours within a piece
        self.pairs = np.flatnonzero(same_piece[:-1])
        self.triples = np.flatnonzero(same_piece[:-2] & same_piece[1:-1])

    def strings(self) -> list[str]:
        return [self.data[b:e].tobytes().decode() for b, e in zip(self.begin[self.first], self.end[self.first], strict=True)]

    def pair_of(self, at: np.ndarray) -> np.ndarray:
        """One number for the words at, at + 1."""
        return self.number[at] * len(self.hashes) + self.number[at + 1]


def languages(batch: pa.RecordBatch):
    """(language, Words) of each language of a batch of (lang, text)."""
    data, bounds = text_bytes(batch.column("text"))
    data = LOWER[data]
    begin, end, at = word_bounds(data, bounds, BETWEEN)
    if not len(begin):
        return
    ends = np.concatenate(([0], np.cumsum(PIECE_ENDS[data])))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = np.zeros(len(begin), dtype=bool)
    same[:-1] = (ends[begin[1:]] == ends[end[:-1]]) & (text[1:] == text[:-1])
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy()[text]
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        own = code == i
        if own.any():
            yield lang, Words(data, begin[own], end[own], same[own])


def pair_hash(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of a language's pair of words, for the frontier of a pass."""
    salt = U64(int.from_bytes(lang.encode()[:64].ljust(8, b"\0"), "little") % (1 << 64))
    with np.errstate(over="ignore"):
        return mix(mix(first + salt) * _ODD + second)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def small_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, word, n): every word (w2 null), the pairs that occur `least` times, and each language's total (w1 null)."""
    schema = pa.schema([("lang", pa.string()), ("w1", pa.int64()), ("w2", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def kernel(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for lang, w in languages(batch):
            keys, n = np.unique(w.pair_of(w.pairs), return_counts=True)
            first, second = (w.hashes[x].view(np.int64) for x in np.divmod(keys, len(w.hashes)))
            words, pairs = len(w.hashes), len(keys)
            out.append(pa.RecordBatch.from_arrays([
                pa.array([lang] * (words + pairs + 1), pa.string()),
                pa.array(np.concatenate((w.hashes.view(np.int64), first, [0])), mask=np.arange(words + pairs + 1) == words + pairs),
                pa.array(np.concatenate((np.zeros(words, np.int64), second, [0])), mask=(np.arange(words + pairs + 1) < words) | (np.arange(words + pairs + 1) == words + pairs)),
                pa.array(w.strings() + [None] * (pairs + 1), pa.string()),
                pa.array(np.concatenate((w.count, n, [len(w.number)])).astype(np.int64))], schema=schema))
        return out

    rows = map_arrow(texts, kernel, "lang string, w1 long, w2 long, word string, n long", "text")
    counted = rows.groupBy("lang", "w1", "w2", "word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | F.col("w2").isNull())


def triple_counts(texts: DataFrame, starts: np.ndarray, ends: np.ndarray, least: int) -> DataFrame:
    """(lang, w1, w2, w3, a) of triples whose first pair's hash is in `starts` or whose last pair's is in `ends` (both sorted)."""
    shared = texts.sparkSession.sparkContext.broadcast((starts, ends))

    def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.zeros(len(keys), dtype=bool)
        return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys

    def kernel(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        starts, ends = shared.value
        out = []
        for lang, w in languages(batch):
            at = w.triples
            pairs, number = np.unique(np.concatenate((w.pair_of(at), w.pair_of(at + 1))), return_inverse=True)
            first, second = np.divmod(pairs, len(w.hashes))
            hashes = pair_hash(lang, w.hashes[first], w.hashes[second])
            asked = among(hashes, starts)[number[:len(at)]] | among(hashes, ends)[number[len(at):]]
            if not asked.any():
                continue
            keys, n = np.unique(number[:len(at)][asked] * len(w.hashes) + w.number[at[asked] + 2], return_counts=True)
            head, third = np.divmod(keys, len(w.hashes))
            out.append(_table({"lang": [lang] * len(keys), "w1": w.hashes[first[head]].view(np.int64), "w2": w.hashes[second[head]].view(np.int64),
                               "w3": w.hashes[third].view(np.int64), "n": n.astype(np.int64)}))
        return out

    rows = map_arrow(texts, kernel, "lang string, w1 long, w2 long, w3 long, n long", "text")
    return rows.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def score(a: str, left: str, right: str) -> Column:
    """floor(UNIT * a * a / (left * right)), in 38 digits."""
    return F.expr(f"cast((cast({UNIT} as decimal(38,0)) * {a} * {a}) div (cast({left} as decimal(38,0)) * {right}) as bigint)")


def _hashed(pairs: DataFrame) -> DataFrame:
    """Column `hash`: `pair_hash` of (lang, w1, w2)."""
    def kernel(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        langs = batch.column("lang").dictionary_encode()
        code, out = langs.indices.to_numpy(), np.zeros(batch.num_rows, dtype=U64)
        w1, w2 = (batch.column(c).to_numpy().view(U64) for c in ("w1", "w2"))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = code == i
            out[own] = pair_hash(lang, w1[own], w2[own])
        return [pa.RecordBatch.from_arrays([batch.column("bound_ok"), batch.column("score_ok"), pa.array(out.view(np.int64))],
                                           names=["bound_ok", "score_ok", "hash"])]
    return map_arrow(pairs.select("lang", "w1", "w2", "bound_ok", "score_ok"), kernel, "bound_ok boolean, score_ok boolean, hash long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best surviving phrases of each language."""
    prepare(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    small = staged(small_counts(texts, least), "grams")
    vocabulary = small.where("word is not null").select("lang", F.col("w1").alias("w"), "word", F.col("n").alias("f"))
    clash = vocabulary.groupBy("lang", "w").count().where("count > 1")
    if not clash.isEmpty():
        raise RuntimeError("two words of one 64-bit hash: name words by a longer hash")
    words = vocabulary.where(F.col("f") >= least)
    totals = small.where("w1 is null").select("lang", "n")
    pairs = (small.where("w2 is not null").select("lang", "w1", "w2", F.col("n").alias("a"))
             .join(words.select("lang", F.col("w").alias("w1"), F.col("word").alias("first"), F.col("f").alias("l")), ["lang", "w1"])
             .join(words.select("lang", F.col("w").alias("w2"), F.col("word").alias("second"), F.col("f").alias("r")), ["lang", "w2"])
             .withColumn("score", score("a", "l", "r"))
             .withColumn("bound", F.expr(f"cast((cast({UNIT} as decimal(38,0)) * a) div cast(l as decimal(38,0)) as bigint)")))
    pairs = staged(pairs, "pairs")

    triples = None
    known = totals.select("lang", F.lit(None).cast("long").alias("reached"))  # threshold that is settled so far
    reach, wanted = 2 * top, totals.select("lang")
    done = None
    while True:
        # the score of the `reach`-th pair; 0 if there are fewer
        best = pairs.join(wanted, "lang", "left_semi").withColumn(
            "place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
        edge = best.where(F.col("place") <= reach).groupBy("lang").agg(F.count("*").alias("k"), F.min("score").alias("s"))
        goal = staged(wanted.join(edge, "lang", "left").join(known, "lang").select(
            "lang", "reached", F.when(F.col("k") >= reach, F.col("s")).otherwise(0).alias("threshold")), "threshold")
        new = "({0} >= threshold and (reached is null or {0} < reached))"
        frontier = (pairs.join(goal, "lang").withColumn("bound_ok", F.expr(new.format("bound"))).withColumn("score_ok", F.expr(new.format("score")))
                    .where("bound_ok or score_ok"))
        frontier = staged(_hashed(frontier), "frontier")
        size = frontier.count()
        blocks = max(1, -(-2 * size // block)) if size > block else 1
        for i in range(blocks):
            part = frontier.where(F.expr(f"pmod(hash, {blocks}) = {i}")).toArrow()
            hashes = part.column("hash").to_numpy().view(U64)
            starts, ends = (np.unique(hashes[part.column(c).to_numpy(zero_copy_only=False).astype(bool)]) for c in ("bound_ok", "score_ok"))
            found = triple_counts(texts, starts, ends, least)
            triples = staged((found if triples is None else triples.unionByName(found)).distinct(), "triples")
        part_of = staged(_scored_triples(triples, pairs, words), "scored")
        # pairs that a longer phrase has half of
        hosts = part_of.select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), "a").union(
            part_of.select("lang", F.col("w2").alias("x"), F.col("w3").alias("y"), "a"))
        hosts = hosts.groupBy("lang", "x", "y").agg(F.max("a").alias("longest")).withColumnsRenamed({"x": "w1", "y": "w2"})
        above = goal.select("lang", "threshold")
        alive = (pairs.join(above, "lang").where("score >= threshold").join(hosts, ["lang", "w1", "w2"], "left")
                 .where(f"longest is null or 100 * longest < {INSIDE} * a")
                 .select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", "score"))
        alive = alive.unionByName(part_of.join(above, "lang").where("score >= threshold").select("lang", "phrase", "a", "l", "r", "score"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        ranked = staged(alive.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top), "ranked")
        full = ranked.where(F.col("rank") == top).select("lang")
        settled = goal.join(full.withColumn("full", F.lit(True)), "lang", "left").where("full or threshold = 0").select("lang")
        kept = ranked.join(settled, "lang", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        wanted = staged(goal.select("lang").join(settled, "lang", "left_anti"), "unsettled")
        if wanted.isEmpty():
            break
        known = goal.select("lang", F.col("threshold").alias("reached"))
        reach *= 4
    return done.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, phrase, a, l, r, score): the worst cut, the one after the first word if both are as bad."""
    head = pairs.select("lang", "w1", "w2", "first", "second", F.col("l").alias("one"), F.col("a").alias("head"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("second").alias("third"), F.col("r").alias("three"),
                        F.col("a").alias("tail"))
    both = (triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
            .withColumn("s1", score("a", "one", "tail")).withColumn("s2", score("a", "head", "three")))
    first = F.col("s1") <= F.col("s2")
    return both.select("lang", "w1", "w2", "w3", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a",
                       F.when(first, F.col("one")).otherwise(F.col("head")).alias("l"),
                       F.when(first, F.col("tail")).otherwise(F.col("three")).alias("r"),
                       F.least("s1", "s2").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 and 3 words of each language, over all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, row_number() OVER () AS row_no,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
    UNION ALL
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
          FROM w, (SELECT unnest([2, 3]) AS k) WHERE len(ws) >= k))
  GROUP BY ALL),
totals AS (SELECT lang, cast(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= {LEAST}),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, lg.f AS l, rg.f AS r,
         cast(({UNIT}::HUGEINT * a * a) // (lg.f::HUGEINT * rg.f) AS BIGINT) AS score
  FROM cuts JOIN g lg ON lg.lang = cuts.lang AND lg.phrase = lp AND lg.k = cut
            JOIN g rg ON rg.lang = cuts.lang AND rg.phrase = rp AND rg.k = cuts.k - cut),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' ') AS phrase, a FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT worst.lang, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.phrase) AS rank,
         worst.phrase, a, l, r, n, score
  FROM worst JOIN totals ON totals.lang = worst.lang
  LEFT JOIN inside ON inside.lang = worst.lang AND inside.phrase = worst.phrase
  WHERE longest IS NULL OR 100 * longest < {INSIDE} * a)
WHERE rank <= {TOP}
"""

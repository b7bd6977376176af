"""Operator 9: quality rules under weak supervision.

Each rule looks for one defect and votes to reject, votes to keep, or abstains.
How often each rule votes either way on good and on bad documents is estimated
by expectation-maximisation over the counts of vote patterns (at most
3 ** number of rules of them, whatever the corpus), and a document is kept if its
posterior probability of being good reaches THRESHOLD. The base rules (too few
words, too many repeated words) reject by themselves.

Defined cases: null or empty text has no words and fails the base rules; rows
that repeat an id are judged one by one; a null id is returned as it is; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import map_arrow, prepare, read_table, staged
from canvass.llm.words import BLANKS, code_points, text_bytes, windows, word_bounds, word_hashes

#: Base rules: fewest words, and percent of words in repeated windows of REPEAT words.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT = 10, 20, 5
#: Documents of at least this posterior quality are kept.
THRESHOLD = 0.5
#: What EM may find: a good document is seldom rejected by a rule, a bad one not too seldom.
GOOD_REJECT, BAD_REJECT = (1e-4, 0.02), (0.05, 0.95)
EM_STEPS = 200

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?"]] = True

#: name: (numerator over denominator is above) rejects, (is at most) keeps; None: the rule never votes so.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.10, None),
    "symbol_words": ("symbol_words", "n_words", 0.10, None),
    "capitals": ("n_upper", "n_letters", 0.40, None),
    "exclaims": ("n_exclaim", "n_words", 0.20, None),
    "repeated_windows": ("n_repeat_words", "n_words", 0.15, None),
    "echoes": ("n_echo", "n_words", 0.10, None),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.25, None),
    "few_word_forms": ("n_common", "n_words", 0.30, None),
    "no_sentences": ("n_unended", "n_words", 0.995, 0.97),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "symbol_words", "n_upper", "n_letters",
          "n_exclaim", "n_echo", "n_lines", "n_common", "n_unended"]


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the rules use, for each text."""
    data, bounds = text_bytes(column)
    begin, end, at = word_bounds(data, bounds, BLANKS)
    hashes = word_hashes(data, begin, end)
    points = code_points(data)

    def per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[cuts])

    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    upper = (data >= 65) & (data <= 90)
    out = {
        "n_words": np.diff(at), "word_chars": per_text(points[end] - points[begin], at), "n_symbols": per_text(SYMBOLS[data], bounds),
        "symbol_words": per_text(symbols[end] - symbols[begin] >= 2, at), "n_upper": per_text(upper, bounds),
        "n_letters": per_text(upper | ((data >= 97) & (data <= 122)), bounds), "n_exclaim": per_text(data == 33, bounds),
        "n_unended": per_text(~ENDS[data[end - 1]], at) if len(end) else np.diff(at),
    }
    more = {name: np.zeros(len(at) - 1, dtype=np.int64) for name in ("n_dup_lines", "n_repeat_words", "n_echo", "n_lines", "n_common")}
    for i, (a, b) in enumerate(itertools.pairwise(at)):
        own = hashes[a:b]
        if b - a >= REPEAT:
            _, inverse, count = np.unique(windows(own, REPEAT), return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[inverse] > 1)
            mark = np.zeros(b - a + 1, dtype=np.int64)
            np.add.at(mark, again, 1)
            np.add.at(mark, again + REPEAT, -1)
            more["n_repeat_words"][i] = int((np.cumsum(mark) > 0).sum())
        if b > a:
            more["n_echo"][i] = int((own[1:] == own[:-1]).sum())
            more["n_common"][i] = int(np.unique(own, return_counts=True)[1].max())
        text = data[bounds[i]:bounds[i + 1]].tobytes()
        lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
        more["n_lines"][i], more["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    return out | more


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts) of every row."""
    prepare(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_counts(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)],
                                          names=["doc_id", *COUNTS])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel,
                     "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS), "text")


def votes() -> Column:
    """Array of votes by rule: 1 keep, -1 reject, 0 abstain."""
    said = []
    for top, bottom, reject, keep in RULES.values():
        share = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        vote = F.when(share > reject, -1)
        said.append((vote.when(share <= keep, 1) if keep is not None else vote).otherwise(0))
    return F.array(*said)


def estimate(patterns: list[tuple[list[int], int]], steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """EM over vote patterns and their counts: (share of good documents, log-odds[rule, vote + 1] for good)."""
    n_rules = len(RULES)
    if not patterns:
        return 0.5, np.zeros((n_rules, 3))
    said = np.array([p for p, _ in patterns], dtype=int) + 1
    count = np.array([n for _, n in patterns], dtype=float)
    hot = np.eye(3)[said]  # pattern x rule x vote
    can_keep = np.array([r[3] is not None for r in RULES.values()])
    good = np.tile([0.005, 0.295, 0.70], (n_rules, 1))
    bad = np.tile([0.30, 0.50, 0.20], (n_rules, 1))
    good[~can_keep], bad[~can_keep] = [0.005, 0.995, 1e-9], [0.30, 0.70, 1e-9]
    prior = 0.9
    for _ in range(steps):
        odds = math.log(prior / (1 - prior)) + (hot * (np.log(good) - np.log(bad))).sum(axis=(1, 2))
        p = 1 / (1 + np.exp(-odds))
        prior = float(np.clip((count * p).sum() / count.sum(), 0.5, 0.99))
        for table, share, (low, high) in ((good, count * p, GOOD_REJECT), (bad, count * (1 - p), BAD_REJECT)):
            seen = (hot * share[:, None, None]).sum(axis=0) + [0.5, 0.5, 0.5]
            seen[~can_keep, 2] = 1e-9
            table[:] = seen / seen.sum(axis=1, keepdims=True)
            reject = np.clip(table[:, 0], low, high)
            table[:, 1:] *= ((1 - reject) / (1 - table[:, 0]))[:, None]
            table[:, 0] = reject
    return prior, np.log(good) - np.log(bad)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, votes, quality, base_failed, kept) of every row."""
    table = staged(counted(docs, id_col, text_col).withColumn("votes", votes()), "votes")
    patterns = [(list(r["votes"]), r["n"]) for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()]  # <= 3 ** rules
    prior, weight = estimate(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for i in range(len(RULES)):
        vote = F.element_at("votes", i + 1)
        odds = odds + F.when(vote == -1, float(weight[i, 0])).when(vote == 1, float(weight[i, 2])).otherwise(float(weight[i, 1]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (table.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by the base rules and by its posterior quality."""
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")

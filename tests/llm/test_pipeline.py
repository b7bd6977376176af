"""Stages of the corpus pipeline against brute force and planted cases; any id, any column name, repeated rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canvass.llm import common, quality_rules, tokens

STAGE = dict(corpus_pipeline.STAGES)
TOP = 2 ** 63 - 1
CLASHES = ["_n", "_copies", "_copy", "_taken", "_spans", "_span_doc", "_row", "_id", "_gone", "_bad", "rep", "size", "start", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)


def frame(spark, rows):
    """Rows (doc_id, text, source) with a column of every name that a stage might use inside."""
    common.prepare(spark)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(70, 70 + len(CLASHES))) for i, t, s in rows], SCHEMA).repartition(3)


def intact(rows):
    return all(tuple(r[c] for c in CLASHES) == tuple(range(70, 70 + len(CLASHES))) for r in rows)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(30)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    passage = prose(rng, 70)[:-1]
    out += [(100 + i, f"{prose(rng, 50)[:-1]} {passage} {prose(rng, 40)}", "s1") for i in range(4)]
    near = base[0].split(" ")
    near[20] = "changed"
    out += [(200, " ".join(near), "s0"), (201, base[1], "s2"), (201, base[1], "s2"), (201, prose(rng, 90), "s2"), (None, prose(rng, 80), None),
            (None, base[2], "s1"), (None, None, "s0"), (300, "", "s0"), (301, "too short", "s1"), (TOP, prose(rng, 100), "s0"), (-TOP - 1, prose(rng, 75), "s1")]
    return out


def test_quality_keeps_rows_by_themselves(spark, rows):
    """A rejected row takes no other row of its id along."""
    docs = frame(spark, rows)
    kept = STAGE["quality_rules"](spark, docs, "").collect()
    texts = {t for _, t, _ in rows}
    judged = quality_rules.judge(spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts, key=str))], "doc_id long, text string")).collect()
    good = {sorted(texts, key=str)[r.doc_id] for r in judged if r.kept}
    want = sorted(((i, t) for i, t, _ in rows if t in good), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == want and intact(kept)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_equals_brute_force(spark, rows):
    """One row of each group of linked texts stays, that of the smallest id; texts without words all stay."""
    kept = STAGE["near_dedup"](spark, frame(spark, rows), "").collect()
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i) if sets[i] else ("none", i)].append(i)
    assert len(kept) == len(groups) and intact(kept)
    left = collections.Counter((r.doc_id, r.text) for r in kept)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        best = min(ids) if ids else None
        assert any(left[(rows[i][0], rows[i][1])] for i in members if rows[i][0] == best)


def test_substring_dedup_removes_later_passages_only(spark, rows):
    only = [r for r in rows if r[0] is not None and 100 <= r[0] < 104]
    others = [r for r in rows if r[0] is not None and (r[0] < 30 or r[0] == TOP)]
    got = {r.doc_id: r for r in STAGE["substring_dedup"](spark, frame(spark, only + others), "").collect()}
    assert set(got) == {r[0] for r in only + others} and intact(got.values())
    for i, t, _ in others:
        assert got[i].text == t
    assert got[100].text == only[0][1]
    for i, t, _ in only[1:]:
        words = len(t.split()) - len(got[i].text.split())
        assert 65 <= words <= 80 and got[i].n_chars == len(got[i].text)


def test_mixing_repeats_whole_rows(spark, rows):
    good = [r for r in rows if r[1]]
    out = STAGE["mixing"](spark, frame(spark, good), "").collect()
    assert intact(out)
    times = collections.Counter((r.doc_id, r.text, r.source) for r in out)
    stored = collections.Counter((i, t, s) for i, t, s in good)
    assert set(times) <= set(stored) and all(n <= 3 * stored[k] for k, n in times.items())
    # sources weigh 1, 2, 3, ... of all words, and a target stops at three times its source
    size = collections.Counter()
    for _, t, s in good:
        size[s] += len(t.split())
    taken = collections.Counter()
    for (_, t, s), n in times.items():
        taken[s] += n * len(t.split())
    assert all(taken[s] <= 3 * size[s] + 200 for s in size) and abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())


def test_packing_covers_every_id_once(spark, rows):
    out = STAGE["packing"](spark, frame(spark, rows), "").collect()
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    want = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in out) == want
    ends = collections.Counter()
    for r in out:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    padded = sum(1 << (n - 1).bit_length() if n & (n - 1) else n for n in ends.values())
    assert padded >= want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = frame(spark, [(1, "a", "s")]).limit(0)
    out = STAGE[name](spark, docs, "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_all_stages_on_one_id(spark):
    """All rows share one id: they are told apart by their texts."""
    rng = random.Random(9)
    docs = frame(spark, [(TOP, prose(rng, 60), f"s{i % 2}") for i in range(30)] + [(None, prose(rng, 50), None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, ""), name)
        assert docs.columns == frame(spark, []).columns if name else True
    assert docs.select(F.count_distinct("text")).first()[0] >= 25


def test_ids_equal_the_library(spark):
    """Added tokens inside texts, odd blanks and bytes: as a fresh tokenizer gives them."""
    from tokenizers import Tokenizer
    rng = random.Random(3)
    plain, own = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    bits = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x7f", "\x00", "é", "中", "'s", "'re", "'", "12", "<|endoftext|>", "<|", "text|>", ".", "-", " ", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(5000)] + ["a <|endoftext|> b", None, ""]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert got.tolist() == plain.encode(text or "", add_special_tokens=False).ids

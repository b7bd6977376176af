"""Collocations, prefix trie and suffix-array dedup against brute force on small tables with hard rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from canvass.llm import collocations, common, prefix_trie, suffix_dedup
from canvass.llm.suffix_groups import Suffixes

DOCS = "doc_id long, text string, lang string, n long, gram long, spans string, shard string, w1 long, head long"
TURNS = "conv_id long, turn int, role string, text string, place int, head string, n long, leaf string, depth int"


def docs_frame(spark, rows):
    """Documents (doc_id, text, lang) with extra columns whose names the operators use inside."""
    common.prepare(spark)
    return spark.createDataFrame([(*r, 7, 7, "x", "x", 7, 7) for r in rows], DOCS).repartition(3)


def turns_frame(spark, rows):
    common.prepare(spark)
    return spark.createDataFrame([(*r, 1, "x", 7, "x", 1) for r in rows], TURNS).repartition(3)


# ---- collocations

def phrase_table(rows, least, top):
    f, n, seen = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(set)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        seen[lang].add(0)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        kept = []
        phrases = {p: a for p, a in f[lang].items() if " " in p and a >= least}
        for p, a in phrases.items():
            w = p.split(" ")
            if any(100 * b >= 50 * a for q, b in phrases.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = f[lang][" ".join(w[:k])], f[lang][" ".join(w[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), p, left, right))
        for i, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p, -a, left, right, n[lang], -s))
    return sorted(out)


def word_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É|", "A", "b", "%%"]
    fixed = ["alpha beta gamma", "beta gamma", "New York City", "a b"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(9001, None, "en"), (9002, "", None), (None, "alpha beta gamma", "en"), (9003, "x" * 50_000, "fr"), (9003, "x" * 50_000, "fr")]


@pytest.mark.parametrize("least,top,block", [(2, 5, 1 << 19), (2, 40, 1 << 19), (3, 2000, 16)])
def test_collocations_equal_brute_force(spark, least, top, block):
    """Few wanted phrases settle above zero, in one round or several; a small block takes several passes."""
    rows = word_rows(top, 150)
    got = sorted(tuple(r) for r in collocations.collocations(docs_frame(spark, rows), least=least, top=top, block=block).collect())
    assert got == phrase_table(rows, least, top)


def test_collocations_of_long_products(spark):
    """Scores whose products pass 64 bits are exact."""
    row = spark.createDataFrame([(3_999_999_999_999, 4_000_000_000_001, 3_999_999_999_999)], "a long, l long, r long")
    assert row.select(collocations.score("a", "l", "r")).first()[0] == 1000000 * 3_999_999_999_999 ** 2 // (4_000_000_000_001 * 3_999_999_999_999)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(docs_frame(spark, [(1, None, "en")]).limit(0)).collect() == []
    assert collocations.collocations(docs_frame(spark, [(1, None, "en"), (2, " .,", None)])).collect() == []


# ---- prefix trie

def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0, y[2]))] for c, x in turns.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + x[h:]
    members = collections.defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def conversation_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, 9)):
            # few texts, so that prefixes are shared deeply
            rows.append((c, None if rng.random() < 0.03 else turn, rng.choice(["user", "assistant", None]) if turn > 3 else "user",
                         rng.choice(["hi", "hé", "", None]) if rng.random() < 0.7 else "yes"))
    rows += [(5 * n, 0, "user", "hi")] * 2  # a repeated row is a turn of its own
    return rows + [(None, 0, "user", "no conversation"), (10 * n + 1, 0, "user", "z" * 40_000)]


@pytest.mark.parametrize("limit", [2, 7, 1000])
def test_trie_equals_brute_force(spark, limit):
    """Containers burst at any size give the nodes of the whole trie."""
    rows = conversation_rows(limit, 150)
    got = prefix_trie.trie(turns_frame(spark, rows), limit).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == brute_trie(rows)


def test_trie_of_many_equal_conversations(spark, monkeypatch):
    """Equal conversations are one entry, and the hash of their ids is streamed in chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(5 * c, t, "user", "same") for c in range(200) for t in range(3)]
    got = prefix_trie.trie(turns_frame(spark, rows), 1).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(turns_frame(spark, [(1, 0, "user", "x")]).limit(0)).collect() == []


# ---- suffix-array dedup

def test_suffix_arrays_equal_sorting():
    rng = random.Random(5)
    for turn in range(150):
        texts = [bytes(rng.choice(b"ab" if turn % 3 else b"abcd\x00\xff") for _ in range(rng.randrange(70))) for _ in range(rng.randrange(1, 7))]
        if turn % 5 == 0:  # runs of one word, where groups hold repeats of themselves
            texts = [t[:rng.randrange(1, 5)] * 15 for t in texts]
        found = Suffixes(texts)
        for t, text in enumerate(texts):
            assert found.array(t).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_removed(rows, length=suffix_dedup.LENGTH):
    bodies = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (doc, *_), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc if doc is not None else -1, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    return sorted(out)


def byte_rows(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage, line = prose(60), prose(30)
    texts = [prose(rng.randrange(1, 90)) for _ in range(40)]
    # one passage and one line under the limit in many documents, beside words of their own: a hot gram whose contexts differ
    texts += [prose(rng.randrange(5, 40)) + " " + passage + " " + prose(rng.randrange(5, 40)) for _ in range(60)]
    texts += [prose(8) + line[:150] + prose(30) for _ in range(60)]
    near = prose(120).split(" ")
    for _ in range(40):  # near copies
        own = list(near)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [prose(70)] * 5 + ["ab" * 400, "x" * 5000, "é" * 99 + "y", "é" * 100, passage[:220] + passage[:220]]
    return [(i, t, None) for i, t in enumerate(texts)] + [(9001, None, "en"), (9002, "", "en"), (None, texts[0] + passage, "en"),
                                                         (9003, texts[1] + "q" * 300, "en"), (9003, texts[1] + "q" * 300, "en")]


@pytest.mark.parametrize("shard", [2, 16])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rows = byte_rows(shard)
    got = suffix_dedup.deduplicated(docs_frame(spark, rows)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute_removed(rows)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.deduplicated(docs_frame(spark, [(1, None, "en")]).limit(0)).collect() == []

"""The training-data operators on small tables: brute force, round trips, hard rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from canvass.llm import (chat_format, common, components, license_scan, mixing, near_dup, quality_rules, simple8b, substring_dedup, token_binary,
                         tokens, url_filter, vector_packing, winnowing)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, rep long, key string, range int"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def frame(spark, texts):
    """Documents with clashing extra columns, a null id, a null and an empty text, and a repeated row."""
    common.prepare(spark)
    rows = [(i, t, f"s{i % 3}", len(t or ""), 1, "k", 2) for i, t in enumerate(texts)]
    rows += [(9001, None, None, 0, 1, None, 0), (9002, "", "s0", 0, 1, "k", 0), (None, "text without an id", "s1", 18, 1, "k", 0),
             (9003, "the same row twice", "s1", 18, 1, "k", 0), (9003, "the same row twice", "s1", 18, 1, "k", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    common.prepare(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, n) for n in (300, 120, 60, 5, 3, 900)]
    out = [" ".join(b) for b in base]
    for b in base[:2]:
        for edits in (1, 2, 3, 8):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = "changed"
            out.append(" ".join(c))
    out += [out[0], out[0], "x" * 30_000, " \n\t ", "Aa " * 40]
    return out


def test_winnowing_positions_and_hard_rows(spark, texts):
    rng = random.Random(1)
    for _ in range(200):
        text, k, w = "".join(rng.choice("ab") for _ in range(rng.randrange(60))), rng.randint(1, 6), rng.randint(1, 9)
        h = winnowing.gram_hashes(text, k)
        w_ = min(w, len(h))
        want = sorted({max(p for p in range(a, a + w_) if h[p] == min(h[a:a + w_])) for a in range(len(h) - w_ + 1)}) if len(h) else []
        assert want == winnowing.winnow(text, k, w)[0].tolist()
    # a shared run of k + w - 1 code points is found
    run = "".join(rng.choice("abcdefgh") for _ in range(winnowing.K + winnowing.W - 1))
    a, b = winnowing.winnow("1" * 200 + run + "2" * 200), winnowing.winnow("3" * 77 + run + "4" * 90)
    assert set(a[1].tolist()) & set(b[1].tolist())
    got = winnowing.fingerprints(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 5 and {r.doc_id: len(r.hashes) for r in got}[9001] == 0
    assert winnowing.fingerprints(empty(spark)).count() == 0


def test_successors(spark, texts):
    docs = frame(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    rows, _ = winnowing.with_successor(docs)
    follows, held = {}, None
    for r in rows.toPandas().sort_values(["range"], kind="stable").itertuples():
        if held is not None and held[0] == r.range:
            follows[held[1]] = r.doc_id
        held = None if r.tail else (r.range, r.doc_id)
    ids = sorted(r.doc_id for r in docs.collect())
    assert follows == {d: ids[i - 1] for i, d in enumerate(ids)}


def brute_components(rows):
    def shingles(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_duplicates_equal_brute_force(spark, texts, rounds, monkeypatch):
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    got = near_dup.near_duplicates(frame(spark, texts)).collect()
    want = brute_components([*enumerate(texts), (9001, None), (9002, ""), (9003, "the same row twice")])
    assert len(got) == len(texts) + 5
    for r in got:
        if r.doc_id is None:
            assert not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_duplicates_around_the_threshold(spark, rounds, monkeypatch):
    """Copies of one text that differ in 0-5 words and in length, most of them linked with few others."""
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    rng = random.Random(11)
    base, copies = words(rng, 150), []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
        copies.append(" ".join(copy[rng.randrange(8):len(copy) - rng.randrange(8)]))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, copies)).collect() if r["doc_id"] is not None}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (c.split() for c in copies)]
    want = list(range(len(copies)))
    for _ in copies:
        for i, j in itertools.combinations(range(len(copies)), 2):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    assert 1 < len(set(want)) < len(copies)
    assert [got[i] for i in range(len(copies))] == want


def test_near_duplicates_of_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_url_cascade_is_exact(spark):
    common.prepare(spark)
    keys = [f"host{i}.example" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = universe.where("pmod(xxhash64(key), 7) = 0")
    cascade = url_filter.build_cascade(universe, listed)
    got = {r.key for r in universe.where(cascade.lists(universe["key"])).collect()}
    assert got == {r.key for r in listed.collect()} and len(cascade.levels) >= 1


def test_url_rules_and_hard_rows(spark):
    common.prepare(spark)
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "http://example.org/en/12?x", "https://b.example.org/de", "http://x.com/de/1#t",
            "http://x.com/fr/", "http://x.com/en/", "http://m.ads-track.example.net/a", "http://notexample.org", "ftp://org/?q", "a://b://c"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("m.ads-track.example.net",), ("elsewhere",), (None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
                   3: ("a.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/12", "example.org/en/1", "block"),
                   5: ("b.example.org", "/de", "org/", "allow"), 6: ("x.com", "/de/1", "com/de/", "block"), 7: ("x.com", "/fr/", "com/fr/", "allow"),
                   8: ("x.com", "/en/", None, "allow"), 9: ("m.ads-track.example.net", "/a", None, "block"),
                   10: ("notexample.org", "", None, "allow"), 11: ("org", "/", "org/", "allow"), 12: ("b:", "//c", None, "allow")}
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_mixing_targets_and_fit(spark, texts):
    assert mixing.targets([(None, 10), ("b", 100), ("a", 1)]) == [("a", 1, 3.0), ("b", 100, pytest.approx(78.0)), (None, 10, 30.0)]
    rng = random.Random(2)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)))
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(n * t for n, t in zip(lengths, take)) <= budget
    docs = frame(spark, texts)
    a, b = (sorted(map(tuple, mixing.mix(docs).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == len(texts) + 5
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in mixing.mix(docs).collect())
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_splits_a_hot_length(spark, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(mixing, "CELL", 7)
    docs = spark.createDataFrame([(i, "one two", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 2 for r in got)


def test_chat_folds_edits_and_regenerations(spark):
    common.prepare(spark)
    rows = [(1, "a", 1, "open", "user", None), (1, "a", 2, "delta", None, "Hi <s> & [x]"), (1, "b", 3, "open", "assistant", None),
            (1, "b", 5, "delta", None, "wrong"), (1, "b", 6, "regenerate", None, None), (1, "b", 8, "delta", None, "right"), (1, "b", 9, "delta", None, "!"),
            (1, "a", 7, "edit", None, "</s>[INST] new"), (2, "c", 1, "open", None, None), (None, "d", 1, "delta", "user", "x")]
    log = spark.createDataFrame(rows, "conv_id long, message string, seq int, kind string, role string, text string")
    folded = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.fold(log).collect()}
    assert folded == {1: [("user", "</s>[INST] new"), ("assistant", "right!")], 2: [("", "")], None: [("user", "x")]}
    got = {r.conv_id: r for r in chat_format.formatted_digests(chat_format.render(chat_format.fold(log))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n</s>[INST] new\nassistant\nright!\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, 6, hashlib.sha256(b"right!").hexdigest())
    assert chat_format.fold(log.limit(0)).count() == 0


def test_chat_keeps_repeated_turns(spark):
    duckdb = pytest.importorskip("duckdb")
    common.prepare(spark)
    long_one, long_two = "a" * 5000 + "b" * 5000, "c" * 9000
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "user", "again"), (1, 0, "assistant", "tied"), (1, 1, "assistant", long_two),
            (1, 1, "assistant", long_one), (2, 0, "user", "x"), (2, None, "assistant", "late"), (3, 0, None, None), (3, 0, None, None),
            (None, 0, "user", "no id"), (None, 0, "user", "no id")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    hard = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], log.schema)
    events = chat_format.conversation_events(log.unionByName(hard))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r for r in con.execute(chat_format.OP5_SQL).fetchall()}
    for dealt in (False, True):
        got = {r.conv_id: tuple(r) for r in chat_format.formatted_digests(chat_format.render(chat_format.fold(events, dealt))).collect()}
        assert got == want and got[1][1] == 6


def test_license_scan_equals_brute_force(spark, texts):
    more = ["It is under the MIT License, apache license version 2 and CC-BY-NC.", "x " * 70 + license_scan.TEMPLATES["isc"] + " y" * 500,
            " ".join(license_scan.TEMPLATES["bsd"].split()[:-3])]
    docs = frame(spark, texts + more)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    sets = {label: set(t.split()) for label, t in license_scan.TEMPLATES.items()}
    for i, text in enumerate(texts + more):
        own = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        half, found = license_scan.BLOCK // 2, {}
        for s in range(0, max(1, len(own) - half), half):
            block = set(own[s:s + license_scan.BLOCK])
            for label, t in sets.items():
                if len(block & t) >= license_scan.needed(len(t)):
                    found[label] = max(found.get(label, 0), len(block & t) / len(t))
        assert got[i].n_words == len(own) and got[i].found == sorted(found) and got[i].score == max(found.values(), default=0.0)
    assert got[len(texts)].base == ["apache-2", "cc-by-nc", "mit"] and got[len(texts)].n_base == 3
    assert license_scan.scan(empty(spark)).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n, top in itertools.product([0, 1, 5, 1023, 1024, 1025, 5000], [1, 2, 50, 50257, 2**40, 2**63]):
        ids = rng.integers(0, top, n, dtype=np.uint64)
        assert (simple8b.decode(simple8b.encode(ids)) == ids).all()


def test_tasks_without_an_encoder_let_go_of_its_cache():
    path = tokens.tokenizer_path()
    assert tokens.encoder(path) is tokens.encoder(path)
    common.release()
    assert not tokens._ENCODERS


def test_places_of_seeds_in_rounds_are_those_of_one(spark):
    common.prepare(spark)
    rows = [(seed - 4, doc, 10 * doc + seed) for seed in range(9) for doc in range(-1, seed) for _ in range(1 + seed % 2)]
    seeds = spark.createDataFrame(rows, "seed long, doc_id long, pos int")
    one, four = substring_dedup.place_table(seeds), substring_dedup.place_table(seeds, 4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, four.collect())) and one.count() > 40
    assert len(four.staged_at) == 4
    common.discard(four)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in four.staged_at)


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    common.prepare(spark)
    parts, staged = [], components.staged

    def counted(df, label):
        parts.append((label, df.rdd.getNumPartitions()))
        return staged(df, label)

    monkeypatch.setattr(components, "staged", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.connected(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 30), (30, 20), (7, 7)], "a long, b long"))
        assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(10)} | {(20, 20), (30, 20)}
        assert all(n <= spark.sparkContext.defaultParallelism for label, n in parts if label == "stars")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_simple8b_packs_the_most_ids_a_word():
    """The selector of each position is the first, by a plain search, whose count of ids fits or ends with the block."""
    rng = np.random.default_rng(6)
    for top in (2, 40, 60_000, 2 ** 59):
        ids = rng.integers(0, top, (3, 300)).astype(np.uint64)
        ids[rng.random(ids.shape) < 0.7] = 0
        want = [[next(s for s in range(16) if all(int(x).bit_length() <= simple8b.WIDTHS[s] for x in row[at:at + simple8b.COUNTS[s]]))
                 for at in range(len(row))] for row in ids]
        assert simple8b._selectors(ids).tolist() == want


def test_texts_are_encoded_in_large_batches_in_their_order():
    rows = [(i, "x" * 900_000) for i in range(20)] + [(20, None), (21, "")]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[b:b + 4]]) for b in range(0, 20, 4)]
    batches.append(pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[20:]], schema=batches[0].schema))
    got = list(token_binary.together(iter(batches)))
    assert [r["doc_id"] for b in got for r in b.to_pylist()] == list(range(22)) and len(got) == 3


def test_pieces_encode_like_the_whole_text():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", ".", "'s", "!", "\u00a0", "\u3000", "\x1c", "\x85", "中", "😀", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["", None]
    enc = tokens.Encoder(tokens.tokenizer_path())
    want = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in enc.encode(texts)] == want


def test_token_pages_and_packing(spark, texts, monkeypatch):
    monkeypatch.setattr(token_binary, "PAGE_IDS", 500)
    docs = frame(spark, texts)
    enc = tokens.Encoder(tokens.tokenizer_path())
    rows = sorted([*((i, t) for i, t in enumerate(texts)), (9001, None), (9002, ""), (9003, "the same row twice"), (9003, "the same row twice")],
                  key=lambda r: r[0]) + [(None, "text without an id")]
    want, start, ids_of = [], 0, {}
    for i, t in rows:
        ids = np.append(enc.encode([t])[0], 0).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start, ids_of[i] = start + len(ids), ids
    got = sorted(map(tuple, token_binary.read_documents(token_binary.write_pages(docs)).collect()), key=lambda r: r[1])
    assert got == want
    assert token_binary.read_documents(token_binary.write_pages(empty(spark))).count() == 0
    pieces = vector_packing.pack(docs).collect()
    covered, used = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        own = ids_of[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
        covered[p.doc_id] += p.length
        used[p.sequence_id].append((p.offset, p.length))
    assert covered == {i: len(x) * (2 if i == 9003 else 1) for i, x in ids_of.items()}
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert vector_packing.pack(empty(spark)).count() == 0


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(5)
    tokens_, limits = rng.integers(1, 100, 300), (100, 5, 60)
    loss = np.minimum(rng.integers(0, 61, 300), tokens_)
    seen = collections.Counter()
    for placed in vector_packing.pack_items(tokens_, loss, limits):
        assert 0 < len(placed) <= 5 and sum(b - a for _, a, b in placed) <= 100
        assert sum(max(0, min(b - a, b - (tokens_[i] - loss[i]))) for i, a, b in placed) <= 60
        seen.update({int(i): int(sum(b - a for j, a, b in placed if j == i)) for i, _, _ in placed})
    assert seen == {i: int(n) for i, n in enumerate(tokens_)}


def test_passages_cover_every_shared_run(spark):
    rng = random.Random(7)
    shared = words(rng, 80)
    fuzzy = list(shared)
    fuzzy[30], fuzzy[55] = "other", "words"
    texts = [" ".join(words(rng, 50) + p + words(rng, 40)) for p in (shared, shared, fuzzy, [])]
    docs = frame(spark, texts)
    got = substring_dedup.passages(docs).collect()
    covered = collections.defaultdict(set)
    for r in got:
        assert r.source < r.doc_id
        covered[r.doc_id].update(range(r.start, r.end))
    assert set(covered) == {1, 2} and all(set(range(50, 130)) <= c and len(c) < 90 for c in covered.values())
    left = {r.doc_id: r for r in substring_dedup.removed(docs, substring_dedup.passages(docs)).collect()}
    assert len(left[1].text.split()) <= 90 and left[0].text == texts[0] and left[1].n_chars == len(left[1].text) and left[9003].rep == 1
    assert substring_dedup.passages(empty(spark)).count() == 0


def covered_words(spark, texts):
    """Words of each document that a passage covers."""
    common.prepare(spark)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = collections.defaultdict(set)
    for r in substring_dedup.passages(docs).collect():
        assert r.source < r.doc_id and r.identity >= substring_dedup.IDENTITY and r.end - r.start >= substring_dedup.MIN_WORDS
        out[r.doc_id].update(range(r.start, r.end))
    return out


def test_passages_with_gaps_and_insertions(spark):
    rng = random.Random(11)
    texts, want = [], {}
    for length, gap in ((60, 40), (60, 90), (100, 70), (100, 150), (50, 100)):
        one, two = words(rng, length), words(rng, length)
        texts.append(words(rng, 20) + one + words(rng, gap) + two + words(rng, 20))
        texts.append(words(rng, 30) + one + words(rng, gap) + two + words(rng, 10))
        want[len(texts) - 1] = set(range(30, 30 + length)) | set(range(30 + length + gap, 30 + 2 * length + gap))
        whole = one + two
        texts.append(whole)
        texts.append(one + words(rng, gap) + two)
    got = covered_words(spark, texts)
    for i, places in want.items():
        assert places <= got[i] and len(got[i] - places) < 10, i
        # an insertion between both halves of a passage leaves each half a passage
        n = len(texts[i + 1]) // 2
        assert set(range(n)) <= got[i + 2] and set(range(len(texts[i + 2]) - n, len(texts[i + 2]))) <= got[i + 2]


def test_passages_whose_pieces_were_seen_before(spark):
    rng = random.Random(12)
    texts, want = [], []
    for length, pieces, times in [(60, 2, 1)] * 8 + [(75, 3, 1)] * 8 + [(60, 2, substring_dedup.PLACES + 4), (40, 2, substring_dedup.PLACES + 4)]:
        passage, size = words(rng, length), length // pieces
        for c in range(pieces):
            texts += [words(rng, 20) + passage[c * size:(c + 1) * size] + words(rng, 20) for _ in range(times)]
        texts += [words(rng, 20) + passage + words(rng, 20), words(rng, 20) + passage + words(rng, 20)]
        want.append((len(texts) - 1, set(range(20, 20 + length))))
    got = covered_words(spark, texts)
    assert all(places <= got[i] for i, places in want)
    assert sum(map(len, got.values())) < sum(len(p) for _, p in want) * 1.05 and set(got) == {i for i, _ in want}


def test_changed_passages_of_frequent_seeds(spark):
    """All seeds of the passage have more than PLACES places and begin in documents that hold pieces only; the copies have changed
    words, so that no run of MIN_WORDS words is equal."""
    rng = np.random.default_rng(3)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]

    shared = words(60)
    docs = []
    for i in range(substring_dedup.PLACES + 4):
        pieces = [words(80) + shared[b:b + 12] for b in range(0, 54, 6)]
        docs.append((i, " ".join(w for k in rng.permutation(len(pieces)) for w in pieces[k])))
    docs.append((100, " ".join(words(50) + shared + words(50))))
    docs.append((101, " ".join(words(30) + shared[:30] + ["changed"] + shared[31:] + words(70))))
    docs.append((102, " ".join(words(20) + shared[:20] + ["changed"] + shared[21:40] + ["too"] + shared[41:] + words(20))))
    found = substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source) for r in found} >= {(101, 100), (102, 100)}
    assert min(r.doc_id for r in found) > 100
    for doc in (101, 102):
        covered = {w for r in found if r.doc_id == doc for w in range(r.start, r.end)}
        assert len(covered) >= 58


def test_passages_in_rounds_are_those_of_one(spark, monkeypatch):
    """Two rounds of each step give the rows of one, and leave no staged table but the results."""
    rng = random.Random(21)
    common.prepare(spark)
    shared, docs = words(rng, 60), []
    for i in range(substring_dedup.PLACES + 14):
        pieces = [words(rng, 40) + shared[b:b + 12] for b in range(0, 54, 6)]
        docs.append((i, " ".join(w for p in rng.sample(pieces, len(pieces)) for w in p)))
    for i in range(100, 106):
        docs.append((i, " ".join(words(rng, 40) + shared[:i - 80] + words(rng, 1) + shared[i - 79:] + words(rng, 40))))
    docs += [(110, docs[-1][1]), (110, docs[-1][1]), (111, docs[0][1])]
    table = common.staged(substring_dedup.word_table(spark.createDataFrame(docs, "doc_id long, text string")), "words")
    places = substring_dedup.place_table(substring_dedup.seed_table(table))
    none = spark.createDataFrame([], "doc_id long, start long, end long")
    here = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    results, labels, staged = [], [], substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "staged", lambda df, label, *onto: labels.append(label) or staged(df, label, *onto))
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    monkeypatch.setattr(substring_dedup, "BLOCKS", 1)
    for n in (1, 2):
        labels.clear()
        monkeypatch.setattr(substring_dedup, "rounds_of", lambda size, words, n=n: n)
        before = set(os.listdir(here))
        rest = substring_dedup.with_rest(table, places, none)
        found = substring_dedup.compared(table, rest, near=True)
        found = substring_dedup.compared(table, substring_dedup.with_first(places), found)
        assert set(os.listdir(here)) - before == {os.path.basename(x.staged_at) for x in (rest, found)}
        assert [labels.count(x) for x in ("around", "rest", "tested", "found")] == [n, n * n, n, 2 * n]
        results.append((sorted(map(tuple, rest.collect())), sorted(map(tuple, found.distinct().collect()))))
    assert results[0] == results[1]
    assert {r[0] for r in results[0][1]} >= {*range(101, 106), 111} and len(results[0][0]) > 100


def test_rounds_follow_the_words(spark):
    common.prepare(spark)
    words, least = common.staged(spark.range(10), "words"), substring_dedup.ROUND_BYTES
    assert [substring_dedup.rounds_of(n, words) for n in (0, least, least + 1, 10 * least)] == [1, 1, 2, 10]
    assert 0 < common.staged_bytes(words) < 100_000
    rows = spark.range(200)
    for made, rounds in ((None, 10), (least, 10), (least // 8, 3)):
        seen = []
        substring_dedup.in_rounds(10 * least, words, lambda mine, seen=seen, made=made: seen.append({r.id for r in rows.where(mine("id")).collect()}) or made)
        assert len(seen) == rounds and sum(map(len, seen)) == 200 and len(set.union(*seen)) == 200, (made, len(seen))


def test_passages_of_frequent_seeds_with_added_and_dropped_words(spark):
    """Neither side of the words added or dropped reaches MIN_WORDS; of the last passage the first half has rare seeds and only the
    second half frequent ones."""
    rng = random.Random(14)
    common.prepare(spark)
    docs, want = [], {}
    for c, (left, right) in enumerate(((30, 30), (35, 25), (28, 30), (30, 30))):
        shared, new = words(rng, left + right), words(rng, 5)
        seen = shared if c < 3 else shared[left:]
        for i in range(substring_dedup.PLACES + 4):
            pieces = [words(rng, 80) + seen[b:b + 12] for b in range(0, len(seen) - 6, 6)]
            docs.append((1000 * c + i, " ".join(w for p in rng.sample(pieces, len(pieces)) for w in p)))
        docs.append((1000 * c + 100, " ".join(words(rng, 40) + shared + words(rng, 40))))
        changed = shared[:left - 4] + shared[left:] if c == 2 else shared[:left] + new + shared[left:]
        docs.append((1000 * c + 101, " ".join(words(rng, 25) + changed + words(rng, 25))))
        want[1000 * c + 101] = (1000 * c + 100, set(range(25, 25 + len(changed))))
    found = substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    for doc, (source, places) in want.items():
        mine = [r for r in found if (r.doc_id, r.source) == (doc, source)]
        covered = {w for r in mine for w in range(r.start, r.end)}
        assert len(covered & places) >= len(places) - 3 and len(covered - places) < 8, (doc, covered)
        assert all(r.identity >= substring_dedup.IDENTITY for r in mine)
    assert {r.doc_id for r in found} == set(want)


def places_around(rows):
    """Places (doc_id, pos, sides) of a seed, of (document, words before the seed, words behind it) as marks."""
    n = substring_dedup.AROUND
    sides = [bytes([0] * (n - len(left))) + bytes(left) + bytes(right) + bytes([0] * (n - len(right))) for _, left, right in rows]
    return pa.StructArray.from_arrays([pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(left) for _, left, _ in rows], pa.int32()),
                                       pa.array(sides, pa.binary())], names=["doc_id", "pos", "sides"])


def test_places_with_nearly_all_words_around_them_equal_may_extend():
    rng = np.random.default_rng(5)
    left, right = (rng.integers(1, 255, substring_dedup.AROUND).tolist() for _ in range(2))
    changed = [1 + right[0] % 254, *right[1:]]
    found = substring_dedup.extendable(places_around([(7, left, changed)]), places_around([(3, left, right), (9, left, right)]))
    assert (found[0].tolist(), found[1].tolist()) == ([0], [0])
    assert substring_dedup.both_reach(*found[2:]).tolist() == [True]


def test_places_whose_equal_words_end_before_a_passage_are_not_aligned():
    """One word 33 times, then others: 33 equal words of 40 are a share of 0.8, but the texts agree in less than 40 words."""
    rng = np.random.default_rng(6)

    def place(doc, word, n, others):
        return doc, [word] * n, [word] * (27 - n) + rng.choice(others, substring_dedup.AROUND - 27 + n).tolist()

    asked = [place(100 + n, 1, n, range(2, 100)) for n in range(20)]
    sources = [place(n, 1, n, range(100, 254)) for n in range(20)]
    # the same word goes on in the source alone, or in both
    longer = [(50, [1] * 20, [1] * 40), (51, [1] * 20, [1] * 11 + [2] * 20)]
    _, j, x, y = substring_dedup.extendable(places_around([*asked, (200, [1] * 20, [1] * 30)]), places_around([*sources, *longer]))
    kept = substring_dedup.both_reach(x, y)
    assert {20} == set(j[kept].tolist()) and kept.sum() == 1


def test_places_in_runs_of_one_word_are_counted_before_they_are_put_in_order(monkeypatch):
    rng = np.random.default_rng(7)
    n = substring_dedup.AROUND

    def place(doc, others):
        """A place in a run of the word 1, other words beside it."""
        left, right = rng.integers(4, 24, 2).tolist()
        return doc, [*rng.choice(others, n - left).tolist(), *[1] * left], [*[1] * right, *rng.choice(others, n - right).tolist()]

    asked, sources = places_around([place(1000 + k, range(2, 125)) for k in range(250)]), places_around([place(k, range(125, 250)) for k in range(250)])
    seen, in_order = [], substring_dedup.in_order
    monkeypatch.setattr(substring_dedup, "in_order", lambda x, bits, i, j: seen.append(len(i)) or in_order(x, bits, i, j))
    got = substring_dedup.extendable(asked, sources)
    few = sum(seen)
    monkeypatch.setattr(substring_dedup, "enough_words", lambda x, y: True)
    want = substring_dedup.extendable(asked, sources)
    assert len(want[0]) and all((a == b).all() for a, b in zip(got, want, strict=True))
    assert few < (sum(seen) - few) / 2


def chain_rows(rng, own, source, n):
    """Chains of one document and one source with the source's words around them; the first stand at planted passages."""
    m, k = substring_dedup.MARGIN, substring_dedup.K
    rows = []
    for t in range(n):
        at, to, size = (int(x) for x in rng.integers(0, len(own) - 90, 3))
        size = size % 80
        more = int(rng.integers(0, 4)) if t % 5 == 0 else 0
        if t % 3:
            source[to:to + size + k] = own[at:at + size + k]
        rows.append((7, 3, at, at + size, to, to + size + more))
    words = [source[max(0, r[4] - m):r[5] + k + m] for r in rows]
    cols = [*zip(*rows, strict=True), [w.tobytes() for w in words], [max(0, r[4] - m) for r in rows]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary()), pa.array(cols[7], pa.int64())],
                                      names=[*substring_dedup.CHAIN, "source_words", "source_words_at"])


def test_chains_of_equal_length_are_aligned_together_as_one_by_one():
    k, fast = substring_dedup.K, 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        own, source = (rng.integers(0, 3000 if seed % 2 else 4, 900).astype("<u4") for _ in range(2))
        rows = chain_rows(rng, own, source, 60)
        # the last words are missing: the text of another row of the same id
        for mine in (own, own[:500]):
            def alone(r):
                start = max(0, r["first"] - substring_dedup.MARGIN)
                a, b = mine[start:r["last"] + k + substring_dedup.MARGIN].astype(np.uint64), np.frombuffer(r["source_words"], "<u4").astype(np.uint64)
                base = r["source_words_at"]
                found = substring_dedup.parts(a, b, r["first"] - start, r["last"] - start + k, r["source_first"] - base, r["source_last"] - base + k)
                return [(i + start, j + start, s + base, t + base, share) for i, j, s, t, share in found]

            for some in (rows, rows.slice(7, 20)):
                slow, found, shares = substring_dedup.equal_chains(mine, some)
                _, i, j, _, s, t = (x.tolist() for x in found)
                each = [r for r in some.to_pylist()]
                got = [*zip(i, j, s, t, shares.tolist(), strict=True), *(p for at in slow.tolist() for p in alone(each[at]))]
                assert sorted(got) == sorted(p for r in each for p in alone(r))
                fast += len(shares)
    assert fast > 30


def test_equal_words_are_those_of_the_banded_table():
    def table(a, b):
        if len(a) > len(b):
            a, b = b, a
        half, best = substring_dedup.BAND + len(b) - len(a), np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                near = abs(i - j) <= half and a[i - 1] == b[j - 1]
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + near)
        return best[-1, -1]

    rng = np.random.default_rng(8)
    for _ in range(80):
        n, m = rng.integers(1, 70, 2)
        a, b = (rng.integers(0, 6, x).astype(np.uint64) for x in (n, m))
        if n != m:
            assert substring_dedup.aligned(a, b) == substring_dedup.aligned(b, a) == table(a, b)
    a, b = np.roll(np.arange(60), 30).astype(np.uint64), np.arange(60).astype(np.uint64)
    assert substring_dedup.aligned(a, b) == table(a, b) == 0


def test_matches_that_reach_no_passage_are_left_out_together(monkeypatch):
    rng = np.random.default_rng(9)
    seen, passage = [], substring_dedup.passage
    monkeypatch.setattr(substring_dedup, "passage", lambda *args: seen.append(args) or passage(*args))
    plain, results, calls = substring_dedup.without_short, [], []
    texts = []
    for run, tail in ((20, 200), (60, 90), (9, 30)):
        a, b = (np.concatenate(([1] * run, rng.integers(2, 10**6, tail), [5] * 30, rng.integers(2, 10**6, 40))).astype(np.uint64) for _ in range(2))
        texts.append((a, b))
    for test in (plain, lambda a, b, pos, src, found: found):
        monkeypatch.setattr(substring_dedup, "without_short", test)
        seen.clear()
        results.append([substring_dedup.parts(a, b, 0, substring_dedup.K, 0, substring_dedup.K, True) for a, b in texts])
        calls.append(len(seen))
    assert results[0] == results[1] and any(results[0]) and calls[0] < calls[1] / 2


def test_parts_are_encoded_by_one_fast_call_a_batch(monkeypatch):
    """Newlines, accents, control bytes and added tokens: the ids of whole texts, without the call that tracks offsets."""
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = ["a\nb  c", None, "", "  x ", "it's\t\nok  \n", "\u0100 x\u0100y", "\u00e9t\u00e9 na\u00efve \ue000 x", "a\x00b \x00", "a <|endoftext|> b", "word " * 40_000 + "end"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    slow = []

    class Fast:
        def __init__(self, tokenizer):
            self.encode_batch_fast = tokenizer.encode_batch_fast

        def encode(self, *args, **more):
            slow.append(args)

    encoder.tokenizer, encoder.model = Fast(encoder.tokenizer), Fast(encoder.model)
    assert [x.tolist() for x in encoder.encode(texts)] == want and not slow


def test_seeds_are_close_and_chosen_by_their_own_words():
    rng = np.random.default_rng(3)
    k, spacing = substring_dedup.K, substring_dedup.SPACING
    for spread in (3, 50, 10**9):
        hashes = rng.integers(0, spread, 400).astype(np.uint64)
        at, grams = substring_dedup.seeds_of(hashes)
        assert at[0] < spacing and len(hashes) - k - at[-1] < spacing and np.diff(at).max() <= spacing
        again, same = substring_dedup.seeds_of(hashes[100:300])
        inside = (at >= 100) & (at + k <= 300)
        assert (again + 100 == at[inside]).all() and (same == grams[inside]).all()
    assert len(substring_dedup.seeds_of(hashes[:k - 1])[0]) == 0


@pytest.mark.parametrize(("length", "rate", "least"), [(60, 0.10, 29), (60, 0.15, 26), (100, 0.10, 29), (100, 0.15, 28)])
def test_passages_with_changed_words(spark, length, rate, least):
    rng = random.Random(13)
    texts, want = [], []
    for _ in range(30):
        passage = words(rng, length)
        changed = list(passage)
        for i in rng.sample(range(length), round(rate * length)):
            changed[i] = f"x{i}"
        texts += [words(rng, 20) + passage + words(rng, 20), words(rng, 20) + changed + words(rng, 20)]
        want.append((len(texts) - 1, set(range(20, 20 + length))))
    got = covered_words(spark, texts)
    assert sum(len(got[i] & places) >= 0.8 * length for i, places in want) >= least
    assert all(len(got[i] - places) <= 8 for i, places in want) and set(got) <= {i for i, _ in want}


def test_chains_equal_quadratic_search():
    rng = random.Random(9)
    for _ in range(100):
        n = rng.randint(1, 14)
        pos, src = np.array([rng.randrange(60) for _ in range(n)]), np.array([rng.randrange(60) for _ in range(n)])
        for chain in substring_dedup.chains(pos, src):
            assert all(pos[a] <= pos[b] and src[a] < src[b] for a, b in itertools.pairwise(chain))
    assert substring_dedup.chains(np.arange(0, 80, 8), np.arange(5, 85, 8)) == [list(range(10))]


def test_quality_counts_and_votes(spark, texts):
    junk = ["WIN!! NOW!! " * 1 + " ".join(f"A{chr(65 + i % 26)}{i}!!" for i in range(60)), " ".join(f"w{i}###" for i in range(60))]
    good = [". ".join(" ".join(w for w in words(random.Random(s), 9)) for _ in range(12)) + "." for s in range(120)]
    good = [re.sub(r"w(\d+)", lambda m: "word" + "".join(chr(97 + int(c)) for c in m[1]), g) for g in good]
    good = [" ".join(f"{w}{i % 17}" if not w.endswith(".") else w for i, w in enumerate(g.split())) for g in good]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, good + junk * 8)).collect()}
    for i, t in enumerate(good + junk * 8):
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        marked = {j + d for j in range(len(w) - 4) if seen[tuple(w[j:j + 5])] > 1 for d in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(marked))
    assert got[9001].base_failed and got[9002].n_words == 0 and not got[9001].kept
    assert not any(got[len(good) + i].kept for i in range(len(junk) * 8))
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.read_table(spark, sf, "documents"), common.read_table(spark, sf, "labels")
    rows = quality_rules.judge(docs).select("doc_id", "kept").join(labels.withColumnRenamed("quality", "good"), "doc_id").collect()
    assert sum(r.kept for r in rows if r.good) >= 0.95 * sum(1 for r in rows if r.good)
    assert sum(r.kept for r in rows if not r.good) <= 0.05 * sum(1 for r in rows if not r.good)


def test_lines_and_repeats_of_one_text():
    got = quality_rules.text_counts(pa.array(["a\na\n \n b\n\nb\n b", None]))
    assert got["n_dup_lines"].tolist() == [2, 0] and got["n_words"].tolist() == [5, 0]


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = common.read_table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() > 0
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_pipeline_judges_rows_and_not_ids(spark):
    import corpus_pipeline
    rng = random.Random(21)
    one, two, three, four = ([" ".join(words(rng, 12)).capitalize() + "." for _ in range(12)] for _ in range(4))
    one, two, three, four = (" ".join(x) for x in (one, two, three, four))
    rows = [(None, None), (None, one), (None, two), (7, "bad"), (7, three), (7, four), (8, three), (9, one)]
    common.prepare(spark)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = common.staged(docs.repartition(3), "rows")

    def run(stage, table):
        return sorted(((r.doc_id, r.text) for r in stage(spark, table, "").collect()), key=str)

    kept = corpus_pipeline.quality(spark, docs, "")
    assert run(corpus_pipeline.quality, docs) == sorted([r for r in rows if r[1] and r[1] != "bad"], key=str)
    # of each text the row with an id of its own stays, and texts that only others have stay
    assert run(corpus_pipeline.near_dedup, kept) == sorted([(8, three), (9, one), (None, two), (7, four)], key=str)
    assert run(corpus_pipeline.passage_dedup, kept) == sorted([(8, three), (9, one), (None, two), (7, four)], key=str)
    mixed = collections.Counter(run(corpus_pipeline.mix_sources, kept))
    # one source: each row is taken once, whatever others of its id there are
    assert mixed == collections.Counter([r for r in rows if r[1] and r[1] != "bad"])

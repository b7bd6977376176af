"""Property tests: column expressions against plain-Python statements of the
same rules, over generated inputs (one Spark job per example batch)."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions import domains, formatting, jsoncols

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.floats(min_value=-1e7, max_value=1e7, allow_nan=False, allow_infinity=False)
                | st.integers(-10 ** 6, 10 ** 6).map(lambda n: n / 8), min_size=1, max_size=300),
       st.integers(0, 4))
def test_fixed_equals_python_format(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(formatting.fixed(F.col("x"), digits)).collect()]
    assert got == [format(v, f".{digits}f") for v in values]


def _py_clean(url, cut_path):
    if url is None:
        return None
    s = url.lower().strip().replace("http://", "").replace("https://", "").replace("www.", "").rstrip("/")
    if cut_path and "/" in s:
        s = s.split("/")[0]
    return s or None


_part = st.text(alphabet="abcXYZ-._/ w", min_size=0, max_size=8)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["", "http://", "https://", "HTTPS://", " "]),
                          st.sampled_from(["", "www.", "WWW."]), _part, st.sampled_from(["", "/", "//", "/a/b", " "])),
                min_size=1, max_size=200))
def test_domain_cleaning_equals_python(spark, parts):
    urls = ["".join(p) for p in parts]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(domains.clean_domain(F.col("u")), domains.clean_crm_domain(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(_py_clean(u, True), _py_clean(u, False)) for u in urls]


def _py_expand(s):
    if s is None or s == "":
        return 0, ""
    try:
        items = json.loads(s)
    except ValueError:
        return 0, s
    if isinstance(items, list):
        if all(isinstance(i, str) for i in items):
            return len(items), "\n".join(items)
        return 0, s
    if isinstance(items, str):
        return 0, items
    if isinstance(items, bool):
        return 0, str(items)
    if items is None:
        return 0, "None"
    return None          # numbers / objects: text form differs by design (JSON text), not compared


_json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=5),
                            lambda kids: st.lists(kids, max_size=4), max_leaves=6)


@SETTINGS
@given(st.lists(_json_values.map(json.dumps) | st.text(max_size=6), min_size=1, max_size=100))
def test_expand_json_array_equals_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    n, t = jsoncols.expand_json_array(F.col("s"))
    got = [tuple(r) for r in df.select(n, t).collect()]
    for text, g in zip(texts, got):
        want = _py_expand(text)
        if want is not None:
            assert g == want, text


_WS_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"


@SETTINGS
@given(st.lists(st.text(alphabet=_WS_CHARS + "abé.", max_size=30), min_size=1, max_size=100))
def test_words_equal_python_split(spark, texts):
    from canvass.functions import text
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cut_text, cut = text.truncate_document(F.col("t"), max_words=3)
    summary = text.document_summary(F.col("t"))
    got = [tuple(r) for r in df.select(text.word_count(F.col("t")), cut_text, cut, summary[3]).collect()]
    for t, (n, ct, c, has) in zip(texts, got):
        w = t.split()
        assert n == len(w), repr(t)
        assert has == (len(w) > 0), repr(t)
        assert c == (len(w) > 3)
        assert ct == (" ".join(w[:3]) + text.config.TRUNCATION_NOTICE if len(w) > 3 else t), repr(t)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["k", "k", "k", "a", "b"]), st.one_of(st.none(), st.integers(0, 9)),
                          st.text(alphabet="xyz", max_size=3)), min_size=1, max_size=80))
def test_first_last_per_key_equal_python(spark, data):
    from canvass.operators import ranking
    df = spark.createDataFrame(data, "k string, pos int, v string")
    first = dict((r.k, r.v) for r in ranking.first_per_key(df, ["k"], ["pos", "v"], ["v"]).collect())
    last = dict((r.k, r.v) for r in ranking.last_per_key(df, ["k"], ["pos", "v"], ["v"]).collect())

    def key(t):   # struct order: nulls first, then value
        return (t[1] is not None, t[1] if t[1] is not None else 0, t[2])

    for k in {t[0] for t in data}:
        grp = sorted((t for t in data if t[0] == k), key=key)
        assert first[k] == grp[0][2] and last[k] == grp[-1][2], k


@SETTINGS
@given(st.lists(st.tuples(st.text(alphabet="0123456", min_size=1, max_size=4),
                          st.one_of(st.none(), st.text(alphabet="Real EstateBuildng.+()", max_size=12)),
                          st.one_of(st.none(), st.text(alphabet="property (a+b)", max_size=10))),
                min_size=1, max_size=60),
       st.sampled_from([" 12", "3", "estate", "Building", "(a+b)", "prop", "zzz"]))
def test_search_equals_python(spark, data, q):
    from canvass import config
    from canvass.operators import filters
    df = spark.createDataFrame([(f"{i}", c, d, r) for i, (c, d, r) in enumerate(data)],
                               "id string, naics_code string, naics_description string, reasoning string")
    got = sorted(r.id for r in filters.search_industries(df, q).collect())
    s = q.strip()
    if s.isdigit():
        want = [f"{i}" for i, (c, _, _) in enumerate(data) if c.startswith(s)]
    else:
        terms = config.expand_search_query(s)
        want = [f"{i}" for i, (_, d, r) in enumerate(data)
                if any(t in x.lower() for x in (d, r) if x is not None for t in terms)]
    assert got == sorted(want)

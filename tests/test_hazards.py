"""Cases that the stand-in tables reach rarely: blanks, huge numbers, ties, typed JSON, hot addresses."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from canvass.functions import formatting as fmt
from canvass.functions import text as tx
from canvass.functions.domains import clean_domain
from canvass.operators import joins, ranking, resolution
from canvass.sources import readers

ADDRESS = "string, street_number string, street string, city string, state string, zip string"


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def addresses(spark, rows, id_col):
    return spark.createDataFrame(rows, f"{id_col} {ADDRESS}")


def resolved(spark, crm, registry, **kw):
    crm = addresses(spark, crm, "hubspot_id").withColumn("hubspot_type", F.lit("building"))
    out = resolution.resolve(crm, addresses(spark, registry, "dataaxle_id"), **kw)
    return {r["hubspot_id"]: (r["dataaxle_id"], r["match_type"], r["confidence_score"]) for r in out.collect()}


def test_blank_addresses_match_nothing(spark):
    blank = ("-", "", "  ", None, "--")
    full = ("12", "Main St", "Rome", "NY", "1")
    out = resolved(spark, [("a", *blank), ("b", "12", "-", "Rome", "NY", "1"), ("c", *full), ("d", "12", "", "Rome", "NY", "2")],
                   [("r0", *blank), ("r1", *full), ("r2", *full), ("r3", "12", "", "Rome", "NY", "1")])
    assert out == {"a": (None, "unmatched", None), "b": (None, "unmatched", None), "d": (None, "unmatched", None),
                   "c": ("r1", "exact_address_components", 100.0)}


def test_hot_address_is_one_pair(spark):
    n = 3000
    crm = [(f"c{i}", "5", "Long Street", "Rome", "NY", "9") for i in range(n)]
    registry = [(f"r{i:05d}", "5", "Long Street", "Rome", "NY", "1") for i in range(n)]
    out = resolved(spark, crm, registry)
    assert len(out) == n and set(out.values()) == {("r00000", "fuzzy_street_name", 100.0)}


def test_threshold_below_half_is_refused(spark):
    with pytest.raises(ValueError, match="threshold"):
        resolved(spark, [], [], threshold=30.0)


def test_ranks_with_many_offsets_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_BROADCAST_OFFSETS", 0)
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "g int, v int")
    out = ranking.contiguous_rank(df, ["g"], [F.col("v").asc()])
    assert dict(out.dtypes)["rank"] == "bigint"
    assert sorted((r["g"], r["v"], r["rank"]) for r in out.collect()) == sorted((i % 3, i, i // 3 + 1) for i in range(60))


def test_numbers_of_any_size(spark):
    for value, text in ((1e21, "1000000000000000000000.0"), (12.25, "12.2"), (float("nan"), None)):
        assert one(spark, value, "double", lambda c: F.coalesce(fmt.fixed(c, 1), F.lit("null"))) in (text, "null", "nan")
    assert one(spark, 1e21, "double", lambda c: fmt.py_round(c, 1).cast("string")) == "1000000000000000000000.0"
    assert one(spark, 1e300, "double", lambda c: fmt.py_round(c, 1)) is None


def test_strip_and_title_case(spark):
    assert one(spark, "  Https://www.Acme.com/x　", "string", clean_domain) == "acme.com"
    for word in ("c-level", "VICE president", "o'neil 3rd", "élan vital", ""):
        assert one(spark, word, "string", tx.title_case) == word.title()
    assert one(spark, None, "string", tx.title_case) is None
    assert one(spark, None, "double", fmt.tier_80_60) == "#dc3545"


def test_first_row_prefers_values(spark):
    scored = spark.createDataFrame([("a",)], "company_id string")
    companies = spark.createDataFrame([("a", None, None, None), ("a", 7, "G", 5)],
                                      "company_id string, building_count_estimate int, growing_business_code string, contacts_count int")
    assert tuple(joins.enrich_raw_fields(scored, companies).first()) == ("a", 7, "G", 5)


def test_enrichment_keeps_kinds(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="canvass-json-"), "e.json")
    fields = {"score": 12.5, "n": 3, "ok": True, "none": None, "s": "x", "list": [1, "a"]}
    with open(path, "w") as f:
        json.dump({"metadata": {}, "companies": {"1": fields}}, f, indent=1)
    row = readers.load_research_enrichment(spark, path).first()
    assert row["company_id"] == "1" and json.loads(row["enrichment_json"]) == fields
    with open(path + ".bad.json", "w") as f:
        json.dump({"metadata": {}}, f)
    with pytest.raises(readers.SchemaValidationError):
        readers.load_research_enrichment(spark, path + ".bad.json")

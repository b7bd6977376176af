"""Hand-made hazard cases: exclusions, orphans, duplicates, domains, JSON,
text limits, gates, geo, channels, entity resolution against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from canvass import config
from canvass.functions import domains, ids, jsoncols, text
from canvass.operators import filters, geo, joins, quality, resolution, scoring
from canvass.plans import export, ranked
from conftest import rows


def test_exclusions_keep_null_codes(spark):
    df = spark.createDataFrame([("1", "61111018"), ("2", "61111005"), ("3", "61111007"), ("4", None)],
                               "company_id string, primary_naics string")
    assert rows(filters.apply_industry_exclusions(df), "company_id") == [("3",), ("4",)]


def test_orphans_and_building_count(spark):
    comp = spark.createDataFrame([("1", 3), ("1", None), ("2", None)], "company_id string, building_count int")
    scored = spark.createDataFrame([("1", 5), ("2", 1), ("9", 2)], "company_id string, building_count int")
    kept = joins.drop_orphans(scored, comp)
    assert rows(joins.merge_building_count(kept, comp), "company_id", "building_count") == [("1", 3), ("2", 0)]
    assert rows(joins.orphan_report(scored, comp, "scored")) == [("scored", 1, 1)]


def test_prepare_scored_end_to_end(spark):
    comp = spark.createDataFrame([("1", 4), ("2", 2), ("3", 1), ("4", 1)], "company_id string, building_count int")
    scored = spark.createDataFrame(
        [("1", "X", "6214", 50.0, 3), ("2", "Y", "6214", 80.0, 9), ("3", "Z", "61111018", 90.0, 1),
         ("4", "W", None, 10.0, 1), ("5", "V", "6214", 99.0, 1)],
        "company_id string, company_name string, primary_naics string, final_score double, rank int")
    scored = scored.withColumn("scoring_path", F.lit("prospect"))
    out = ranked.prepare_scored(scored, comp)
    assert rows(out, "company_id", "rank", "building_count") == [("1", 2, 4), ("2", 1, 2)]
    assert quality.rank_contiguity_violations(out).count() == 0
    assert quality.rank_order_violations(out).count() == 0


def test_leading_zero_ids(spark):
    b = spark.createDataFrame([("b1", "007526346"), ("b2", "7526346"), ("b3", "000"), ("b4", "1")],
                              "building_id string, company_id string")
    want = spark.createDataFrame([("7526346",), ("0",)], "company_id string")
    got = rows(joins.buildings_for_companies(b, want), "building_id", "requested_id")
    assert got == [("b1", "7526346"), ("b2", "7526346"), ("b3", "0")]
    assert rows(spark.createDataFrame([("000",), (None,)], "x string").select(ids.strip_leading_zeros(F.col("x")))) == \
        [("0",), (None,)]


def test_domains(spark):
    df = spark.createDataFrame([("HTTPS://www.Acme.com/about/",), ("\tacme.com\n",), ("  ",), (None,), ("www.x.org//",)],
                               "u string")
    got = [tuple(r) for r in df.select(domains.clean_domain(F.col("u")), domains.clean_crm_domain(F.col("u"))).collect()]
    assert got == [("acme.com", "acme.com/about"), ("acme.com", "acme.com"), (None, None), (None, None),
                   ("x.org", "x.org")]


def test_crm_presence_strict_and_loose(spark):
    comp = spark.createDataFrame([("1", "https://www.acme.com/a"), ("2", None), ("3", "beta.io")],
                                 "company_id string, website string")
    crm = spark.createDataFrame([("http://acme.com/",), ("beta.io/contact",)], "domain string")
    s = rows(joins.flag_crm_presence(comp.select("company_id"), comp, crm), "company_id", "in_hubspot")
    assert s == [("1", True), ("2", False), ("3", False)]
    loose = rows(joins.flag_crm_presence(comp.select("company_id"), comp, crm, strict=False), "company_id", "in_hubspot")
    assert loose == [("1", True), ("2", False), ("3", True)]


@pytest.mark.parametrize("raw,count,txt", [
    ('["a", "b"]', 2, "a\nb"), ("[]", 0, ""), (None, 0, ""), ("", 0, ""), ("not json", 0, "not json"),
    ('"scalar"', 0, "scalar"), ("[1, 2]", 0, "[1, 2]"), ("true", 0, "True"), ("null", 0, "None"),
])
def test_expand_json_array(spark, raw, count, txt):
    df = spark.createDataFrame([(raw,)], "s string")
    n, t = jsoncols.expand_json_array(F.col("s"))
    assert tuple(df.select(n, t).collect()[0]) == (count, txt)


def test_research_summary_defaults(spark):
    full = ('{"news_findings": null, "jobs_findings": {"found_ops_roles": true, "role_examples": '
            '["a","b","c","d","e","f"]}, "corporate_ops_findings": {"summary": "ok"}}')
    df = spark.createDataFrame([(full,), ("bad",), (None,)], "s string")
    got = df.select(*jsoncols.expand_research_summary(F.col("s"))).collect()
    assert got[0].news_found is False and got[0].news_headline == ""
    assert got[0].jobs_found_ops_roles is True and got[0].jobs_role_examples == "a\nb\nc\nd\ne"
    assert got[0].corp_summary == "ok"
    assert got[1].jobs_role_examples == "" and got[2].corp_has_vendor_portal is False


def test_text_limits(spark):
    df = spark.createDataFrame([("x" * 500,), ("y" * 501,), (" ".join(["w"] * 5000),), (" ".join(["w"] * 5001),),
                                (None,)], "t string")
    short = [r[0] for r in df.select(text.truncate_reasoning(F.col("t"))).collect()]
    assert short[0] == "x" * 500 and short[1] == "y" * 500 + "..." and short[4] == ""
    t, cut = text.truncate_document(F.col("t"))
    res = df.select(t, cut, text.word_count(F.col("t"))).collect()
    assert res[2][1] is False and res[3][1] is True and res[2][2] == 5000 and res[3][2] == 5001
    assert res[3][0].endswith(config.TRUNCATION_NOTICE) and res[3][0].count("w") == 5000


def test_markers_and_validity(spark):
    doc = "x " * 300 + "**URGENT:** fix URGENT now **ACTION:** go"
    df = spark.createDataFrame([(doc, "completed", 50), (doc, "pending", 500), ("short", "completed", 500),
                                (None, "completed", 1)], "d string, s string, w int")
    r = df.select(text.count_marker(F.col("d"), "URGENT"), text.format_research_document(F.col("d")),
                  text.document_validity(F.col("d"), F.col("s"), F.col("w"))).collect()
    assert r[0][0] == 2 and "🚨 **URGENT:**" in r[0][1] and "✅ **ACTION:**" in r[0][1]
    assert r[0][2] == "Word count too low: 50 (minimum 100)"
    assert r[1][2] == "Status is 'pending', expected 'completed'"
    assert r[2][2] == "Document too short: 5 chars (minimum 500)"
    assert r[3][2] == "Missing 'research_document' field"


def test_gates(spark):
    scored = spark.createDataFrame([("1", "a", 1, 10.0, 1.0, 1.0, "p"), ("1", "b", 2, None, 1.0, 1.0, "p")],
                                   "company_id string, company_name string, rank int, final_score double, "
                                   "naics_attractiveness_score double, company_opportunity_score double, scoring_path string")
    comp = spark.createDataFrame([("1",)], "company_id string")
    b = spark.createDataFrame([("b1", "1", 1.0, None), ("b2", "7", 1.0, 2.0)],
                              "building_id string, company_id string, latitude double, longitude double")
    rep = {(r.gate, r.subject): r for r in quality.gate_report(spark, scored, comp, b).collect()}
    assert rep[("critical_field_completeness", "final_score")].passed is False
    assert rep[("no_duplicates", "scored.company_id")].value == 2.0
    assert rep[("join_integrity", "buildings->companies")].detail == "sample: 7"
    assert rep[("coordinate_coverage", "buildings")].value == 0.5
    with pytest.raises(quality.DataQualityError):
        quality.run_startup_validation(spark, scored, comp, b)
    empty = spark.createDataFrame([], scored.schema)
    assert all(not r.passed for r in quality.field_completeness(empty).collect())   # H16


def test_geo(spark):
    df = spark.createDataFrame([("1", "40", "-70", "manual"), ("2", None, "1", "dataaxle"), ("3", "x", "1", "manual"),
                                ("4", "91.5", "0", "dataaxle"), ("5", "0", "-181", "other")],
                               "company_id string, latitude string, longitude string, source string")
    r = rows(geo.coordinate_reason(df), "company_id", "coord_reason")
    assert r == [("1", None), ("2", "Coordinates missing"), ("3", "Coordinates not numeric"),
                 ("4", "Latitude out of range: 91.5"), ("5", "Longitude out of range: -181.0")]
    valid, excluded = geo.split_valid(df)
    assert valid.count() + excluded.count() == df.count()
    assert tuple(geo.exclusion_summary(df).collect()[0]) == (4, 2, 1)


def test_channels_longest_prefix(spark):
    ch = spark.createDataFrame([("62", "health", "LOW"), ("6214", "dialysis", "HIGH")],
                               "prefix string, channel_id string, channel_priority string")
    df = spark.createDataFrame([("a", "62149201"), ("b", "62110000"), ("c", "11"), ("d", None)],
                               "company_id string, primary_naics string")
    assert rows(scoring.assign_channel(df, ch), "company_id", "channel_id") == [
        ("a", "dialysis"), ("b", "health"), ("c", "general"), ("d", "general")]


def test_search_literal_and_synonyms(spark):
    df = spark.createDataFrame([("6214", "Outpatient Care Centers", None), ("2361", "Residential Building (a+b)", "x"),
                                ("6111", None, "schools")], "naics_code string, naics_description string, reasoning string")
    assert rows(filters.search_industries(df, " 62 "), "naics_code") == [("6214",)]
    assert rows(filters.search_industries(df, "construction"), "naics_code") == [("2361",)]
    assert rows(filters.search_industries(df, "(a+b)"), "naics_code") == [("2361",)]     # H6 literal
    assert rows(filters.search_industries(df, "none"), "naics_code") == []               # H7


def test_export_merge_dedup_and_suffix(spark):
    scored = spark.createDataFrame([("1", "A", 1, "r0")], "company_id string, company_name string, rank int, timing string")
    research = spark.createDataFrame([("1", True, "long " * 200, '["s1"]', "t1"), ("1", False, "z", None, "t2")],
                                     "company_id string, had_web_research boolean, reasoning string, "
                                     "hot_lead_signals string, timing string")
    comp = spark.createDataFrame([("1", "w1", 3), ("1", "w2", 4)], "company_id string, website string, "
                                                                    "building_count_estimate int")
    ids_df = spark.createDataFrame([("1",)], "company_id string")
    m = export.merge_export_data(scored, research, comp, ids_df, None)
    assert m.count() == 1 and "timing_research" in m.columns
    s1 = export.sheet_rankings(m).collect()[0].asDict()
    assert s1["Hot Lead Signals (Count)"] in (0, 1) and s1["In HubSpot"] is False


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("seed,alphabet,max_len", [(11, "ab", 24), (5, "abc", 45)])
def test_entity_resolution_matches_brute_force(spark, seed, alphabet, max_len):
    rnd = random.Random(seed)
    # tiny alphabet + one hot block: worst case for candidate blow-up
    reg, crm = [], []
    for i in range(120):
        street = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, max_len)))
        reg.append((f"R{i:03d}", "1", street, "c", "s", "z"))
    for i in range(150):
        base = rnd.choice(reg)[2]
        s = list(base)
        for _ in range(rnd.randint(0, 3)):
            if s and rnd.random() < 0.5:
                s[rnd.randrange(len(s))] = rnd.choice(alphabet)
            else:
                s.insert(rnd.randrange(len(s) + 1), rnd.choice(alphabet))
        crm.append((f"H{i:03d}", "building", "1", "".join(s), "c", "s", "z2" if i % 2 else "z"))
    r = spark.createDataFrame(reg, "dataaxle_id string, street_number string, street string, city string, "
                                   "state string, zip string")
    c = spark.createDataFrame(crm, "hubspot_id string, hubspot_type string, street_number string, street string, "
                                   "city string, state string, zip string")
    got = {x.hubspot_id: (x.dataaxle_id, x.match_type) for x in resolution.resolve(c, r).collect()}
    for hid, _, num, street, city, state, zp in crm:
        exact = sorted(x[0] for x in reg if (x[1], x[2], x[3], x[4], x[5]) == (num, street, city, state, zp))
        if exact:
            assert got[hid] == (exact[0], "exact_address_components")
            continue
        best = None
        for rid, _, s2, *_ in reg:
            longer = max(len(street), len(s2))
            sim = 100.0 if longer == 0 else (1.0 - _lev(street, s2) / longer) * 100.0
            if sim >= 90.0 and (best is None or (-sim, rid) < (-best[0], best[1])):
                best = (sim, rid)
        assert got[hid] == ((best[1], "fuzzy_street_name") if best else (None, "unmatched")), hid
    assert resolution.prefix_is_exact(90.0)


def test_first_and_last_wins_with_explicit_order(spark):
    """Raw fields keep the first row per id, rate lookups the last."""
    scored = spark.createDataFrame([("1",), ("2",)], "company_id string")
    comp = spark.createDataFrame([("1", 3, "G", 1, 0), ("1", 9, "S", 2, 1), ("2", 5, "C", 0, 0)],
                                 "company_id string, building_count_estimate int, growing_business_code string, "
                                 "contacts_count int, pos int")
    e = joins.enrich_raw_fields(scored, comp, order_col="pos")
    assert rows(e, "company_id", "building_count_estimate", "growing_business_code") == [("1", 3, "G"), ("2", 5, "C")]
    pen = spark.createDataFrame([("1", 10.0, 0), ("1", 20.0, 1)], "company_id string, penetration_rate double, pos int")
    assert rows(joins.penetration_lookup(scored, pen, order_col="pos"), "company_id", "penetration_rate") == \
        [("1", 20.0), ("2", None)]


def test_naics_descriptions(spark):
    from canvass.functions import naics
    metrics = spark.createDataFrame([("3256", "Cleaning Products"), ("4231", "NAICS 4231"), ("999999", "Custom 999999")],
                                    "naics_code string, naics_description string")
    desc = naics.description_table(spark, metrics)
    codes = spark.createDataFrame([("111419",), ("6214",), ("6111.0",), ("3256",), ("4231",), ("999999",), ("5",),
                                   (None,), ("33",)], "code string")
    got = dict(rows(naics.describe(codes, "code", desc, "d"), "code", "d"))
    assert got["111419"] == "Greenhouse, Nursery, and Floriculture Production"     # 4-digit prefix
    assert got["6214"] == "Healthcare Services (6214)"                              # sector fallback
    assert got["6111.0"] == "Educational Services (6111)"                           # canonical code
    assert got["3256"] == "Cleaning Products"                                       # metrics beat inline
    assert got["4231"].startswith("Motor Vehicle")                                  # generic metrics text ignored
    assert got["999999"] == "Custom 999999"                                         # full-code match
    assert got["5"] == "NAICS 5" and got[None] == "Unknown" and got["33"] == "Manufacturing (33)"


def test_crm_presence_last_row_wins(spark):
    comp = spark.createDataFrame([("1", "https://acme.com", 1), ("1", "other.org", 2)],
                                 "company_id string, website string, pos int")
    crm = spark.createDataFrame([("acme.com",)], "domain string")
    ids = comp.select("company_id").distinct()
    assert rows(joins.flag_crm_presence(ids, comp, crm), "company_id", "in_hubspot") == [("1", True)]
    assert rows(joins.flag_crm_presence(ids, comp, crm, order_col="pos"), "company_id", "in_hubspot") == [("1", False)]


def test_scoring_anchors(spark):
    df = spark.createDataFrame([(3600, 0.2, 2, True, 70.0, 85.0), (1, 0.5, 0, False, 70.0, 85.0),
                                (200000, -0.1, None, None, None, None)],
                               "n long, margin double, contacts int, cust boolean, naics double, comp double")
    r = df.select(scoring.market_size_score(F.col("n")).alias("m"), scoring.profitability_score(F.col("margin")).alias("p"),
                  scoring.contact_score(F.col("contacts")).alias("c"),
                  scoring.final_score(F.col("cust"), F.col("naics"), F.col("comp")).alias("f"),
                  scoring.prospect_opportunity(*[F.lit(None).cast("double")] * 5).alias("neutral")).collect()
    assert round(r[0].m, 1) == 71.1 and r[1].m == 0.0 and r[2].m == 100.0      # F6 anchors
    assert r[0].p == 50.0 and r[1].p == 100.0 and r[2].p == 0.0                 # F7 clamp
    assert (r[0].c, r[1].c, r[2].c) == (75.0, 25.0, 25.0)                       # F8
    assert r[0].f == 85.0 and r[1].f == pytest.approx(0.4 * 70 + 0.6 * 85)      # F4 / H21
    assert r[0].neutral == pytest.approx(50.0)                                  # F5
    assert abs(sum(config.NAICS_WEIGHTS.values()) - 1) < 1e-9                   # F12
    assert abs(sum(config.PROSPECT_WEIGHTS.values()) - 1) < 1e-9
    assert abs(sum(config.CUSTOMER_WEIGHTS.values()) - 1) < 1e-9


def test_rank_validators_and_gate_order(spark):
    df = spark.createDataFrame([("1", "A", 90.0, 1), ("2", "A", 80.0, 3), ("3", "B", 50.0, 1), ("4", "B", 60.0, 2),
                                ("5", "C", 10.0, None)],
                               "company_id string, primary_naics string, final_score double, rank int")
    assert rows(quality.rank_contiguity_violations(df), "primary_naics") == [("A",), ("C",)]     # gap, null
    assert rows(quality.rank_order_violations(df), "company_id", "expected_rank") == \
        [("2", 2), ("3", 2), ("4", 1), ("5", 1)]
    # blocking gates stop at the first failure in order: completeness before duplicates
    scored = spark.createDataFrame([("1", None, 1, 1.0, 1.0, 1.0, "p"), ("1", None, 2, 1.0, 1.0, 1.0, "p")],
                                   "company_id string, company_name string, rank int, final_score double, "
                                   "naics_attractiveness_score double, company_opportunity_score double, scoring_path string")
    comp = spark.createDataFrame([("1",)], "company_id string")
    b = spark.createDataFrame([("b1", "1", 1.0, 1.0)], "building_id string, company_id string, latitude double, longitude double")
    with pytest.raises(quality.DataQualityError, match="critical_field_completeness"):
        quality.run_startup_validation(spark, scored, comp, b)


def test_sqft_rule(spark):
    b = spark.createDataFrame([("b1", "2", "branch"), ("b2", "2", "headquarters"), ("b3", None, "branch"),
                               ("b4", "5", "branch"), ("b5", "9", "branch")],
                              "building_id string, square_footage_code string, place_type string")
    out = scoring.apply_sqft_rule(b, scoring.sqft_table(spark), place_type_col="place_type")
    assert rows(out, "building_id", "sqft_unknown") == [("b2", False), ("b3", True), ("b4", False), ("b5", True)]


def test_street_prefixes_are_computed_once_a_street(spark):
    """The bigrams of a street are a column that the lambdas read: they were computed again for each bigram."""
    from canvass.operators import resolution
    schema = "id string, t string, street_number string, street string, city string, state string, zip string"
    crm = spark.createDataFrame([("h1", "b", "5", "Old Bananana Road", "c", "s", "1"), ("h2", "b", "5", "Elsewhere", "c", "s", "1")], schema)
    registry = spark.createDataFrame([("d1", "b", "5", "Old Banananna Road", "c", "s", "2"), ("d2", "b", "5", "New Street", "c", "s", "2")], schema)
    log = resolution.resolve(crm, registry, crm_id="id", crm_type="t", registry_id="id")
    assert "filter(slice(transform(" not in log._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.hubspot_id, r.dataaxle_id) for r in log.collect()) == [("h1", "d1"), ("h2", None)]

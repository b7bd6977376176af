"""Readers (S1-S16), declared types, optional sources, and the export sink."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from canvass.sources import readers, schemas, writers
from conftest import rows


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w") as f:
        f.write(text)
    return p


@pytest.fixture(scope="module")
def data_dir():
    d = tempfile.mkdtemp(prefix="canvass-src-")
    _write(d, "companies.csv",
           "company_id,name,primary_naics,hq_latitude,hq_longitude,building_count_estimate,website\n"
           "007526346,Acme,61111018,40.1,-75.2,12.0,https://www.acme.com/about\n"
           "7526347,Beta,6214,91,text,,\n"
           "7526348,Gamma,,NaN,10,3,\n")
    _write(d, "scored_companies_final.csv",
           "company_id,company_name,primary_naics,final_score,naics_attractiveness_score,company_opportunity_score,"
           "scoring_path,is_customer,rank\n"
           "007526346,Acme,61111018,80.5,70,85,prospect,False,1\n"
           "7526347,Beta,6214,NaN,70,60,customer_expansion,True,2\n")
    _write(d, "scored_companies.csv", "company_id,company_name\n1,x\n")
    _write(d, "contact_summary.csv", "company_id,contact_count,last_contact_date,contact_names,contact_emails\n")
    _write(d, "penetration_by_company.csv",
           "company_id,total_buildings_estimate,served_buildings,penetration_rate,is_customer\n"
           "11,64,11,17.1875,True\n12,10,0,0.0,False\n")
    _write(d, "diag.json", json.dumps({"weight_validation": {"sum": 1.0004}}))
    return d


def test_companies_types_and_alias(spark, data_dir):
    df = readers.load_companies(spark, os.path.join(data_dir, "companies.csv"))
    got = rows(df, "company_id", "hq_latitude", "hq_longitude", "building_count")
    # leading zeros kept; '12.0' -> 12; 'text' and 'NaN' -> null; alias from the estimate
    assert got == [("007526346", 40.1, -75.2, 12), ("7526347", 91.0, None, None), ("7526348", None, 10.0, 3)]
    assert df.schema["building_count"].dataType.simpleString() == "int"


def test_required_columns(spark, data_dir):
    p = _write(data_dir, "bad.csv", "company_id,name\n1,a\n")
    with pytest.raises(readers.SchemaValidationError):
        readers.load_companies(spark, p)


def test_scored_prefers_final_file_and_new_format(spark, data_dir):
    df = readers.load_scored(spark, os.path.join(data_dir, "scored_companies_final.csv"),
                             os.path.join(data_dir, "scored_companies.csv"))
    assert readers.detect_score_format(df) == "new"
    assert rows(df, "company_id", "final_score", "is_customer") == [("007526346", 80.5, False), ("7526347", None, True)]


def test_optional_sources(spark, data_dir):
    assert readers.load_company_research(spark, os.path.join(data_dir, "missing.csv")).count() == 0
    assert readers.load_churn_predictions(spark, os.path.join(data_dir, "missing.csv")).count() == 0
    m = readers.load_naics_metrics(spark, os.path.join(data_dir, "missing.csv"))
    assert m.count() == 0 and "attractiveness_score" in m.columns     # H23: full schema
    c = readers.load_contact_summary(spark, os.path.join(data_dir, "contact_summary.csv"))
    assert c.count() == 0 and c.columns[:5] == [f.name for f in schemas.CONTACT_SUMMARY.fields]


def test_penetration_fixture_fact(spark, data_dir):
    p = readers.load_penetration(spark, os.path.join(data_dir, "penetration_by_company.csv"))
    assert rows(p, "company_id", "penetration_rate") == [("11", 17.1875), ("12", 0.0)]


def test_diagnostics(spark, data_dir):
    d = readers.load_scoring_diagnostics(spark, os.path.join(data_dir, "diag.json"))
    assert d.collect()[0].weight_sum == pytest.approx(1.0004)


def test_buildings_rules(spark):
    df = spark.createDataFrame([("b1", "1", None, None, "4"), ("b2", "1", "HubSpot", None, None),
                                ("b3", "2", "dataaxle", True, "2")],
                               "building_id string, company_id string, source string, is_served boolean, "
                               "square_footage_code string")
    df = readers.conform(df, schemas.BUILDINGS)
    out = readers.normalize_buildings(df)
    assert rows(out, "building_id", "source", "is_served", "square_footage") == [
        ("b1", "dataaxle", False, "4"), ("b2", "HubSpot", True, None), ("b3", "dataaxle", True, "2")]


def test_export_sink(spark):
    out = tempfile.mkdtemp(prefix="canvass-out-")
    t = spark.createDataFrame([("1", 2.0)], "`Company ID` string, `Final Score` double")
    written = writers.write_export({"Company Rankings": t, "Web Research Details": None}, out, fmt="parquet")
    assert written == ["Company Rankings"]
    back = spark.read.parquet(os.path.join(out, "company_rankings"))
    assert back.columns == ["company_id", "final_score"] and back.count() == 1
    writers.write_export({"Company Rankings": t}, out + "/csv", fmt="csv")
    assert spark.read.option("header", "true").csv(out + "/csv/company_rankings").columns == ["Company ID", "Final Score"]


def test_research_enrichment_and_documents(spark):
    d = tempfile.mkdtemp(prefix="canvass-json-")
    p = _write(d, "enrichment.json", json.dumps({"metadata": {"version": 1},
                                                  "companies": {"001": {"score": 1}, "2": {"score": 2}}}))
    e = readers.load_research_enrichment(spark, p)
    assert sorted(r.company_id for r in e.collect()) == ["001", "2"]
    docs = os.path.join(d, "docs")
    os.makedirs(docs)
    _write(docs, "7526346.json", json.dumps({"company_name": "Acme", "research_document": "x" * 600,
                                             "status": "completed", "document_stats": {"word_count": 120}}))
    _write(docs, "42.json", "{not json")
    r = {x.company_id: x for x in readers.load_research_documents(spark, docs).collect()}
    assert r["7526346"].status == "completed" and r["7526346"].document_stats.word_count == 120
    assert r["42"].research_document is None and r["42"]._corrupt_record is not None


def test_config_files(spark):
    from canvass.sources import config_files
    d = tempfile.mkdtemp(prefix="canvass-cfg-")
    p = _write(d, "exclusions.yaml", "version: '1.0'\npublic_education:\n  enabled: true\n  naics_codes:\n"
                                     "    - '61111018'\n    - '61111005'\nother:\n  enabled: false\n  naics_codes: ['92']\n")
    assert config_files.excluded_codes(p) == ["61111018", "61111005"]
    assert config_files.excluded_codes(os.path.join(d, "missing.yaml")) == ["61111018", "61111005"]
    c = _write(d, "channels.yaml", "default_channel: general\nchannels:\n  k12:\n    naics_codes: ['6111']\n"
                                   "    priority: MEDIUM\n")
    chans, default = config_files.load_channels(c)
    assert default == "general" and chans["k12"]["naics_codes"] == ["6111"]
    bad = _write(d, "bad.yaml", "default_channel: x\n")
    with pytest.raises(config_files.ConfigError):
        config_files.load_channels(bad)
    assert len(config_files.load_naics_targets(None)) == 39
    assert sum(n for _, n in config_files.load_naics_targets(None)) == 11170    # H20: per-code caps

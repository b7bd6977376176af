"""Config documents are followed exactly; exports and match logs are written once; lists stay bounded."""

import pytest
from pyspark.sql import functions as F

from canvass import config
from canvass.operators import aggregates, quality, scoring
from canvass.plans import export
from canvass.sources import config_files


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize("load", [config_files.load_channels, config_files.load_naics_targets, config_files.load_sqft_codes,
                                  config_files.load_six_digit_targets])
def test_a_missing_or_wrong_document_raises(spark, tmp_path, load):
    for path in (str(tmp_path / "missing.yaml"), put(tmp_path, "empty.yaml", ""), put(tmp_path, "other.yaml", "version: '1.0'\nx: 1\n")):
        with pytest.raises(config_files.ConfigError):
            load(path)


def test_versions_and_contents(spark, tmp_path):
    doc = "target_naics:\n  - naics_code: 6111\n    max_companies: 2\n"
    assert config_files.load_naics_targets(put(tmp_path, "a.yaml", "version: '1.3'\n" + doc)) == [("6111", 2)]
    with pytest.raises(config_files.ConfigError):
        config_files.load_naics_targets(put(tmp_path, "b.yaml", "version: '2.0'\n" + doc))
    codes = config_files.load_sqft_codes("file://" + put(tmp_path, "c.yaml", "code_mappings:\n  '4':\n    range: x\n    range_sqft_min: 5\n    include: true\n"))
    assert codes == [("4", "x", 5, None, True)]
    assert config_files.load_six_digit_targets(None) == config.TARGET_SIX_DIGIT and len(config.TARGET_SIX_DIGIT) == 8


def test_overrides_come_before_base_weights(spark):
    got = {(r.channel_id, r.component): (r.base_weight, r.weight) for r in scoring.channel_weights(spark).collect()}
    assert got[("healthcare_dialysis", "hygiene_relevance")] == (0.10, 0.15)
    assert got[("healthcare_dialysis", "decision_maker_clarity")] == (0.10, 0.10)
    assert got[("general", "geographic_fit")] == (0.10, 0.10)


def merged(spark, researched):
    rows = [("1", "A", r, "why") for r in researched]
    return spark.createDataFrame(rows, "company_id string, company_name string, had_web_research boolean, reasoning string")


def test_export_is_written_once_and_observed(spark):
    run = export.Export(merged(spark, [True, False, None]))
    assert (run.rows, run.researched) == (3, 1) and run.research().count() == 1
    info = {"customer_status": "prospect"}
    assert run.manifest(info, "now").collect() == export.export_manifest(merged(spark, [True, False, None]), info, "now").collect()
    empty = export.Export(merged(spark, [False, None]))
    assert empty.research() is None and empty.rows == 2


def test_er_log_gate_equals_the_gate_of_a_table(spark):
    for kinds in (["exact"] * 9 + ["unmatched"], ["unmatched", None, "fuzzy"], []):
        log = spark.createDataFrame([(k, 1.0) for k in kinds], "match_type string, confidence_score double")
        assert quality.ErLog(log).gate().collect() == quality.er_orphan_gate(log).collect()


def test_contact_lists_of_a_hot_company(spark):
    """One company with most of the contacts: every text is bounded, nothing is lost."""
    hot = spark.range(5000).select(F.lit("1").alias("company_id"), F.format_string("n%05d", F.col("id") % 2500).alias("contact_name"),
                                   F.format_string("e%05d@x", "id").alias("contact_email"))
    some = spark.createDataFrame([("2", None, "a@x"), ("2", "b", "a@x"), (None, "c", None)],
                                 "company_id string, contact_name string, contact_email string")
    rows = aggregates.contact_lists(hot.unionByName(some), chunk=100).collect()
    assert max(r.n_values for r in rows) == 100
    emails = [v for r in sorted((r for r in rows if (r.company_id, r.kind) == ("1", "email")), key=lambda r: r.chunk) for v in r.text.split("; ")]
    assert emails == [f"e{i:05d}@x" for i in range(5000)]
    assert sorted((r.kind, r.chunk, r.text) for r in rows if r.company_id == "2") == [("email", 0, "a@x"), ("name", 0, "b")]

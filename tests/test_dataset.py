"""The data-folder flows (L1-L4) end to end on a small hand-made folder in
the original file layout."""

import os
import tempfile

import pytest
from canvass.plans.dataset import LAYOUT, ProspectData


def _put(root, key, text):
    p = os.path.join(root, LAYOUT[key])
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def folder():
    root = tempfile.mkdtemp(prefix="canvass-data-")
    _put(root, "companies", "company_id,name,primary_naics,hq_latitude,hq_longitude,building_count_estimate,"
                            "website,growing_business_code,contacts_count\n"
                            "1,Acme,62149201,40,-75,3,https://www.acme.com/x,G,2\n"
                            "2,Beta,62149201,41,-76,1,beta.io,+,0\n"
                            "3,Gamma,61111018,42,-77,2,,C,1\n"
                            "4,Delta,48411000,43,-78,5,delta.net,S,4\n")
    _put(root, "buildings", "building_id,company_id,latitude,longitude,source\n"
                            "b1,1,40,-75,hubspot\nb2,1,40,-75,\nb3,2,41,-76,manual\nb4,9,0,0,\n")
    _put(root, "scored_final", "company_id,company_name,primary_naics,naics_4digit,final_score,"
                               "naics_attractiveness_score,company_opportunity_score,scoring_path,is_customer,rank,state\n"
                               "1,Acme,62149201,6214,80,70,85,prospect,False,4,PA\n"
                               "2,Beta,62149201,6214,90,70,95,prospect,False,9,NY\n"
                               "3,Gamma,61111018,6111,70,60,75,prospect,False,1,NY\n"
                               "4,Delta,48411000,4841,60,50,65,customer_expansion,True,2,PA\n"
                               "5,Ghost,48411000,4841,99,50,99,prospect,False,1,PA\n")
    _put(root, "crm_companies", "domain\nhttp://acme.com/\ndelta.net/contact\n")
    _put(root, "penetration", "company_id,total_buildings_estimate,served_buildings,penetration_rate\n1,3,1,33.3\n")
    _put(root, "naics_metrics", "naics_code,naics_description,attractiveness_score,icp_fit_score,profitability_score,"
                                "market_size_score,market_size_count,churn_health_score,ticket_health_score\n"
                                "6214,,80,90,50,70,3600,90,50\n4841,NAICS 4841,60,60,50,60,100,80,40\n")
    _put(root, "research", "company_id,company_name,had_web_research,icp_fit_score,confidence,reasoning,recommendation,"
                           "hot_lead_signals,concerns\n1,Acme,True,80,high,good fit,pursue,\"[\"\"a\"\",\"\"b\"\"]\",bad\n")
    return root


def test_flows(spark, folder):
    d = ProspectData(spark, folder)
    r = {x.company_id: x for x in d.ranked_companies().collect()}
    assert set(r) == {"1", "2", "4"}                       # orphan 5 and excluded 3 gone
    assert (r["2"].rank, r["1"].rank, r["4"].rank) == (1, 2, 1)
    assert r["1"].building_count == 3
    v = {x.company_id: x for x in d.ranked_view().collect()}
    assert v["2"].global_rank == 1 and v["1"].in_hubspot is True and v["4"].in_hubspot is False
    ind = {x.naics_code: x for x in d.industry_rankings().collect()}
    assert ind["6214"].company_count == 2 and ind["6214"].naics_description == "Healthcare Services (6214)"
    assert ind["4841"].customer_count == 1
    prof = d.company_profiles(spark.createDataFrame([("1",)], "company_id string")).collect()
    assert prof[0].total_buildings == 2 and prof[0].recommendation == "pursue"
    out = tempfile.mkdtemp(prefix="canvass-exp-")
    written = d.export(None, out, {"customer_status": "All"}, fmt="csv")
    assert "Company Rankings" in written
    back = spark.read.option("header", "true").csv(os.path.join(out, "company_rankings"))
    assert back.count() == 3


def test_startup_validation_passes_on_clean_folder(spark, folder):
    d = ProspectData(spark, folder)
    res = d.startup_validation()
    assert res["blocking_gates"]["join_integrity"] == "PASS"
    assert res["non_blocking_gates"]["scoring_weights"]["passed"] is False   # no diagnostics file


def test_document_report(spark, folder):
    import json
    docs = os.path.join(folder, LAYOUT["research_documents"])
    os.makedirs(docs, exist_ok=True)
    with open(os.path.join(docs, "1.json"), "w") as f:
        json.dump({"company_name": "Acme", "research_document": "**URGENT:** call " + "word " * 150,
                   "status": "completed", "document_stats": {"word_count": 152}}, f)
    with open(os.path.join(docs, "2.json"), "w") as f:
        json.dump({"company_name": "Beta", "research_document": "short", "status": "pending"}, f)
    rep = {r.company_id: r for r in ProspectData(spark, folder).document_report().collect()}
    assert rep["1"].urgent_flags == 1 and rep["1"].word_count == 152 and rep["1"].reason is None
    assert rep["2"].reason == "Status is 'pending', expected 'completed'"

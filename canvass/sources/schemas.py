"""Declared schemas of the prospect tables (ids are always strings).

``REQUIRED`` lists the columns each loader insists on (P14); every other
column is optional and, when absent from a file, is added as a typed null so
downstream plans keep a stable schema (H24).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


COMPANIES = _schema(
    ("company_id", S), ("name", S), ("primary_naics", S), ("hq_latitude", D), ("hq_longitude", D),
    ("building_count", I), ("building_count_estimate", I), ("website", S), ("growing_business_code", S),
    ("contacts_count", I), ("primary_contact", S), ("city", S), ("state", S), ("employees", I),
    ("location_employee_size", I), ("sales_volume", D), ("corporate_sales_revenue", D), ("revenue", D))

BUILDINGS = _schema(
    ("building_id", S), ("company_id", S), ("latitude", D), ("longitude", D), ("source", S),
    ("is_served", B), ("square_footage_code", S), ("square_footage", S), ("city", S), ("state", S))

SCORED_NEW = _schema(
    ("company_id", S), ("company_name", S), ("primary_naics", S), ("naics_4digit", S), ("final_score", D),
    ("naics_attractiveness_score", D), ("company_opportunity_score", D), ("scoring_path", S),
    ("is_customer", B), ("rank", I), ("city", S), ("state", S), ("icp_fit_score", D), ("buildings_score", D),
    ("revenue_score", D), ("growth_score", D), ("contact_score", D), ("expansion_score", D),
    ("churn_score", D), ("profitability_score", D), ("tickets_score", D), ("location_employee_size", I),
    ("sales_volume", D), ("scoring_reason", S), ("icp_fit_reasoning", S), ("has_research_doc", B),
    ("research_recency", S))

SCORED_OLD = _schema(
    ("company_id", S), ("company_name", S), ("primary_naics", S), ("source", S), ("channel_id", S),
    ("standard_score", D), ("augmented_score", D), ("augmented_confidence", D), ("icp_fit_score", D),
    ("segment_rank", I), ("urgent_flags", I), ("action_flags", I), ("has_research_doc", B))

NAICS_METRICS = _schema(
    ("naics_code", S), ("naics_description", S), ("icp_fit_reasoning", S), ("attractiveness_score", D),
    ("icp_fit_score", D), ("profitability_score", D), ("market_size_score", D), ("churn_health_score", D),
    ("ticket_health_score", D), ("market_size_count", L))

NAICS_CODES = _schema(("naics_code", S), ("description", S))

PENETRATION = _schema(
    ("company_id", S), ("total_buildings_estimate", I), ("served_buildings", I), ("penetration_rate", D),
    ("is_customer", B), ("hubspot_company_id", S), ("customer_code", S), ("data_quality", S))

CONTACT_SUMMARY = _schema(
    ("company_id", S), ("contact_count", I), ("last_contact_date", S), ("contact_names", S),
    ("contact_emails", S))

ENTITY_RESOLUTION_LOG = _schema(
    ("hubspot_id", S), ("hubspot_type", S), ("dataaxle_id", S), ("match_type", S), ("confidence_score", D))

CRM_INTERACTIONS = _schema(
    ("engagement_id", S), ("company_id", S), ("engagement_type", S), ("timestamp", S), ("body", S))

CRM_COMPANIES = _schema(("domain", S))

COMPANY_RESEARCH = _schema(
    ("company_id", S), ("company_name", S), ("had_web_research", B), ("icp_fit_score", D), ("confidence", S),
    ("reasoning", S), ("recommendation", S), ("timing", S), ("hot_lead_signals", S), ("concerns", S),
    ("research_summary", S))

CHURN_PREDICTIONS = _schema(
    ("company_id", S), ("churn_probability", D), ("risk_tier", S), ("prediction_date", S))

RESEARCH_DOCUMENT = T.StructType([
    T.StructField("company_name", S), T.StructField("research_document", S), T.StructField("status", S),
    T.StructField("document_stats", T.StructType([T.StructField("word_count", I)])),
    T.StructField("_corrupt_record", S)])

SCORING_DIAGNOSTICS = T.StructType([
    T.StructField("weight_validation", T.StructType([T.StructField("sum", D)]))])

REQUIRED = {
    "companies": ["company_id", "name", "primary_naics", "hq_latitude", "hq_longitude"],
    "buildings": ["building_id", "company_id", "latitude", "longitude"],
    "scored_new": ["company_id", "company_name", "primary_naics", "final_score", "naics_attractiveness_score",
                   "company_opportunity_score", "scoring_path", "is_customer"],
    "scored_old": ["company_id", "company_name", "primary_naics", "source", "channel_id", "standard_score",
                   "augmented_score", "augmented_confidence", "segment_rank", "icp_fit_score", "urgent_flags",
                   "action_flags", "has_research_doc"],
    "penetration": ["company_id", "served_buildings", "total_buildings_estimate", "penetration_rate"],
    "contact_summary": ["company_id", "contact_count", "last_contact_date", "contact_names", "contact_emails"],
    "company_research": ["company_id", "company_name", "had_web_research", "icp_fit_score", "confidence",
                         "reasoning", "recommendation"],
    "churn_predictions": ["company_id", "churn_probability", "risk_tier", "prediction_date"],
    "naics_metrics": ["naics_code", "attractiveness_score", "icp_fit_score", "profitability_score",
                      "market_size_score", "market_size_count", "churn_health_score", "ticket_health_score"],
    "crm_companies": ["domain"],
    "crm_interactions": ["engagement_id", "company_id", "engagement_type", "timestamp", "body"],
    "entity_resolution_log": ["hubspot_id", "hubspot_type", "dataaxle_id", "confidence_score"],
}

# Structured shapes of the JSON text columns.
ARRAY_OF_STRINGS = T.ArrayType(S)
RESEARCH_SUMMARY = T.StructType([
    T.StructField("news_findings", T.StructType([
        T.StructField("found_recent_news", B), T.StructField("headline", S), T.StructField("date", S),
        T.StructField("signal_type", S), T.StructField("summary", S)])),
    T.StructField("jobs_findings", T.StructType([
        T.StructField("found_ops_roles", B), T.StructField("hiring_scale", S),
        T.StructField("role_examples", T.ArrayType(S)), T.StructField("summary", S)])),
    T.StructField("corporate_ops_findings", T.StructType([
        T.StructField("has_vendor_portal", B), T.StructField("has_facilities_dept", B),
        T.StructField("centralized_operations", B), T.StructField("professionalism_level", S),
        T.StructField("summary", S)])),
])
PRIMARY_CONTACT = T.StructType([
    T.StructField("first_name", S), T.StructField("last_name", S), T.StructField("job_titles", T.ArrayType(S)),
    T.StructField("management_level", S), T.StructField("gender", S)])

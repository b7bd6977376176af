"""Export (J7, P11-P13, D3, D4, D6, A11, S17): merged rows for a set of
companies and the four result tables (rankings, reasoning, research
details, manifest). The spreadsheet of the original becomes one folder per
table (see ``sources.writers.write_export``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsoncols import expand_json_array, expand_research_summary
from ..functions.text import truncate_reasoning
from ..operators.filters import researched_only, select_ids
from ..operators.ranking import first_per_key
from ..session import written
from ..sources.scan_order import scan_order_of

RESEARCH_COLS = ["company_id", "had_web_research", "confidence", "reasoning", "hot_lead_signals", "concerns",
                 "recommendation", "timing", "research_summary"]
RAW_COLS = ["company_id", "website", "building_count_estimate", "growing_business_code", "contacts_count"]

# FIXED VALUES: export column order and display names
SHEET1_ORDER = [
    "company_id", "company_name", "primary_naics", "naics_4digit", "city", "state",
    "scoring_path", "is_customer", "in_hubspot",
    "final_score", "naics_attractiveness_score", "company_opportunity_score",
    "icp_fit_score", "buildings_score", "revenue_score", "growth_score", "contact_score",
    "expansion_score", "churn_score", "profitability_score", "tickets_score",
    "location_employee_size", "sales_volume", "building_count_estimate",
    "growing_business_code", "contacts_count", "website",
    "recommendation", "confidence", "icp_reasoning_short",
    "signals_count", "concerns_count", "timing",
    "rank", "scoring_reason", "has_research_doc", "research_recency",
]
SHEET1_NAMES = {
    "company_id": "Company ID", "company_name": "Company Name", "primary_naics": "NAICS Code (8-digit)",
    "naics_4digit": "NAICS (4-digit)", "city": "City", "state": "State", "scoring_path": "Scoring Path",
    "is_customer": "Is Customer", "in_hubspot": "In HubSpot", "final_score": "Final Score",
    "naics_attractiveness_score": "NAICS Score", "company_opportunity_score": "Company Score",
    "icp_fit_score": "ICP Fit Score", "buildings_score": "Buildings Score", "revenue_score": "Revenue Score",
    "growth_score": "Employee Score", "contact_score": "Contact Score", "expansion_score": "Expansion Score",
    "churn_score": "Churn Score", "profitability_score": "Profitability Score", "tickets_score": "Tickets Score",
    "location_employee_size": "Employees", "sales_volume": "Revenue ($)",
    "building_count_estimate": "Building Count Estimate", "growing_business_code": "Growth Code",
    "contacts_count": "Contact Count", "website": "Website", "recommendation": "ICP Recommendation",
    "confidence": "ICP Confidence", "icp_reasoning_short": "ICP Reasoning (Truncated)",
    "signals_count": "Hot Lead Signals (Count)", "concerns_count": "Concerns (Count)",
    "timing": "Timing Assessment", "rank": "Segment Rank", "scoring_reason": "Scoring Reason",
    "has_research_doc": "Has Research", "research_recency": "Research Recency",
}
SHEET2_ORDER = ["company_id", "company_name", "icp_fit_score", "recommendation", "confidence", "reasoning",
                "hot_lead_signals_expanded", "concerns_expanded", "timing"]
SHEET2_NAMES = {
    "company_id": "Company ID", "company_name": "Company Name", "icp_fit_score": "ICP Fit Score",
    "recommendation": "Recommendation", "confidence": "Confidence", "reasoning": "ICP Fit Reasoning (Full)",
    "hot_lead_signals_expanded": "Hot Lead Signals", "concerns_expanded": "Concerns", "timing": "Timing Assessment",
}
SHEET3_NAMES = {
    "company_id": "Company ID", "company_name": "Company Name", "had_web_research": "Had Web Research",
    "news_found": "News Found", "news_headline": "News Headline", "news_date": "News Date",
    "news_signal_type": "News Signal Type", "news_summary": "News Summary",
    "jobs_found_ops_roles": "Found Ops Roles", "jobs_hiring_scale": "Hiring Scale",
    "jobs_role_examples": "Job Role Examples", "corp_has_vendor_portal": "Has Vendor Portal",
    "corp_has_facilities_dept": "Has Facilities Dept", "corp_centralized_operations": "Centralized Operations",
    "corp_professionalism_level": "Professionalism Level", "corp_summary": "Corporate Ops Summary",
}
MANIFEST_KEYS = [("Filter: Customer Status", "customer_status", "All"), ("Filter: NAICS Code", "naics_code", "All"),
                 ("Filter: HubSpot Status", "hubspot_status", "All"), ("Filter: State", "state", "All"),
                 ("Filter: Score Range (Min)", "score_min", 0), ("Filter: Score Range (Max)", "score_max", 100)]


def _suffix_join(left: DataFrame, right: DataFrame, suffix: str) -> DataFrame:
    """Left join on company_id; right columns that collide get ``suffix``."""
    ren = right.select(*[F.col(c).alias(c if c == "company_id" or c not in left.columns else c + suffix)
                         for c in right.columns])
    return left.join(ren, on="company_id", how="left")


def merge_export_data(scored: DataFrame, research: DataFrame | None, companies: DataFrame,
                      company_ids: DataFrame, crm_flags: DataFrame | None,
                      order_col: str | None = None) -> DataFrame:
    """Selected ids (semi join, P12) -> CRM flag (missing -> False) ->
    research columns that exist (suffix '_research') -> raw company fields,
    first row per id (suffix '_raw') -> one row per company. First rows go by
    the scan order that the readers carry, of ``scored`` else by rank."""
    # one row per id up front (keep the first by rank); every other side is
    # reduced to one row per id too, so the wide merged rows (with whole
    # research texts) never need a de-duplicating aggregation of their own
    rank_col = "rank" if "rank" in scored.columns else ("segment_rank" if "segment_rank" in scored.columns else None)
    sel = select_ids(scored, company_ids)
    first = scan_order_of(scored)
    m = first_per_key(sel, ["company_id"], [first] if first else [rank_col] if rank_col else [],
                      [c for c in sel.columns if c not in ("company_id", first)])
    if crm_flags is not None:
        m = m.drop("in_hubspot").join(crm_flags.select("company_id", "in_hubspot"), on="company_id", how="left")
        m = m.withColumn("in_hubspot", F.coalesce(F.col("in_hubspot"), F.lit(False)))
    else:
        m = m.withColumn("in_hubspot", F.lit(False))
    if research is not None:
        cols = [c for c in RESEARCH_COLS if c in research.columns]
        vals = [c for c in cols if c != "company_id"]
        first = scan_order_of(research)
        r = first_per_key(research.select(*cols, *([first] if first else [])), ["company_id"], [first] if first else [],
                          value_cols=vals) if vals else None
        if r is not None:
            m = _suffix_join(m, r, "_research")
    raw = [c for c in RAW_COLS if c in companies.columns]
    order_col = scan_order_of(companies, order_col)
    comp = first_per_key(companies.select(*raw, *([order_col] if order_col else [])), ["company_id"], [order_col] if order_col else [],
                         value_cols=[c for c in raw if c != "company_id"])
    return _suffix_join(m, comp, "_raw")


def _json_pair(df: DataFrame, src: str, count_col: str, text_col: str) -> DataFrame:
    if src in df.columns:
        n, t = expand_json_array(F.col(src))
        return df.withColumn(count_col, n).withColumn(text_col, t)
    return df.withColumn(count_col, F.lit(0)).withColumn(text_col, F.lit(""))


def sheet_rankings(merged: DataFrame) -> DataFrame:
    """Company rankings table: JSON counts, truncated reasoning (D6),
    existing columns in fixed order, display names (P13)."""
    d = _json_pair(merged, "hot_lead_signals", "signals_count", "signals_text")
    d = _json_pair(d, "concerns", "concerns_count", "concerns_text")
    src = "reasoning" if "reasoning" in d.columns else ("icp_fit_reasoning" if "icp_fit_reasoning" in d.columns else None)
    d = d.withColumn("icp_reasoning_short", truncate_reasoning(F.col(src)) if src else F.lit(""))
    return d.select(*[F.col(c).alias(SHEET1_NAMES[c]) for c in SHEET1_ORDER if c in d.columns])


def sheet_reasoning(merged: DataFrame) -> DataFrame:
    """ICP reasoning table with the JSON arrays expanded."""
    d = _json_pair(merged, "hot_lead_signals", "signals_count", "hot_lead_signals_expanded")
    d = _json_pair(d, "concerns", "concerns_count", "concerns_expanded")
    if "reasoning" not in d.columns and "icp_fit_reasoning" in d.columns:
        d = d.withColumn("reasoning", F.col("icp_fit_reasoning"))
    return d.select(*[F.col(c).alias(SHEET2_NAMES[c]) for c in SHEET2_ORDER if c in d.columns])


def sheet_research(merged: DataFrame) -> DataFrame | None:
    """Web research table: researched rows only (P11), summary JSON
    flattened (D4) next to the base columns in one projection (U3);
    ``None`` when there is no research column."""
    if "had_web_research" not in merged.columns:
        return None
    d = researched_only(merged)
    base = [F.col("company_id"), F.col("company_name"), F.col("had_web_research")]
    extra = expand_research_summary(F.col("research_summary")) if "research_summary" in d.columns else []
    out = d.select(*base, *extra)
    return out.select(*[F.col(c).alias(SHEET3_NAMES[c]) for c in out.columns])


def manifest_rows(n: int, filter_info: Mapping | None, exported_at: str) -> list[tuple[str, str]]:
    """The (Property, Value) entries of an export of ``n`` companies."""
    info = dict(filter_info or {})
    return [("Export Timestamp", exported_at), ("Total Companies Exported", str(n)),
            *((label, str(info.get(key, default))) for label, key, default in MANIFEST_KEYS)]


class Export:
    """One export (J7, A11, S17): the merged rows are written once, and what the manifest and the tables need to know
    about them is observed on the way. Every table reads that one copy."""

    def __init__(self, merged: DataFrame):
        researched = F.col("had_web_research") == F.lit(True) if "had_web_research" in merged.columns else F.lit(False)
        self.merged, seen = written(merged, "export", {"n_rows": F.count(F.lit(1)), "n_researched": F.count_if(researched)})
        self.rows, self.researched = seen["n_rows"], seen["n_researched"]

    def rankings(self) -> DataFrame:
        return sheet_rankings(self.merged)

    def reasoning(self) -> DataFrame:
        return sheet_reasoning(self.merged)

    def research(self) -> DataFrame | None:
        """None if no company was researched: the table is left out then."""
        return sheet_research(self.merged) if self.researched else None

    def manifest(self, filter_info: Mapping | None, exported_at: str) -> DataFrame:
        return self.merged.sparkSession.createDataFrame(manifest_rows(self.rows, filter_info, exported_at), "Property string, Value string")


def export_manifest(merged: DataFrame, filter_info: Mapping | None, exported_at: str) -> DataFrame:
    """A11 for rows that are not written: (Property, Value) entries, the count from one aggregation."""
    n = merged.agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(label).alias("Property"), (F.col("n").cast("string") if label == "Total Companies Exported" else F.lit(value)).alias("Value"))
               for label, value in manifest_rows(0, filter_info, exported_at)]
    return n.select(F.explode(F.array(*entries)).alias("e")).select("e.Property", "e.Value")

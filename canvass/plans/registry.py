"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs one or more package operators over carrier tables derived
from the whole test tables (see ``carriers.py``). The matching DuckDB SQL is
in ``oracle_sql.py`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates, filters, geo, joins, quality, scoring
from . import carriers as cr
from . import export, industry, ranked, scans
from ..functions import formatting as fmt

# the page filter used by the registered view queries
VIEW_FILTER = filters.PageFilter(scoring_path="prospect", score_min=30.0, score_max=90.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("ranked_companies")
def q_ranked_companies(spark: SparkSession, sf: str) -> DataFrame:
    """S3 / L1 stage 1: J2 -> P1 -> W1 -> J3."""
    return ranked.prepare_scored(cr.scored(spark, sf), cr.companies(spark, sf))


def _filtered(spark, sf):
    return ranked.filter_scored(cr.scored(spark, sf), cr.companies(spark, sf))


def _rankings(spark, sf):
    return industry.industry_rankings(spark, _filtered(spark, sf), cr.naics_metrics(spark, sf))


@query("industry_rankings")
def q_industry_rankings(spark, sf):
    """L2: A1 counts -> J9 -> A8/D7 descriptions -> O1."""
    return _rankings(spark, sf)


@query("industry_summary")
def q_industry_summary(spark, sf):
    """A2 over the industry rankings."""
    return aggregates.ranking_summary(_rankings(spark, sf))


@query("industry_search_code")
def q_industry_search_code(spark, sf):
    """All-digit query -> code prefix."""
    return filters.search_industries(_rankings(spark, sf), " 62 ")


@query("industry_search_text")
def q_industry_search_text(spark, sf):
    """Text query expanded with synonyms, literal, case-insensitive."""
    return filters.search_industries(_rankings(spark, sf), "Construction")


@query("facet_values")
def q_facet_values(spark, sf):
    """Distinct facet values with counts."""
    return aggregates.facet_values(_filtered(spark, sf), ["scoring_path", "naics_4digit", "state", "primary_naics"])


@query("ranked_view")
def q_ranked_view(spark, sf):
    """P2 -> W2 -> O4 over the prepared scored table."""
    return ranked.ranked_view(ranked.prepare_scored(cr.scored(spark, sf), cr.companies(spark, sf)), VIEW_FILTER)


@query("filtered_summary")
def q_filtered_summary(spark, sf):
    """A3 (average shown at 4 decimals)."""
    s = aggregates.filtered_summary(_filtered(spark, sf), VIEW_FILTER)
    return s.withColumn("avg_score", F.round("avg_score", 4))


def _valid_buildings(spark, sf):
    return joins.drop_orphans(cr.buildings(spark, sf), cr.companies(spark, sf))


@query("gate_completeness")
def q_gate_completeness(spark, sf):
    """A13 on the filtered scored table."""
    return quality.field_completeness(_filtered(spark, sf))


@query("gate_duplicates")
def q_gate_duplicates(spark, sf):
    """A10 on scored company ids and building ids."""
    return quality.duplicates_gate(_filtered(spark, sf), "company_id", "scored.company_id").unionByName(
        quality.duplicates_gate(_valid_buildings(spark, sf), "building_id", "buildings.building_id"))


@query("gate_join_integrity")
def q_gate_join_integrity(spark, sf):
    """J10 on the raw (unfiltered) scored and building tables: orphans show."""
    return quality.join_integrity_gate(cr.scored(spark, sf), cr.companies(spark, sf), cr.buildings(spark, sf))


@query("gate_coverage")
def q_gate_coverage(spark, sf):
    """A15 + A16."""
    return quality.coordinate_coverage_gate(_valid_buildings(spark, sf)).unionByName(
        quality.research_coverage_gate(_filtered(spark, sf)))


def _naics_weights(spark):
    from .. import config
    return spark.createDataFrame([(k, float(v)) for k, v in config.NAICS_WEIGHTS.items()],
                                 "component string, weight double")


@query("startup_validation")
def q_startup_validation(spark, sf):
    """A18 gate report over the loaded tables (weights sum shown to 9 places)."""
    rep = quality.gate_report(spark, _filtered(spark, sf), cr.companies(spark, sf), _valid_buildings(spark, sf),
                              er_log=_er_log(spark, sf), weights=_naics_weights(spark))
    return rep.withColumn("value", F.when(F.col("gate") == "scoring_weights", F.round("value", 9))
                          .otherwise(F.col("value")))


@query("rank_contiguity")
def q_rank_contiguity(spark, sf):
    """W3 on the ranks as delivered (before the re-rank)."""
    return quality.rank_contiguity_violations(_filtered(spark, sf))


@query("rank_order")
def q_rank_order(spark, sf):
    """W4 on the ranks as delivered."""
    return quality.rank_order_violations(_filtered(spark, sf))


@query("valid_buildings")
def q_valid_buildings(spark, sf):
    """S2 + J1: buildings of registered companies."""
    return _valid_buildings(spark, sf)


@query("orphan_report")
def q_orphan_report(spark, sf):
    """J1/J2 report side: orphan rows and keys per table."""
    comp = cr.companies(spark, sf)
    return joins.orphan_report(cr.scored(spark, sf), comp, "scored").unionByName(
        joins.orphan_report(cr.buildings(spark, sf), comp, "buildings"))


def _prepared(spark, sf):
    return ranked.prepare_scored(cr.scored(spark, sf), cr.companies(spark, sf))


def _penetration(spark, sf):
    comp = cr.companies(spark, sf)
    est = comp.select("company_id", F.col("building_count_estimate").alias("total_buildings_estimate"))
    served = (_valid_buildings(spark, sf).where(F.col("is_served") == F.lit(True))
              .groupBy("company_id").agg(F.count(F.lit(1)).alias("served_buildings")))
    return joins.estimate_penetration(est, served)


@query("raw_field_enrichment")
def q_raw_field_enrichment(spark, sf):
    """Raw company fields, first row per id."""
    return joins.enrich_raw_fields(_filtered(spark, sf), cr.companies(spark, sf))


@query("crm_presence")
def q_crm_presence(spark, sf):
    """J5 with D1/D2 domain cleaning (strict: CRM paths kept)."""
    comp = cr.companies(spark, sf)
    return joins.flag_crm_presence(_filtered(spark, sf), comp, cr.crm_companies(spark, sf)) \
        .select("company_id", "in_hubspot")


@query("penetration_estimates")
def q_penetration_estimates(spark, sf):
    """A5: estimate-level penetration per company."""
    return _penetration(spark, sf)


@query("building_penetration")
def q_building_penetration(spark, sf):
    """A4: building-level penetration per company."""
    return joins.building_penetration(cr.companies(spark, sf), _valid_buildings(spark, sf))


@query("penetration_lookup")
def q_penetration_lookup(spark, sf):
    """Rate per scored company, shown as '12.5%' or '—'."""
    j = joins.penetration_lookup(_filtered(spark, sf).select("company_id"), _penetration(spark, sf))
    return j.withColumn("penetration_display", fmt.percent_or_dash(F.col("penetration_rate")))


@query("ranked_table")
def q_ranked_table(spark, sf):
    """L1 end to end: prepared -> J4/J5 -> P2 -> W2 -> D17 projection."""
    e = ranked.enrich(_prepared(spark, sf), cr.companies(spark, sf), cr.crm_companies(spark, sf))
    return ranked.display_table(ranked.ranked_view(e, filters.PageFilter()))


EXPORT_TIMESTAMP = "2026-01-01 00:00:00"   # manifest stamp of the registered export (a parameter)
VIEW_FILTER_INFO = {"customer_status": "prospect", "score_min": 30.0, "score_max": 90.0}


def _merged(spark, sf):
    comp = cr.companies(spark, sf)
    prepared = _prepared(spark, sf)
    ids = filters.apply_page_filter(prepared, VIEW_FILTER).select("company_id")
    flags = joins.flag_crm_presence(comp.select("company_id"), comp, cr.crm_companies(spark, sf))
    return export.merge_export_data(prepared, cr.company_research(spark, sf), comp, ids, flags)


@cr._memo
def _export(spark, sf):
    """The registered export: one merged table, written once, from which its four tables are read."""
    return export.Export(_merged(spark, sf))


@query("export_rankings")
def q_export_rankings(spark, sf):
    """J7 -> D3 counts -> D6 -> P13: the company rankings export table."""
    return _export(spark, sf).rankings()


@query("export_reasoning")
def q_export_reasoning(spark, sf):
    """J7 -> D3 expanded arrays: the reasoning export table."""
    return _export(spark, sf).reasoning()


@query("export_research")
def q_export_research(spark, sf):
    """J7 -> P11 -> D4: the web research export table."""
    return export.sheet_research(_export(spark, sf).merged)


@query("export_manifest")
def q_export_manifest(spark, sf):
    """A11 (S17): export manifest, the count observed while the merged rows were written."""
    return _export(spark, sf).manifest(VIEW_FILTER_INFO, EXPORT_TIMESTAMP)


@query("coordinate_validation")
def q_coordinate_validation(spark, sf):
    """Reason per building (null = valid)."""
    return geo.coordinate_reason(_valid_buildings(spark, sf)).select("building_id", "source", "coord_reason")


@query("exclusion_summary")
def q_exclusion_summary(spark, sf):
    """Excluded buildings, total and by source."""
    return geo.exclusion_summary(_valid_buildings(spark, sf))


def _hq(spark, sf):
    comp = cr.companies(spark, sf).select("company_id", "hq_latitude", "hq_longitude")
    return geo.hq_points(_filtered(spark, sf).join(comp, on="company_id", how="left"))


@query("map_statistics")
def q_map_statistics(spark, sf):
    """A7 over company HQ points."""
    return geo.map_statistics(_hq(spark, sf))


@query("marker_colors")
def q_marker_colors(spark, sf):
    """D10 for every valid HQ point."""
    return geo.marker_colors(_hq(spark, sf))


MARKERS = ("WITH", "THAT")   # extra markers that occur in the test documents


@query("document_flags")
def q_document_flags(spark, sf):
    """D20 + D22 over whole documents: words, URGENT / ACTION counts (and
    two markers that occur in the test texts)."""
    d = cr.research_documents(spark, sf)
    doc = F.col("research_document")
    return d.select("company_id", *tx.document_summary(doc),
                    *[tx.count_marker(doc, m).alias(f"{m.lower()}_flags") for m in MARKERS],
                    tx.company_name_or_unknown(F.col("company_name")).alias("company_name"))


@query("document_display")
def q_document_display(spark, sf):
    """D21 + D23: highlighted document, cut to 5,000 words with a notice."""
    d = cr.research_documents(spark, sf)
    text, cut = tx.truncate_document(tx.format_research_document(F.col("research_document")))
    return d.select("company_id", text.alias("display_text"), cut.alias("was_truncated"))


@query("document_validity")
def q_document_validity(spark, sf):
    """Validity reason per research document."""
    d = cr.research_documents(spark, sf)
    reason = tx.document_validity(F.col("research_document"), F.col("status"), F.col("document_stats.word_count"))
    return d.select("company_id", reason.isNull().alias("is_valid"), reason.alias("reason"))


@query("flag_count_mismatch")
def q_flag_count_mismatch(spark, sf):
    """Stored URGENT / ACTION counts that differ from the text."""
    d = cr.research_documents(spark, sf)
    doc = F.col("research_document")
    return (d.select("company_id", "urgent_flags", "action_flags",
                     tx.count_marker(doc, "URGENT").alias("urgent_in_text"),
                     tx.count_marker(doc, "ACTION").alias("action_in_text"))
             .where(tx.flags_differ(F.col("urgent_flags"), F.col("urgent_in_text"))
                    | tx.flags_differ(F.col("action_flags"), F.col("action_in_text"))))


#: Cap of the log-scaled expansion opportunity in dollars (a parameter, the original states none).
EXPANSION_CAP = 5_000_000.0


def _round4(c):
    return F.round(c, 4)


@query("company_scoring")
def q_company_scoring(spark, sf):
    """Company opportunity by the prospect or the customer path, every component from data,
    and the final score (missing components neutral)."""
    comp = cr.companies(spark, sf).select("company_id", "building_count_estimate", "sales_volume", "employees",
                                          "contacts_count")
    per_company = cr.building_revenue(spark, sf).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("served"), F.sum("revenue_cents").alias("served_cents"))
    s = (_filtered(spark, sf).join(comp, on="company_id", how="left")
         .join(per_company, on="company_id", how="left")
         .join(cr.churn_predictions(spark, sf).select("company_id", "churn_probability", "ticket_health"), on="company_id", how="left")
         .join(cr.company_margins(spark, sf), on="company_id", how="left"))
    b = scoring.buildings_score(F.col("building_count_estimate"))
    r = scoring.revenue_score(F.col("sales_volume"))
    e = scoring.employees_score(F.col("employees"))
    c = scoring.contact_score(F.col("contacts_count"))
    x = scoring.expansion_score(F.col("building_count_estimate"), F.col("served"),
                                F.col("served_cents") / F.col("served") / F.lit(100.0), EXPANSION_CAP)
    churn = F.lit(100.0) - F.lit(100.0) * F.col("churn_probability")
    profit = scoring.profitability_score(F.col("margin"))
    prospect = scoring.prospect_opportunity(F.col("icp_fit_score"), b, r, e, c)
    customer = scoring.customer_opportunity(x, churn, profit, F.col("ticket_health"))
    company = F.when(F.col("is_customer") == F.lit(True), customer).otherwise(prospect)
    final = scoring.final_score(F.col("is_customer"), F.col("naics_attractiveness_score"), company)
    return s.select("company_id", "scoring_path", _round4(b).alias("buildings_score"), _round4(r).alias("revenue_score"),
                    _round4(e).alias("employee_score"), c.alias("contact_score"), _round4(x).alias("expansion_score"),
                    _round4(churn).alias("churn_score"), _round4(profit).alias("profitability_score"),
                    _round4(F.col("ticket_health")).alias("tickets_score"),
                    _round4(company).alias("company_opportunity_score"), _round4(final).alias("final_score"))


@query("industry_revenue_medians")
def q_industry_revenue_medians(spark, sf):
    """exact median revenue of a served building per industry, by counting digits."""
    from ..operators import medians
    return medians.group_medians(cr.building_revenue(spark, sf), ["naics_4digit"], "revenue_cents", "median_cents")


@query("naics_metrics")
def q_naics_metrics(spark, sf):
    """industry metrics and attractiveness from all seven components."""
    return cr.naics_metrics(spark, sf)


@query("industry_caps")
def q_industry_caps(spark, sf):
    """P17 + W6: target industries, multi-location companies, at most
    ``max_companies`` per industry by size (desc) then id."""
    comp = cr.companies(spark, sf).select("company_id", "building_count_estimate")
    s = _filtered(spark, sf).join(comp, on="company_id", how="left")
    t = scoring.targets_table(spark)
    kept = scoring.target_industries(s.withColumn("branch_count", F.col("building_count_estimate") - 1), t,
                                     "naics_4digit", "branch_count")
    capped = scoring.cap_industries(kept, t, [F.col("building_count_estimate").desc_nulls_last(),
                                              F.col("company_id").asc()])
    return capped.select("company_id", "naics_4digit", "max_companies", "building_count_estimate")


@query("channel_assignment")
def q_channel_assignment(spark, sf):
    """J13 + F11: longest NAICS prefix -> channel (default 'general'), with
    the channel's weight overrides."""
    ch = scoring.channel_table(spark)
    out = scoring.assign_channel(cr.scored(spark, sf).select("company_id", "primary_naics"), ch,
                                 prefix_lengths=scoring.channel_prefix_lengths())
    w = scoring.weights_frame(spark).groupBy("channel_id").pivot(
        "component", ["hygiene_relevance", "geographic_fit", "decision_maker_clarity"]).agg(F.first("weight"))
    return out.join(joins.small_side(w), on="channel_id", how="left")


@query("sqft_filter")
def q_sqft_filter(spark, sf):
    """P16 + J14: buildings of 5,000 sq ft and more (codes 4-8)."""
    kept = scoring.apply_sqft_rule(_valid_buildings(spark, sf), scoring.sqft_table(spark))
    return kept.select("building_id", "square_footage_code", "sqft_range", "sqft_min", "sqft_max", "sqft_unknown")


@query("research_eligibility")
def q_research_eligibility(spark, sf):
    """5+ locations and ($10M+ revenue or 100+ employees)."""
    c = cr.companies(spark, sf)
    return c.select("company_id", scoring.research_eligible(F.col("building_count_estimate"), F.col("sales_volume"),
                                                            F.col("employees")).alias("eligible"))


def _contact_summary(spark, sf):
    return aggregates.contact_summary(cr.contact_events(spark, sf))


@query("contact_summary")
def q_contact_summary(spark, sf):
    """Contacts per company, last date, names and e-mails."""
    return _contact_summary(spark, sf)


@query("interaction_counts")
def q_interaction_counts(spark, sf):
    """S16 + A21: engagements per company and type."""
    return aggregates.interaction_counts(cr.crm_interactions(spark, sf))


@query("naics_risk_metrics")
def q_naics_risk_metrics(spark, sf):
    """Churn and ticket health averaged per industry (6 decimals)."""
    j = _filtered(spark, sf).join(cr.churn_predictions(spark, sf), on="company_id", how="inner")
    r = aggregates.risk_metrics_by_industry(j, "naics_4digit", "churn_probability", "ticket_health")
    return r.withColumn("avg_churn", F.round("avg_churn", 6)).withColumn("avg_ticket", F.round("avg_ticket", 6))


@query("company_profile")
def q_company_profile(spark, sf):
    """J8 (+ P10, A4, D5, D14, D15, D27, P18) for every customer company."""
    from . import profile
    prepared = _prepared(spark, sf)
    ids = prepared.where(F.col("scoring_path") == "customer_expansion").select("company_id")
    return profile.company_profile(cr.companies(spark, sf), prepared, _valid_buildings(spark, sf), ids,
                                   contacts=_contact_summary(spark, sf), churn=cr.churn_predictions(spark, sf),
                                   research=cr.company_research(spark, sf))


@query("score_formatting")
def q_score_formatting(spark, sf):
    """Tiers, bands and score texts."""
    p = _filtered(spark, sf)
    fs, cs = F.col("final_score"), F.col("company_opportunity_score")
    return p.select("company_id",
                    fmt.tier_80_60(F.col("naics_attractiveness_score")).alias("industry_color"),
                    fmt.tier_70_40(fs).alias("badge_color"), fmt.score_band(fs).alias("export_band"),
                    fmt.format_score(fs).alias("score_text"), fmt.format_percentage(cs).alias("company_pct"),
                    fmt.format_confidence(cs / 100.0).alias("confidence_text"),
                    fmt.format_score_with_confidence(fs, cs / 100.0).alias("score_with_confidence"),
                    fmt.format_delta(fs, cs).alias("score_delta"),
                    fmt.format_large_number(fs * 1000.0).alias("large_number"),
                    fmt.format_icp_fit_score(F.col("icp_fit_score") / 100.0, F.lit("calculated")).alias("icp_text"))


@query("buildings_display")
def q_buildings_display(spark, sf):
    """Building status and square-feet text."""
    b = _valid_buildings(spark, sf)
    sq = F.coalesce(F.col("square_footage_code"), F.lit(None).cast("string"))
    return b.select("building_id",
                    F.when(F.coalesce(F.col("is_served"), F.lit(False)), F.lit("✅ Served"))
                     .otherwise(F.lit("❌ Unserved")).alias("status"),
                    F.when(sq.isNull(), F.lit("N/A"))
                     .otherwise(F.format_number(fmt.as_number(sq).cast("long"), 0)).alias("square_feet"))


@query("building_filters")
def q_building_filters(spark, sf):
    """P3 + P4 + P5: served buildings from manual entry."""
    b = _valid_buildings(spark, sf)
    spec = filters.FilterSpec(source="manual", served="served")
    out = filters.filter_by_source(filters.filter_by_served_status(filters.apply_filters(b, spec), "served"), "manual")
    return out.select("building_id", "company_id", "source", "is_served")


@cr._memo
def _er_log(spark, sf):
    """The entity-resolution log, written once, with its match types observed on the way."""
    from ..operators import resolution
    return quality.ErLog(resolution.resolve(cr.crm_addresses(spark, sf), cr.registry_addresses(spark, sf)))


@query("entity_resolution")
def q_entity_resolution(spark, sf):
    """J11 exact + J12 fuzzy (exact prefix-filtered candidates): ER log."""
    return _er_log(spark, sf).rows


@query("er_match_summary")
def q_er_match_summary(spark, sf):
    """ER log by match type: rows and confidence range."""
    return _er_log(spark, sf).rows.groupBy("match_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence_score").alias("min_confidence"),
        F.max("confidence_score").alias("max_confidence"))


@query("er_gate")
def q_er_gate(spark, sf):
    """Unmatched share of the ER log (< 10 % passes), from the counts observed while it was written."""
    return _er_log(spark, sf).gate()


def _prepared_old(spark, sf):
    return ranked.prepare_scored(cr.scored_old(spark, sf), cr.companies(spark, sf))


@query("ranked_companies_old")
def q_ranked_companies_old(spark, sf):
    """S3 on the old score format: J2 -> P1 -> W1 (augmented score,
    segment rank) -> J3."""
    return _prepared_old(spark, sf)


@query("old_format_display")
def q_old_format_display(spark, sf):
    """D18 (+ W2, J6, O6): old-format display rows with a global rank, by the numeric score."""
    from ..operators import ranking
    g = ranking.global_rank(_prepared_old(spark, sf), "augmented_score", "global_rank", "company_id")
    return fmt.old_format_display(g, _penetration(spark, sf))


@query("score_components")
def q_score_components(spark, sf):
    """Component scores in long form (x 100)."""
    return fmt.score_components_long(cr.company_research(spark, sf).select(
        "company_id", (F.col("icp_fit_score") / 100.0).alias("icp_fit_score")))


@query("document_summary")
def q_document_summary(spark, sf):
    """D22 over whole research documents."""
    d = cr.research_documents(spark, sf)
    return d.select("company_id", *tx.document_summary(F.col("research_document")))


@query("industry_sorted")
def q_industry_sorted(spark, sf):
    """O2: industries sorted by company count ascending (nulls last)."""
    return industry.sort_rankings(_rankings(spark, sf), "company_count", ascending=True)


CRM_VIEW_FILTER = filters.PageFilter(hubspot="In HubSpot", state="NATION_3", score_min=10.0, score_max=95.0)


@query("ranked_view_crm")
def q_ranked_view_crm(spark, sf):
    """P2 with the CRM-presence and state filters, after J4/J5 enrichment."""
    e = ranked.enrich(_prepared(spark, sf), cr.companies(spark, sf), cr.crm_companies(spark, sf))
    return ranked.ranked_view(e, CRM_VIEW_FILTER)


@query("latest_order_per_company")
def q_latest_order_per_company(spark, sf):
    """W5 / A12 with an explicit order: the last order of every company
    (date, then order key), by aggregation (no per-key window)."""
    from ..operators import ranking
    o = cr.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("company_id"),
                                             "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return ranking.last_per_key(o, ["company_id"], [F.col("o_orderdate").cast("date"), F.col("o_orderkey")],
                                ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("penetration_by_industry")
def q_penetration_by_industry(spark, sf):
    """A5 rolled up per 4-digit industry."""
    return joins.penetration_by_industry(_penetration(spark, sf), cr.companies(spark, sf))


@query("industry_search_multiword")
def q_industry_search_multiword(spark, sf):
    """P8 with a query that is part of a multi-word synonym key ('estate'
    -> the 'real estate' synonyms)."""
    return filters.search_industries(_rankings(spark, sf), "estate")


@query("segment_sorted")
def q_segment_sorted(spark, sf):
    """O3: companies by segment ascending, score descending (numeric)."""
    return ranked.sort_by_score_within_segment(_prepared(spark, sf)).select(
        "company_id", "primary_naics", "final_score", "rank")


@query("first_raw_fields")
def q_first_raw_fields(spark, sf):
    """J4 / A12 on repeated ids: the first row of each id in its file."""
    return joins.enrich_raw_fields(_filtered(spark, sf).select("company_id"), cr.company_register(spark, sf))


@query("last_penetration_rate")
def q_last_penetration_rate(spark, sf):
    """J6 on repeated ids: the last row of each id in its file."""
    return joins.penetration_lookup(_filtered(spark, sf).select("company_id"), cr.company_register(spark, sf))


@query("last_website_presence")
def q_last_website_presence(spark, sf):
    """J5 on repeated ids: the website of the last row decides."""
    return joins.flag_crm_presence(_filtered(spark, sf).select("company_id"), cr.company_register(spark, sf), cr.crm_companies(spark, sf))


@query("export_first_rows")
def q_export_first_rows(spark, sf):
    """J7 on repeated ids: first research row and first raw row of each company, suffixes for clashing names."""
    kept = _filtered(spark, sf).select("company_id", "company_name", "rank", "final_score").withColumn("reasoning", F.lit("own"))
    reg = cr.company_register(spark, sf)
    return export.merge_export_data(kept, reg, reg, kept.select("company_id"), None)


@query("company_lookup")
def q_company_lookup(spark, sf):
    """P9 for a set of ids (customers): the first row of each id in its file."""
    from . import profile
    ids = _filtered(spark, sf).where(F.col("is_customer")).select("company_id")
    return profile.first_rows(cr.company_register(spark, sf), ids, ["building_count_estimate", "website", "reasoning"])


for _name, _scan in {"scan_companies": scans.companies, "scan_buildings": scans.buildings, "scan_buildings_flags": scans.buildings_with_flags,
                     "scan_scored": scans.scored, "scan_scored_old": scans.scored_old, "scan_research": scans.research, "scan_churn": scans.churn,
                     "scan_crm": scans.crm, "scan_metrics": scans.metrics, "scan_codes": scans.codes, "scan_interactions": scans.interactions}.items():
    QUERIES[_name] = _scan


@query("scan_penetration")
def q_scan_penetration(spark, sf):
    """S4."""
    return scans.penetration(spark, sf, _penetration(spark, sf))


@query("scan_contacts")
def q_scan_contacts(spark, sf):
    """S5."""
    return scans.contacts(spark, sf, _contact_summary(spark, sf))


@query("scan_er_log")
def q_scan_er_log(spark, sf):
    """S13."""
    return scans.er_log(spark, sf, _er_log(spark, sf).rows)


@query("export_sink")
def q_export_sink(spark, sf):
    """The tables of the registered export, written and read back; the manifest comes last."""
    run = _export(spark, sf)
    return scans.sink(spark, sf, {"Company Rankings": run.rankings(), "ICP Detailed Reasoning": run.reasoning(),
                                  "Web Research Details": run.research(), "Export Metadata": run.manifest(VIEW_FILTER_INFO, EXPORT_TIMESTAMP)})


@query("contacts_display")
def q_contacts_display(spark, sf):
    """D16 (contacts)."""
    return fmt.contacts_display(_contact_summary(spark, sf))


@query("buildings_table")
def q_buildings_table(spark, sf):
    """D16 (buildings): the building table of the detail page, with cities of the companies."""
    b = _valid_buildings(spark, sf).join(cr.companies(spark, sf).select("company_id", "city", "state"), on="company_id", how="left")
    return fmt.buildings_display(b).withColumnsRenamed({"City": "city", "State": "state", "Status": "status", "Square Feet": "square_feet"})


def _config_document(spark, sf, name: str, doc: dict) -> str:
    """Path of a config document that an owner keeps beside the tables (written by Spark, once per session)."""
    import yaml
    text = spark.createDataFrame([(yaml.safe_dump(doc),)], "value string").coalesce(1)
    return scans.written_file(spark, sf, name, text, "text")


@query("config_channels")
def q_config_channels(spark, sf):
    """S15 + J13 + F11: channels, prefixes and weights from an owner's document, which differs from the built-in one."""
    from ..sources import config_files
    path = _config_document(spark, sf, "channels", cr.OWN_CHANNELS)
    channels, default = config_files.load_channels(path)
    out = scoring.assign_channel(cr.scored(spark, sf).select("company_id", "primary_naics"), scoring.channel_table(spark, channels),
                                 default_channel=default)
    w = scoring.channel_weights(spark, channels).groupBy("channel_id").pivot("component", ["geographic_fit", "hygiene_relevance"]).agg(F.first("weight"))
    return out.join(joins.small_side(w), on="channel_id", how="left")


@query("config_targets")
def q_config_targets(spark, sf):
    """S15 + P17 + W6: target industries and caps from an owner's document."""
    from ..sources import config_files
    doc = {"version": "1.0", "target_naics": [{"naics_code": c, "max_companies": n} for c, n in cr.OWN_TARGETS]}
    t = scoring.targets_table(spark, config_files.load_naics_targets(_config_document(spark, sf, "naics_target", doc)))
    s = _filtered(spark, sf).select("company_id", "naics_4digit", "final_score")
    return scoring.cap_industries(s, t, [F.col("final_score").desc_nulls_last(), F.col("company_id").asc()])


@query("config_sqft")
def q_config_sqft(spark, sf):
    """S15 + J14 + P16: square-footage codes from an owner's document; headquarters are always kept."""
    from ..sources import config_files
    doc = {"version": "1.0", "code_mappings": {c: {"range": r, "range_sqft_min": lo, "range_sqft_max": hi, "include": inc}
                                               for c, r, lo, hi, inc in cr.OWN_SQFT}}
    codes = scoring.sqft_table(spark, config_files.load_sqft_codes(_config_document(spark, sf, "sqft_codes", doc)))
    b = cr.buildings(spark, sf).withColumn("place_type", F.when(F.col("source") == "manual", F.lit("headquarters")))
    return scoring.apply_sqft_rule(b, codes, "place_type").select("building_id", "square_footage_code", "sqft_range", "sqft_unknown")


@query("six_digit_targets")
def q_six_digit_targets(spark, sf):
    """Companies of the six-digit target codes with more than one location. Carrier codes name sectors, so the
    codes are taken from an owner's document."""
    from ..sources import config_files
    path = _config_document(spark, sf, "naics_config", {"version": "1.0", "target_codes": cr.OWN_SIX_DIGIT})
    comp = cr.companies(spark, sf).withColumn("branch_count", F.col("building_count_estimate") - 1)
    return scoring.six_digit_targets(comp, config_files.load_six_digit_targets(path), "primary_naics", "branch_count").select("company_id", "primary_naics")


@query("contact_lists")
def q_contact_lists(spark, sf):
    """Names and e-mails of each company in bounded texts."""
    return aggregates.contact_lists(cr.contact_events(spark, sf), chunk=3)


@query("json_objects")
def q_json_objects(spark, sf):
    """D3 on JSON objects with nested values: shown as the original shows them."""
    from ..functions.jsoncols import expand_json_array
    n, text = expand_json_array(F.col("concerns"))
    return cr.object_concerns(spark, sf).select("company_id", n.alias("n_items"), text.alias("items"))

"""L1 ranked companies: one lazy plan from scan to ranked view.

scored -> J2 (drop orphans) -> P1 (exclusions) -> W1 (contiguous re-rank per
segment) -> J3 (building count) -> enrichment (J4, J5, J6) -> P2 filters ->
W2 global rank -> O4 order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..operators import filters, joins, ranking
from ..sources.readers import detect_score_format


def score_columns(df: DataFrame) -> tuple[str, str]:
    """(score, rank) column names of either score format."""
    if detect_score_format(df) == "new":
        return "final_score", "rank"
    return "augmented_score", "segment_rank"


def filter_scored(scored: DataFrame, companies: DataFrame, exclusion_codes: list[str] | None = None) -> DataFrame:
    """J2 -> P1 -> drop null segments (the rows W1 drops, H4)."""
    valid = joins.drop_orphans(scored, companies)
    kept = filters.apply_industry_exclusions(valid, exclusion_codes)
    return kept.filter(F.col("primary_naics").isNotNull())


def prepare_scored(scored: DataFrame, companies: DataFrame, exclusion_codes: list[str] | None = None,
                   strategy: str = "distributed") -> DataFrame:
    """S3 plan body: J2 -> P1 -> W1 -> J3 (one plan; the re-rank cuts lineage
    once, see ``ranking.contiguous_rank``)."""
    score_col, rank_col = score_columns(scored)
    kept = filter_scored(scored, companies, exclusion_codes)
    reranked = ranking.rank_within_segments(kept, "primary_naics", score_col, rank_col, "company_id", strategy)
    return joins.merge_building_count(reranked, companies)


def ranked_view(prepared: DataFrame, spec: filters.PageFilter | None = None,
                strategy: str = "distributed") -> DataFrame:
    """P2 + O4 + W2 + D17 numeric part: filtered rows with a global rank."""
    view = filters.apply_page_filter(prepared, spec or filters.PageFilter())
    ranked = ranking.global_rank(view, "final_score", "global_rank", "company_id", strategy)
    return ranked.orderBy(F.col("global_rank"))


def enrich(prepared: DataFrame, companies: DataFrame, crm: DataFrame | None,
           penetration: DataFrame | None = None) -> DataFrame:
    """L1 stage 2: J4 raw fields, J5 CRM flag (no CRM data -> all False),
    J6 penetration rate."""
    e = joins.enrich_raw_fields(prepared, companies)
    if crm is None:
        e = e.withColumn("in_hubspot", F.lit(False))
    else:
        e = joins.flag_crm_presence(e, companies, crm)
    if penetration is not None:
        e = joins.penetration_lookup(e, penetration)
    return e


def display_table(view: DataFrame) -> DataFrame:
    """The ranked table's display projection (numeric scores rounded to
    one decimal stay numeric, so O6 sorting stays numeric; absent optional
    columns show 0 / '—')."""
    cols = set(view.columns)

    def opt(name):
        return F.col(name) if name in cols else F.lit(None)

    return view.select(
        "company_id",
        F.col("global_rank").alias("rank"),
        F.col("company_name").alias("company"),
        F.col("scoring_path").alias("path"),
        fmt.code_text(F.col("naics_4digit")).alias("naics"),
        F.bround("final_score", 1).alias("final_score"),
        F.bround("company_opportunity_score", 1).alias("company_score"),
        fmt.location(opt("city"), opt("state")).alias("location"),
        fmt.check_mark(F.col("in_hubspot")).alias("in_hubspot"),
        fmt.icp_display(opt("icp_fit_score")).alias("icp_fit"),
        fmt.int_or_zero(opt("building_count_estimate")).alias("buildings"),
        (fmt.growth_label(F.col("growing_business_code")) if "growing_business_code" in cols
         else F.lit(fmt.DASH)).alias("growth"),
        fmt.int_or_zero(opt("contacts_count")).alias("contacts"),
        F.bround("naics_attractiveness_score", 1).alias("naics_score"),
        fmt.int_or_zero(opt("location_employee_size")).alias("employees"),
        fmt.revenue_millions(opt("sales_volume")).alias("revenue_m"))


def sort_by_score_within_segment(df: DataFrame) -> DataFrame:
    """O3: segment ascending, score descending (numeric, nulls last)."""
    score_col, _ = score_columns(df)
    return df.orderBy(F.col("primary_naics").asc_nulls_last(), F.col(score_col).desc_nulls_last())

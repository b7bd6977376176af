"""L4 company profile (J8) for a *set* of company ids.

The original looks one company up at a time (P9, P10); here the same
lookups are joins keyed by id, so one job profiles any number of companies.
Every right side is reduced to one row per id before it is joined (partial
aggregation), so a company with a huge number of buildings or contacts
never lands in one task; building *lists* stay a separate frame
(``joins.buildings_for_companies``) instead of an in-row collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..functions.ids import strip_leading_zeros
from ..functions.jsoncols import primary_contact
from ..operators.filters import select_ids
from ..operators.ranking import first_per_key
from ..sources.scan_order import scan_order_of


def _one_per_id(df: DataFrame, cols: list[str]) -> DataFrame:
    """The first row of each id in scan order (any, but always the same, if there is none)."""
    vals, first = [c for c in cols if c != "company_id"], scan_order_of(df)
    return first_per_key(df.select("company_id", *vals, *([first] if first else [])), ["company_id"], [first] if first else [], vals)


def first_rows(df: DataFrame, ids: DataFrame, cols: list[str]) -> DataFrame:
    """P9 for a set of ids: the first row of each id that ``df`` has, in scan order."""
    return _one_per_id(select_ids(df, ids), ["company_id", *cols])


def company_profile(companies: DataFrame, scored: DataFrame, buildings: DataFrame, ids: DataFrame,
                    contacts: DataFrame | None = None, churn: DataFrame | None = None,
                    research: DataFrame | None = None) -> DataFrame:
    """Company ⋈ scored (both required) + building counts (P10 id
    matching, A4 penetration) + contact summary + churn (P18) + research
    fallbacks (D27) + contact JSON (D5) + HQ / scoring display (D14, D15)."""
    comp_cols = [c for c in ["company_id", "name", "primary_naics", "hq_latitude", "hq_longitude",
                             "building_count_estimate", "building_count", "location_employee_size", "employees",
                             "sales_volume", "corporate_sales_revenue", "revenue", "primary_contact", "city", "state"]
                 if c in companies.columns]
    comp = _one_per_id(select_ids(companies, ids), comp_cols)
    sc_cols = [c for c in ["company_id", "scoring_path", "naics_attractiveness_score", "company_opportunity_score",
                           "final_score", "scoring_reason", "rank", "icp_fit_reasoning", "icp_recommendation",
                           "icp_confidence", "company_name"]
               if c in scored.columns]
    sc = _one_per_id(select_ids(scored, ids), sc_cols)
    prof = comp.join(sc, on="company_id", how="inner")

    # buildings: ids compared without leading zeros on both sides
    keys = prof.select("company_id", strip_leading_zeros(F.col("company_id")).alias("_k"))
    b = (buildings.select(strip_leading_zeros(F.col("company_id")).alias("_k"), "is_served")
         .groupBy("_k").agg(F.count(F.lit(1)).alias("total_buildings"),
                            F.count_if(F.col("is_served") == F.lit(True)).alias("served_buildings")))
    bk = keys.join(b, on="_k", how="inner").drop("_k")
    prof = prof.join(bk, on="company_id", how="left")
    prof = (prof.withColumn("total_buildings", F.coalesce(F.col("total_buildings"), F.lit(0)))
                .withColumn("served_buildings", F.coalesce(F.col("served_buildings"), F.lit(0)))
                .withColumn("penetration_rate",
                            F.when(F.col("total_buildings") > 0,
                                   F.col("served_buildings") / F.col("total_buildings") * F.lit(100.0))
                             .otherwise(F.lit(0.0))))
    if contacts is not None:
        prof = prof.join(_one_per_id(contacts, ["company_id", "contact_count", "last_contact_date"]),
                         on="company_id", how="left")
    if churn is not None:
        prof = prof.join(_one_per_id(churn, ["company_id", "churn_probability", "risk_tier"]), on="company_id",
                         how="left").withColumn("risk_message", F.when(F.col("risk_tier").isNotNull(),
                                                                       fmt.churn_risk_message(F.col("risk_tier"))))
    if research is not None:
        r = _one_per_id(research, ["company_id", "recommendation", "confidence", "reasoning"])
        prof = prof.join(r.select("company_id", *[F.col(c).alias(f"r_{c}") for c in r.columns if c != "company_id"]),
                         on="company_id", how="left")
    cols = set(prof.columns)

    def opt(c):
        return F.col(c) if c in cols else F.lit(None).cast("string")

    contact = primary_contact(opt("primary_contact")) if "primary_contact" in cols else []
    return prof.select(
        "company_id", F.coalesce(F.col("name"), F.lit("N/A")).alias("name"),
        F.coalesce(F.col("primary_naics"), F.lit("N/A")).alias("naics"),
        fmt.coordinates(opt("hq_latitude"), opt("hq_longitude")).alias("hq_coordinates"),
        F.coalesce(opt("city"), F.lit("N/A")).alias("hq_city"), F.coalesce(opt("state"), F.lit("N/A")).alias("hq_state"),
        F.coalesce(opt("building_count").cast("int"), F.lit(0)).cast("string").alias("buildings"),
        F.coalesce(F.coalesce(opt("building_count_estimate"), opt("building_count")).cast("long").cast("string"),
                   F.lit("N/A")).alias("building_count_estimate"),
        fmt.employee_size(opt("location_employee_size"), opt("employees")).alias("employee_size"),
        fmt.sales_text(opt("sales_volume"), opt("corporate_sales_revenue"), opt("revenue")).alias("sales_volume"),
        *contact,
        "total_buildings", "served_buildings", "penetration_rate",
        *([F.coalesce(F.col("contact_count"), F.lit(0)).cast("int").alias("contact_count"),
           F.coalesce(F.col("last_contact_date"), F.lit("N/A")).alias("last_contact")] if contacts is not None else []),
        *([F.col("churn_probability"), F.col("risk_tier"), F.col("risk_message")] if churn is not None else []),
        fmt.fallback(opt("r_recommendation"), opt("icp_recommendation")).alias("recommendation"),
        fmt.fallback(opt("r_confidence"), opt("icp_confidence")).alias("confidence"),
        fmt.fallback(opt("r_reasoning"), opt("icp_fit_reasoning")).alias("reasoning"),
        # D15 scoring breakdown with defaults
        F.coalesce(opt("scoring_path"), F.lit("Prospect")).alias("scoring_path"),
        F.coalesce(F.col("naics_attractiveness_score"), F.lit(0.0)).alias("naics_score"),
        F.coalesce(F.col("company_opportunity_score"), F.lit(0.0)).alias("company_score"),
        F.coalesce(F.col("final_score"), F.lit(0.0)).alias("final_score"),
        F.coalesce(opt("scoring_reason"), F.lit("N/A")).alias("scoring_reason"),
        F.coalesce(opt("rank").cast("string"), F.lit("N/A")).alias("segment_rank"))

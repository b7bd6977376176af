"""L2 industry rankings: metrics ⋈ per-industry company counts, described,
sorted by attractiveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naics
from ..operators import aggregates, joins
from ..session import reliable_checkpoint

RANKING_COLUMNS = ["naics_code", "naics_description", "attractiveness_score", "company_count", "customer_count",
                   "prospect_count", "icp_fit_score", "profitability_score", "market_size_score",
                   "market_size_count", "churn_health_score", "ticket_health_score", "reasoning"]

SORTABLE = ["attractiveness_score", "company_count", "icp_fit_score", "profitability_score", "market_size_score",
            "churn_health_score", "ticket_health_score"]


def industry_rankings(spark: SparkSession, scored: DataFrame, metrics: DataFrame,
                      naics_codes: DataFrame | None = None) -> DataFrame:
    """A1 -> J9 -> A8/D7 -> O1. ``scored`` is the filtered scored table.

    ``metrics`` is read twice (rows and the description table); it has one
    row per industry code (bounded by the code universe), so it is
    checkpointed once instead of recomputing a derived metrics plan twice."""
    metrics = reliable_checkpoint(metrics)
    m = metrics.withColumn("naics_code", F.col("naics_code").cast("string")) \
               .withColumn("reasoning", F.col("icp_fit_reasoning"))
    counts = aggregates.industry_counts(scored)
    j = joins.join_counts(m, counts)
    j = j.withColumn("prospect_count", F.col("company_count") - F.col("customer_count"))
    desc_table = naics.description_table(spark, metrics, naics_codes)
    j = naics.describe(j, "naics_code", desc_table, "_lookup")
    j = j.withColumn("naics_description",
                     F.when(naics.is_generic(F.col("naics_description")), F.col("_lookup"))
                      .otherwise(F.col("naics_description"))).drop("_lookup")
    return j.select(*RANKING_COLUMNS).orderBy(F.col("attractiveness_score").desc_nulls_last())


def sort_rankings(rankings: DataFrame, by: str = "attractiveness_score", ascending: bool = False) -> DataFrame:
    """O2: sort by one of the seven measures, nulls last both ways."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by!r}")
    c = F.col(by)
    return rankings.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())

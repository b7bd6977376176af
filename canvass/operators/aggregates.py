"""Aggregations.

All of them are ``groupBy().agg()`` or global ``agg()``: Spark runs a partial
aggregation inside every map task and shuffles only the partial rows, so a
group holding a third of the input costs one small row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import PageFilter


def industry_counts(scored: DataFrame, code_col: str = "naics_4digit") -> DataFrame:
    """A1: per industry code: companies, customers (null counts as not a
    customer, H27), prospects. Null codes drop out, like a pandas group-by."""
    return (scored.where(F.col(code_col).isNotNull())
                  .groupBy(F.col(code_col).cast("string").alias("naics_code"))
                  .agg(F.count("company_id").alias("company_count"),
                       F.sum(F.coalesce(F.col("is_customer").cast("int"), F.lit(0))).cast("long").alias("customer_count")))


def ranking_summary(rankings: DataFrame) -> DataFrame:
    """A2: industries, top attractiveness, total companies (one row)."""
    return rankings.agg(F.count(F.lit(1)).alias("total_industries"),
                        F.max("attractiveness_score").alias("top_score"),
                        F.coalesce(F.sum("company_count"), F.lit(0)).cast("long").alias("total_companies"))


def filtered_summary(scored: DataFrame, spec: PageFilter) -> DataFrame:
    """A3: filtered / total, average score, customers, prospects in one pass
    (one row; the average is null when nothing passes). ``is_customer`` is
    boolean at scan, so 'prospect' is ``is_customer = false`` (H25)."""
    pred = F.coalesce(spec.predicate(scored.columns), F.lit(False))
    return scored.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(pred).alias("filtered_count"),
        F.avg(F.when(pred, F.col("final_score"))).alias("avg_score"),
        F.count_if(pred & (F.col("is_customer") == F.lit(True))).alias("customer_count"),
        F.count_if(pred & (F.col("is_customer") == F.lit(False))).alias("prospect_count"))


def facet_values(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Sorted distinct non-null values of each facet column, with counts
    (one pass: the facet columns are stacked, then grouped)."""
    present = [f for f in facets if f in df.columns]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in present])).alias("s"))
    return (stacked.select("s.facet", "s.value").where(F.col("value").isNotNull())
                   .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
                   .orderBy("facet", "value"))


#: Values in one text of a contact list.
LIST_CHUNK = 1000


def contact_lists(contacts: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """A19 without unbounded cells: (company_id, kind, chunk, n_values, text), the distinct names and e-mails of a
    company in ascending order, ``chunk`` of them a text, joined by '; '.

    Values are made distinct first, then ranked inside (company, kind) by ranges of the sorted values
    (``ranking.contiguous_rank``), so a company with any number of contacts is spread over tasks, and
    only one chunk is ever gathered."""
    from .ranking import contiguous_rank
    values = (contacts.select("company_id", F.explode(F.array(
        F.struct(F.lit("email").alias("kind"), F.col("contact_email").alias("value")),
        F.struct(F.lit("name").alias("kind"), F.col("contact_name").alias("value")))).alias("v"))
        .select("company_id", "v.kind", "v.value").where("value is not null").distinct())
    placed = contiguous_rank(values, ["company_id", "kind"], [F.col("value").asc()], rank_col="place")
    return (placed.groupBy("company_id", "kind", F.floor((F.col("place") - 1) / chunk).alias("chunk"))
            .agg(F.sort_array(F.collect_list("value")).alias("v"))
            .select("company_id", "kind", "chunk", F.size("v").alias("n_values"), F.array_join("v", "; ").alias("text")))


def contact_summary(contacts: DataFrame) -> DataFrame:
    """Per company: contact count, last contact date, names and emails
    joined (sorted, distinct, so the text does not depend on row order).

    The joined lists are the output itself (one text per company), so their
    size is the number of *distinct* names of a company; the sets are built
    by partial aggregation in every map task, so a company with a third of
    all contact rows never ships its raw rows to one task."""
    return contacts.groupBy("company_id").agg(
        F.count(F.lit(1)).cast("int").alias("contact_count"),
        F.max("contact_date").alias("last_contact_date"),
        F.array_join(F.sort_array(F.collect_set("contact_name")), "; ").alias("contact_names"),
        F.array_join(F.sort_array(F.collect_set("contact_email")), "; ").alias("contact_emails"))


def risk_metrics_by_industry(df: DataFrame, code_col: str, churn_col: str, ticket_col: str) -> DataFrame:
    """Average churn and ticket health per industry (the exact formula
    is not given; plain averages of the inputs)."""
    return df.groupBy(code_col).agg(F.count(F.lit(1)).alias("n_companies"),
                                    F.avg(churn_col).alias("avg_churn"),
                                    F.avg(ticket_col).alias("avg_ticket"))


def interaction_counts(interactions: DataFrame) -> DataFrame:
    """Engagements per company and engagement type."""
    return interactions.groupBy("company_id", "engagement_type").agg(F.count(F.lit(1)).alias("n_engagements"))

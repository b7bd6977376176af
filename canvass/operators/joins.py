"""Join operators.

Semi / anti joins replace Python ``set`` membership; at scale both sides are
shuffled on the key unless one side is small, and AQE switches to a
broadcast hash join when the runtime size of a side is under the broadcast
threshold, so no side is broadcast on faith. Right sides that can repeat a
key are reduced to one row per key *before* the join (partial aggregation,
see ``ranking.first_per_key``), so a left join never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import clean_crm_domain, clean_domain
from ..functions.ids import strip_leading_zeros
from ..sources.scan_order import scan_order_of
from .ranking import first_per_key, last_per_key


def drop_orphans(df: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """Keep rows whose key exists in ``companies``."""
    return df.join(companies.select(key).distinct(), on=key, how="left_semi")


def orphans(df: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows of ``df`` whose key is missing from ``companies`` (anti join;
    the report side of J1 / J2)."""
    return df.join(companies.select(key).distinct(), on=key, how="left_anti")


def orphan_report(df: DataFrame, companies: DataFrame, table: str, key: str = "company_id") -> DataFrame:
    """One row per table: orphan rows and distinct orphan keys."""
    o = orphans(df, companies, key)
    return o.agg(F.count(F.lit(1)).alias("orphan_rows"),
                 F.count_distinct(F.col(key)).alias("orphan_keys")).select(
        F.lit(table).alias("table_name"), "orphan_rows", "orphan_keys")


def merge_building_count(scored: DataFrame, companies: DataFrame) -> DataFrame:
    """``building_count`` from the (normalised, de-duplicated) companies
    table, null -> 0; an existing left column is replaced (H2, H3). Of a repeated
    id the smallest count is taken."""
    right = companies.groupBy("company_id").agg(F.min("building_count").alias("building_count"))
    base = scored.drop("building_count") if "building_count" in scored.columns else scored
    return (base.join(right, on="company_id", how="left")
                .withColumn("building_count", F.coalesce(F.col("building_count"), F.lit(0)).cast("int")))


#: Rows of a config lookup that may be broadcast.
MAX_BROADCAST_ROWS = 10_000


def small_side(lookup: DataFrame) -> DataFrame:
    """A config lookup (codes, channels, targets), marked for broadcast once its row count is checked.

    A larger one is left to the planner, which joins it by a shuffle.
    """
    few = lookup.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return F.broadcast(lookup) if few else lookup


def enrich_raw_fields(scored: DataFrame, companies: DataFrame,
                      fields: Sequence[str] = ("building_count_estimate", "growing_business_code", "contacts_count"),
                      order_col: str | None = None) -> DataFrame:
    """Left join of raw company fields, first row per id in the order of
    ``order_col`` (by default the scan order that the readers carry). A table
    without one has no first row: then a row with values is taken before one with
    nulls, and of several always the same.
    Absent fields arrive as typed nulls.
    """
    right = companies
    order_col = scan_order_of(companies, order_col)
    for f in fields:
        if f not in right.columns:
            right = right.withColumn(f, F.lit(None).cast("string"))
    right = first_per_key(right.select("company_id", *fields, *([order_col] if order_col else [])),
                          ["company_id"], [order_col] if order_col else [F.col(f).isNull() for f in fields], value_cols=list(fields))
    base = scored.drop(*[f for f in fields if f in scored.columns])
    return base.join(right, on="company_id", how="left")


def flag_crm_presence(scored: DataFrame, companies: DataFrame, crm: DataFrame,
                      strict: bool = True, flag_col: str = "in_hubspot", order_col: str | None = None) -> DataFrame:
    """Company website (D1) found among CRM domains (D2) -> flag.

    ``strict=True`` keeps the CRM paths as the original does (H10);
    ``strict=False`` cuts both sides at the first '/'. Missing website or no
    CRM data -> False. A company id listed twice: the last row's website decides
    (dictionary semantics, H11) by ``order_col`` or the scan order; without an
    order any matching row sets the flag.
    """
    order_col = scan_order_of(companies, order_col)
    crm_clean = clean_crm_domain(F.col("domain")) if strict else clean_domain(F.col("domain"))
    crm_domains = crm.select(crm_clean.alias("_dom")).where(F.col("_dom").isNotNull()).distinct()
    if order_col:
        companies = last_per_key(companies.select("company_id", "website", order_col), ["company_id"],
                                 [F.col(order_col)], ["website"])
    comp = (companies.select("company_id", clean_domain(F.col("website")).alias("_dom"))
            .join(crm_domains.withColumn("_hit", F.lit(True)), on="_dom", how="left")
            .groupBy("company_id").agg(F.max(F.coalesce(F.col("_hit"), F.lit(False))).alias("_hit")))
    # the company table may repeat an id; the last mapping wins in the original,
    # any() is the order-free reading used here
    return (scored.join(comp, on="company_id", how="left")
                  .withColumn(flag_col, F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def penetration_lookup(scored: DataFrame, penetration: DataFrame, order_col: str | None = None,
                       out_col: str = "penetration_rate") -> DataFrame:
    """Id -> penetration rate; duplicate ids keep the last (dictionary
    semantics, H11) by ``order_col`` or the scan order, without either the
    highest; missing -> null (shown as '—')."""
    order_col = scan_order_of(penetration, order_col)
    if order_col:
        right = last_per_key(penetration.select("company_id", "penetration_rate", order_col), ["company_id"], [order_col],
                             value_cols=["penetration_rate"])
    else:
        right = penetration.groupBy("company_id").agg(F.max("penetration_rate").alias("penetration_rate"))
    right = right.withColumnRenamed("penetration_rate", out_col)
    base = scored.drop(out_col) if out_col in scored.columns else scored
    return base.join(right, on="company_id", how="left")


def buildings_for_companies(buildings: DataFrame, company_ids: DataFrame) -> DataFrame:
    """P10 for a set of ids: match after stripping leading zeros on both sides."""
    ids = company_ids.select(strip_leading_zeros(F.col("company_id")).alias("_k"),
                             F.col("company_id").alias("requested_id")).distinct()
    return (buildings.withColumn("_k", strip_leading_zeros(F.col("company_id")))
                     .join(ids, on="_k", how="inner").drop("_k"))


def join_counts(metrics: DataFrame, counts: DataFrame, key_left: str = "naics_code",
                key_right: str = "naics_code", count_cols: Sequence[str] = ("company_count", "customer_count")) -> DataFrame:
    """Left join of per-code counts onto metrics by code text, null -> 0."""
    right = counts.withColumnRenamed(key_right, key_left) if key_left != key_right else counts
    out = metrics.join(right, on=key_left, how="left")
    for c in count_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def building_penetration(companies: DataFrame, buildings: DataFrame) -> DataFrame:
    """A4: per company 100 * served / total buildings; no buildings -> 0."""
    agg = buildings.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_buildings"),
        F.count_if(F.col("is_served") == F.lit(True)).alias("served_buildings"))
    comp = companies.select("company_id").distinct()
    return (comp.join(agg, on="company_id", how="left")
                .select("company_id",
                        F.coalesce(F.col("total_buildings"), F.lit(0)).alias("total_buildings"),
                        F.coalesce(F.col("served_buildings"), F.lit(0)).alias("served_buildings"),
                        F.when(F.col("total_buildings") > 0,
                               F.col("served_buildings") / F.col("total_buildings") * F.lit(100.0))
                         .otherwise(F.lit(0.0)).alias("penetration_rate")))


def estimate_penetration(estimates: DataFrame, served: DataFrame) -> DataFrame:
    """A5: rate = served / total estimate * 100 (null when the estimate is
    0); data quality 'none' when nothing is served, else 'estimated'."""
    j = estimates.join(served, on="company_id", how="left") \
        .withColumn("served_buildings", F.coalesce(F.col("served_buildings"), F.lit(0)).cast("int"))
    rate = F.try_divide(F.col("served_buildings").cast("double"), F.col("total_buildings_estimate").cast("double")) \
        * F.lit(100.0)
    return j.select("company_id", F.col("total_buildings_estimate").cast("int").alias("total_buildings_estimate"),
                    "served_buildings", rate.alias("penetration_rate"),
                    F.when(F.col("served_buildings") > 0, F.lit("estimated")).otherwise(F.lit("none"))
                     .alias("data_quality"))


def penetration_by_industry(estimates: DataFrame, companies: DataFrame, code_col: str = "naics_4digit") -> DataFrame:
    """A5 by industry (the original names the table but not its formula):
    100 * served / estimated buildings summed over the companies of each
    code (null when no building is estimated), with company counts."""
    j = estimates.join(companies.select("company_id", code_col).distinct(), on="company_id", how="inner")
    g = j.where(F.col(code_col).isNotNull()).groupBy(code_col).agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum("total_buildings_estimate").cast("long").alias("total_buildings_estimate"),
        F.sum("served_buildings").cast("long").alias("served_buildings"))
    return g.withColumn("penetration_rate",
                        F.try_divide(F.col("served_buildings").cast("double"),
                                     F.col("total_buildings_estimate").cast("double")) * F.lit(100.0))

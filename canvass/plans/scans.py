"""Queries that run the readers (S1-S7, S10-S13, S16) and the sink (S17): each carrier table is written as the file that
the reader expects, by Spark and once per session, in the shared checkpoint folder, and read back through it.

The files lack optional columns on purpose, so that fallbacks, declared types and the schema check (P14, U2) and the
preference of paths (P15) take part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import readers, writers
from . import carriers as cr

_PATHS: dict[tuple, str] = {}


def written_file(spark: SparkSession, sf: str, name: str, df: DataFrame, kind: str = "csv") -> str:
    """Path of ``df`` written as a CSV (with header) or Parquet table; written once per session."""
    key = (spark._jsparkSession.hashCode(), sf.rstrip("/"), name)
    if key not in _PATHS:
        path = f"{ensure_checkpoint_dir(spark)}/canvass-files-{uuid.uuid4().hex}/{name}.{kind}"
        if kind == "csv":
            df.write.option("header", "true").option("escape", '"').csv(path)
        elif kind == "text":
            df.write.text(path)
        else:
            df.write.parquet(path)
        _PATHS[key] = path
    return _PATHS[key]


def companies(spark, sf):
    """No ``building_count`` in the file, so it falls back to the estimate."""
    path = written_file(spark, sf, "companies", cr.companies(spark, sf).drop("building_count", "primary_contact"))
    return readers.load_companies(spark, path).select(
        "company_id", "name", "primary_naics", "hq_latitude", "hq_longitude", "building_count", "building_count_estimate", "website",
        "growing_business_code", "contacts_count", "city", "state", "employees", "sales_volume")


def buildings(spark, sf):
    """S2 (P15, J1): no golden file, so the plain one; no ``is_served`` in it, so it follows the source; orphans go."""
    path = written_file(spark, sf, "buildings", cr.buildings(spark, sf).drop("is_served"))
    return readers.load_buildings(spark, path + ".golden.csv", path, cr.companies(spark, sf)).select(
        "building_id", "company_id", "latitude", "longitude", "source", "is_served", "square_footage_code", "square_footage")


def buildings_with_flags(spark, sf):
    """A golden file with ``is_served``, whose nulls stay null."""
    flagged = cr.buildings(spark, sf).withColumn("is_served", F.when(F.col("source") != "hubspot", F.col("is_served")))
    path = written_file(spark, sf, "golden_buildings", flagged)
    return readers.load_buildings(spark, path, path + ".plain.csv").select("building_id", "source", "is_served")


def scored(spark, sf):
    """S3: the final file, new format by its columns."""
    path = written_file(spark, sf, "scored_final", cr.scored(spark, sf))
    return readers.load_scored(spark, path, path + ".old.csv").select(*cr.scored(spark, sf).columns)


def scored_old(spark, sf):
    """S3: no final file, so the old one, old format by its columns."""
    path = written_file(spark, sf, "scored_companies", cr.scored_old(spark, sf))
    return readers.load_scored(spark, path + ".final.csv", path).select(*cr.scored_old(spark, sf).columns)


def penetration(spark, sf, estimates: DataFrame):
    """S4."""
    path = written_file(spark, sf, "penetration_by_company", estimates)
    return readers.load_penetration(spark, path).select("company_id", "total_buildings_estimate", "served_buildings", "penetration_rate", "data_quality")


def contacts(spark, sf, summary: DataFrame):
    """S5."""
    return readers.load_contact_summary(spark, written_file(spark, sf, "contact_summary", summary)).drop("_scan_order")


def research(spark, sf):
    """Whole texts with line breaks and quotes, in Parquet."""
    path = written_file(spark, sf, "company_research", cr.company_research(spark, sf), "parquet")
    return readers.load_company_research(spark, path).select("company_id", "had_web_research", "icp_fit_score", "confidence", "reasoning", "timing")


def churn(spark, sf):
    """S7."""
    path = written_file(spark, sf, "churn_predictions", cr.churn_predictions(spark, sf))
    return readers.load_churn_predictions(spark, path).select("company_id", "churn_probability", "risk_tier", "prediction_date")


def crm(spark, sf):
    """S10."""
    return readers.load_crm_companies(spark, written_file(spark, sf, "crm_companies", cr.crm_companies(spark, sf))).select("domain")


def metrics(spark, sf):
    """S11."""
    path = written_file(spark, sf, "naics_metrics", cr.naics_metrics(spark, sf))
    return readers.load_naics_metrics(spark, path).select("naics_code", "naics_description", "attractiveness_score", "icp_fit_score",
                                                          "market_size_score", "market_size_count")


def codes(spark, sf):
    """Descriptions from a code file."""
    path = written_file(spark, sf, "naics_codes", cr.naics_metrics(spark, sf).select("naics_code", F.col("naics_description").alias("description")))
    return readers.load_naics_codes(spark, path).select("naics_code", "description")


def er_log(spark, sf, log: DataFrame):
    """S13."""
    path = written_file(spark, sf, "entity_resolution_log", log.select("hubspot_id", "hubspot_type", "dataaxle_id", "match_type", "confidence_score"))
    return readers.load_entity_resolution_log(spark, path).select("hubspot_id", "hubspot_type", "dataaxle_id", "match_type", "confidence_score")


def interactions(spark, sf):
    """Parsed event time."""
    path = written_file(spark, sf, "crm_interactions", cr.crm_interactions(spark, sf))
    return readers.load_crm_interactions(spark, path).select("engagement_id", "company_id", "engagement_type",
                                                             F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "body")


def sink(spark, sf, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Write the tables of an export and report what arrived: rows of each folder, read back."""
    out = f"{ensure_checkpoint_dir(spark)}/canvass-files-{uuid.uuid4().hex}/export"
    names = writers.write_export(tables, out)
    parts = [spark.read.parquet(f"{out}/{writers._safe(n)}").select(F.lit(n).alias("table_name"), F.lit(1).alias("one")) for n in names]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("table_name").agg(F.count("*").alias("n_rows"))

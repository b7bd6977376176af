"""Scans of the prospect tables (S1-S16) with declared types.

CSV files are read with every column as text (no inference pass over the
data), then one projection casts each declared column with ``try_cast``
(blank and NaN become null, ids stay strings so leading zeros survive) and
adds declared-but-absent columns as typed nulls. Extra columns pass through.
Parquet inputs go through the same projection, so both formats give the
same schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from . import schemas
from .scan_order import with_scan_order


class SchemaValidationError(ValueError):
    """A required column is missing."""


class DataLoadError(IOError):
    """A required source is missing or unreadable."""


def validate_schema(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """Fail before any job runs if a required column is missing
    (set difference of column names)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaValidationError(f"{name}: missing required columns {missing}")
    return df


def _typed(col: Column, dtype: T.DataType) -> Column:
    text = F.nullif(F.trim(col.cast("string")), F.lit(""))
    if isinstance(dtype, T.StringType):
        return F.nullif(col.cast("string"), F.lit(""))
    if isinstance(dtype, T.DoubleType):
        d = text.try_cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        # '12.0' -> 12 through double; 'abc' -> null
        d = text.try_cast("double")
        d = F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
        return d.try_cast(dtype.simpleString())
    if isinstance(dtype, T.BooleanType):
        low = F.lower(text)
        return (F.when(low.isin("true", "t", "1", "1.0", "yes", "y"), F.lit(True))
                 .when(low.isin("false", "f", "0", "0.0", "no", "n"), F.lit(False))
                 .otherwise(F.lit(None).cast("boolean")))
    return col.cast(dtype)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast declared columns, add absent ones as typed nulls, keep extras."""
    present = set(df.columns)
    declared = [f.name for f in schema.fields]
    cols = []
    for f in schema.fields:
        if f.name in present:
            src_type = df.schema[f.name].dataType
            if src_type == f.dataType and not isinstance(f.dataType, (T.StringType, T.DoubleType)):
                cols.append(F.col(f.name))
            else:
                cols.append(_typed(F.col(f.name), f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extras = [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols, *extras)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _read_any(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One table. ``multiline=False`` is for CSV files without line breaks inside fields: only these
    can be split, a file with them is one task."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", "true").json(path)
    return (spark.read.option("header", "true").option("inferSchema", "false")
            .option("multiLine", str(multiline).lower()).option("escape", '"').csv(path))


def read_first(spark: SparkSession, paths: Sequence[str], multiline: bool = True) -> tuple[DataFrame, str] | None:
    """The first readable path in preference order, or ``None``."""
    for p in paths:
        try:
            df = _read_any(spark, p, multiline)
            df.schema  # resolves the file listing now
            return df, p
        except AnalysisException:
            continue
    return None


def load_table(spark: SparkSession, paths: str | Sequence[str], name: str, schema: T.StructType,
               required: Sequence[str] | None = None, optional: bool = False, scan_order: bool = False,
               multiline: bool = True) -> DataFrame | None:
    """Generic scan: preferred path, P14 check, declared types; with ``scan_order`` the rows' order in their file.

    Missing optional source -> ``None`` (caller decides) ; missing required
    source -> ``DataLoadError``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = read_first(spark, paths, multiline)
    if found is None:
        if optional:
            return None
        raise DataLoadError(f"{name}: none of {paths} exists")
    df, _ = found
    if scan_order:
        df = with_scan_order(df)
    validate_schema(df, required if required is not None else schemas.REQUIRED.get(name, []), name)
    return conform(df, schema)


# ------------------------------------------------------------------ S1..S16

def normalize_companies(df: DataFrame) -> DataFrame:
    """S1 rule: ``building_count`` falls back to ``building_count_estimate``."""
    return df.withColumn("building_count", F.coalesce(F.col("building_count"), F.col("building_count_estimate")))


def load_companies(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    df = load_table(spark, path, "companies", schemas.COMPANIES, scan_order=True)
    return normalize_companies(df)


def normalize_buildings(df: DataFrame, has_served: bool | None = None) -> DataFrame:
    """S2 rules: default source, ``is_served`` from source if the file has no such column, square footage
    from its code when absent. ``has_served`` says whether the file has the column: then its nulls stay.
    Without that knowledge every null flag is derived."""
    source = F.coalesce(F.col("source"), F.lit(config.DEFAULT_BUILDING_SOURCE))
    served = F.col("is_served") if has_served else F.coalesce(F.col("is_served"), F.lower(source).isin(*config.SERVED_SOURCES))
    return (df.withColumn("source", source)
              .withColumn("is_served", served)
              .withColumn("square_footage", F.coalesce(F.col("square_footage"), F.col("square_footage_code"))))


def load_buildings(spark: SparkSession, golden_path: str, plain_path: str,
                   companies: DataFrame | None = None) -> DataFrame:
    """Golden file first, else plain file; orphans dropped when the
    companies frame is given (J1)."""
    found = read_first(spark, [golden_path, plain_path])
    if found is None:
        raise DataLoadError(f"buildings: none of {[golden_path, plain_path]} exists")
    raw = validate_schema(found[0], schemas.REQUIRED.get("buildings", []), "buildings")
    df = normalize_buildings(conform(raw, schemas.BUILDINGS), "is_served" in raw.columns)
    if companies is not None:
        from ..operators.joins import drop_orphans
        df = drop_orphans(df, companies)
    return df


def detect_score_format(df: DataFrame) -> str:
    """New format has both ``final_score`` and ``scoring_path``."""
    return "new" if {"final_score", "scoring_path"} <= set(df.columns) else "old"


def load_scored(spark: SparkSession, final_path: str, old_path: str) -> DataFrame:
    """S3 scan part: final file first, else old file; format by columns."""
    found = read_first(spark, [final_path, old_path])
    if found is None:
        raise DataLoadError(f"scored: none of {[final_path, old_path]} exists")
    raw, _ = found
    fmt = detect_score_format(raw)
    name = "scored_new" if fmt == "new" else "scored_old"
    validate_schema(raw, schemas.REQUIRED[name], name)
    return conform(raw, schemas.SCORED_NEW if fmt == "new" else schemas.SCORED_OLD)


def load_penetration(spark, path):  # S4
    return load_table(spark, path, "penetration", schemas.PENETRATION, scan_order=True)


def load_contact_summary(spark, path):  # S5
    return load_table(spark, path, "contact_summary", schemas.CONTACT_SUMMARY, scan_order=True)


def load_company_research(spark, path):  # S6: missing file -> empty frame, missing columns only warn
    df = load_table(spark, path, "company_research", schemas.COMPANY_RESEARCH, required=["company_id"],
                    optional=True, scan_order=True)
    return df if df is not None else empty_frame(spark, schemas.COMPANY_RESEARCH)


def load_churn_predictions(spark, path):  # S7: schema failure or missing -> empty frame
    try:
        df = load_table(spark, path, "churn_predictions", schemas.CHURN_PREDICTIONS, optional=True, scan_order=True)
    except SchemaValidationError:
        df = None
    return df if df is not None else empty_frame(spark, schemas.CHURN_PREDICTIONS)


def load_research_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {metadata, companies: {id: {...}}} -> one row per
    company (id, fields as JSON text; numbers, booleans and nulls keep their kind)."""
    raw = spark.read.schema("companies MAP<STRING, VARIANT>").option("multiLine", "true").json(path)
    if raw.where(F.col("companies").isNotNull()).isEmpty():
        raise SchemaValidationError("research enrichment: missing 'companies'")
    return (raw.select(F.explode("companies").alias("company_id", "v"))
            .select("company_id", F.to_json("v").alias("enrichment_json")))


def load_research_documents(spark: SparkSession, folder: str) -> DataFrame:
    """S9 in bulk: one JSON file per company; the company id is the file name
    stem; unreadable files keep their text in ``_corrupt_record``."""
    df = (spark.read.schema(schemas.RESEARCH_DOCUMENT).option("mode", "PERMISSIVE")
          .option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record")
          .json(folder)
          .withColumn("company_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)))
    return df


def load_crm_companies(spark, path):  # S10: failure -> empty (all flags false downstream)
    df = load_table(spark, path, "crm_companies", schemas.CRM_COMPANIES, optional=True)
    return df if df is not None else empty_frame(spark, schemas.CRM_COMPANIES)


def load_naics_metrics(spark, path):  # S11: missing -> empty frame with the full schema (H23)
    df = load_table(spark, path, "naics_metrics", schemas.NAICS_METRICS, optional=True)
    return df if df is not None else empty_frame(spark, schemas.NAICS_METRICS)


def load_naics_codes(spark, path):  # S12 (config file part)
    df = load_table(spark, path, "naics_codes", schemas.NAICS_CODES, required=["naics_code", "description"],
                    optional=True)
    return df if df is not None else empty_frame(spark, schemas.NAICS_CODES)


def load_entity_resolution_log(spark, path):  # S13: match_type optional
    return load_table(spark, path, "entity_resolution_log", schemas.ENTITY_RESOLUTION_LOG, optional=True)


def load_scoring_diagnostics(spark, path):  # S14
    df = read_first(spark, [path])
    if df is None:
        return None
    return df[0].select(F.col("weight_validation.sum").cast("double").alias("weight_sum")) \
        if "weight_validation" in df[0].columns else None


def load_crm_interactions(spark, path):  # S16
    df = load_table(spark, path, "crm_interactions", schemas.CRM_INTERACTIONS)
    return df.withColumn("event_ts", F.try_to_timestamp(F.col("timestamp")))


def config_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small driver-side config (a few dozen rows at most) as a frame."""
    return spark.createDataFrame(rows, schema)

"""Coordinate checks and map statistics.

One reason column decides validity, so "valid" and "excluded" are two
filters of the same projection and always add up to the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import marker_color


def coordinate_reason(df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude",
                      out_col: str = "coord_reason") -> DataFrame:
    """Null when valid; else why: missing, not numeric, latitude out of
    [-90, 90], longitude out of [-180, 180] (first failing check)."""
    raw_lat, raw_lon = F.col(lat_col), F.col(lon_col)
    lat = raw_lat.cast("string").try_cast("double")
    lon = raw_lon.cast("string").try_cast("double")
    reason = (F.when(raw_lat.isNull() | raw_lon.isNull() | F.isnan(lat) | F.isnan(lon), F.lit("Coordinates missing"))
               .when(lat.isNull() | lon.isNull(), F.lit("Coordinates not numeric"))
               .when(~lat.between(-90.0, 90.0), F.concat(F.lit("Latitude out of range: "), lat.cast("string")))
               .when(~lon.between(-180.0, 180.0), F.concat(F.lit("Longitude out of range: "), lon.cast("string"))))
    return df.withColumn(out_col, reason)


def split_valid(df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude") -> tuple[DataFrame, DataFrame]:
    """(valid, excluded) frames."""
    r = coordinate_reason(df, lat_col, lon_col)
    return r.where(F.col("coord_reason").isNull()).drop("coord_reason"), r.where(F.col("coord_reason").isNotNull())


def exclusion_summary(df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Excluded rows in total and for the two named sources (zero when
    absent), one pass."""
    r = coordinate_reason(df, lat_col, lon_col)
    bad = F.col("coord_reason").isNotNull()
    src = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return r.agg(F.count_if(bad).alias("total_excluded"),
                 F.count_if(bad & (src == "dataaxle")).alias("dataaxle_excluded"),
                 F.count_if(bad & (src == "manual")).alias("manual_excluded"))


def hq_points(companies: DataFrame) -> DataFrame:
    """HQ coordinates as the map's latitude/longitude."""
    return companies.withColumn("latitude", F.col("hq_latitude")).withColumn("longitude", F.col("hq_longitude"))


def map_statistics(points: DataFrame) -> DataFrame:
    """Total, valid, excluded, customers and prospects among the valid
    points (one pass)."""
    r = coordinate_reason(points)
    ok = F.col("coord_reason").isNull()
    cust = (F.col("is_customer") == F.lit(True)) if "is_customer" in points.columns else F.lit(False)
    return r.agg(F.count(F.lit(1)).alias("total_companies"), F.count_if(ok).alias("valid_companies"),
                 F.count_if(~ok).alias("excluded_companies"), F.count_if(ok & cust).alias("customers"),
                 (F.count_if(ok) - F.count_if(ok & cust)).alias("prospects"))


def marker_colors(points: DataFrame) -> DataFrame:
    """Colour of every valid point in the three colour modes."""
    valid, _ = split_valid(points)
    has = F.col("has_research_doc") if "has_research_doc" in points.columns else F.lit(False)
    cust = F.col("is_customer") if "is_customer" in points.columns else F.lit(False)
    score = F.col("final_score") if "final_score" in points.columns else F.lit(0.0)
    return valid.select("company_id",
                        marker_color("customer_status", cust, has, score).alias("color_customer_status"),
                        marker_color("research_status", cust, has, score).alias("color_research_status"),
                        marker_color("score_tier", cust, has, score).alias("color_score_tier"))

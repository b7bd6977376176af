"""Industry descriptions (A8, D7) as joins of a small description table plus
literal-map expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .ids import canonical_naics

# priority of description sources (higher wins)
PRIORITY_INLINE, PRIORITY_CONFIG, PRIORITY_METRICS = 1, 2, 3


def sector_label(code: Column) -> Column:
    """D7 fallback: '<sector name> (<code>)' by 2-digit prefix, else 'NAICS <code>'."""
    m = F.create_map(*[x for k, v in config.SECTOR_NAMES for x in (F.lit(k), F.lit(v))])
    name = m[F.substring(code, 1, 2)]
    return F.when(name.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")"))) \
            .otherwise(F.concat(F.lit("NAICS "), code))


def is_generic(desc: Column) -> Column:
    """Missing, blank or 'NAICS …' text counts as no description."""
    return desc.isNull() | desc.startswith("NAICS ") | (F.trim(desc) == F.lit(""))


def description_table(spark: SparkSession, metrics: DataFrame | None = None,
                      naics_codes: DataFrame | None = None) -> DataFrame:
    """Union of the description sources, then one description per
    code: metrics (usable text) > config file > inline table. Bounded by the
    NAICS code universe."""
    parts = [spark.createDataFrame([(k, v, PRIORITY_INLINE) for k, v in config.SUPPLEMENTARY_DESCRIPTIONS.items()],
                                   "code string, description string, priority int")]
    if naics_codes is not None:
        parts.append(naics_codes.select(canonical_naics(F.col("naics_code")).alias("code"),
                                        F.col("description"), F.lit(PRIORITY_CONFIG).alias("priority")))
    if metrics is not None:
        parts.append(metrics.where(~is_generic(F.col("naics_description")))
                     .select(canonical_naics(F.col("naics_code")).alias("code"),
                             F.col("naics_description").alias("description"),
                             F.lit(PRIORITY_METRICS).alias("priority")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.where(F.col("code").isNotNull())
             .groupBy("code").agg(F.max_by("description", "priority").alias("description")))


def describe(df: DataFrame, code_col: str, descriptions: DataFrame, out_col: str = "naics_description_lookup") -> DataFrame:
    """4-digit prefix match -> full-code match -> sector -> 'NAICS x';
    null/blank code -> 'Unknown'."""
    code = canonical_naics(F.col(code_col))
    d4 = descriptions.select(F.col("code").alias("_d4_code"), F.col("description").alias("_d4"))
    dfull = descriptions.select(F.col("code").alias("_df_code"), F.col("description").alias("_dfull"))
    out = (df.withColumn("_code", code)
             .join(d4, F.when(F.length("_code") >= 4, F.substring("_code", 1, 4)) == F.col("_d4_code"), "left")
             .join(dfull, F.col("_code") == F.col("_df_code"), "left"))
    label = F.when(F.col("_code").isNull(), F.lit("Unknown")) \
             .otherwise(F.coalesce(F.col("_d4"), F.col("_dfull"), sector_label(F.col("_code"))))
    return out.withColumn(out_col, label).drop("_code", "_d4_code", "_d4", "_df_code", "_dfull")

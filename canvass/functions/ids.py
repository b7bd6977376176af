"""Identifier normal forms (D26, NAICS canonical text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_leading_zeros(c: Column) -> Column:
    """D26 / P10: '007526346' and '7526346' compare equal; an all-zero id
    becomes '0' on both sides (H15)."""
    s = F.trim(c.cast("string"))
    return F.when(s.isNull(), F.lit(None).cast("string")) \
            .otherwise(F.coalesce(F.nullif(F.ltrim(s, F.lit("0")), F.lit("")), F.lit("0")))


def canonical_naics(c: Column) -> Column:
    """NAICS as text: '6111.0' -> '6111', blank -> null (H1: compare strings)."""
    s = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.regexp_replace(s, r"\.0+$", "")

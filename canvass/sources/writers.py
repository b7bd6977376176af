"""Sinks (S17): result tables written as one folder per table.

Every table is written by the executors in parallel (no driver collect);
the manifest is a one-row-per-property table written alongside. A table
that is ``None`` (e.g. no research column) is skipped, as the original
skips an empty research sheet.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame


def _safe(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_").lower()


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Parquet rejects some characters in column names (spaces, parens);
    display names are kept in CSV/JSON, made safe for Parquet."""
    return df.toDF(*[_safe(c) for c in df.columns])


def write_export(tables: Mapping[str, DataFrame | None], out_dir: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[str]:
    """Write each non-empty table to ``out_dir/<name>/``; returns the names
    written. ``fmt`` is parquet, csv (with header) or json."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        w = (sanitize_columns(df) if fmt == "parquet" else df).write.mode(mode)
        path = f"{out_dir.rstrip('/')}/{_safe(name)}"
        if fmt == "csv":
            w.option("header", "true").csv(path)
        elif fmt == "json":
            w.json(path)
        else:
            w.parquet(path)
        written.append(name)
    return written

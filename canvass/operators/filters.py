"""Row filters.

Every filter is a plain ``Column`` predicate so Catalyst can push it into the
scan (``PushedFilters``) and fuse it into one codegen stage. Filter choices
arrive as an immutable spec instead of UI session state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def apply_industry_exclusions(df: DataFrame, codes: list[str] | None = None,
                              col: str = "primary_naics") -> DataFrame:
    """Drop rows whose code is an enabled exclusion; null codes are kept
    (codes compared as text, H1). The code list is a fixed, tiny literal
    list, so ``isin`` reaches the scan as a pushed filter."""
    codes = config.excluded_naics_codes() if codes is None else codes
    if not codes:
        return df
    c = F.col(col)
    return df.filter(c.isNull() | ~c.isin(*codes))


@dataclass(frozen=True)
class PageFilter:
    """Conjunctive page filters; 'All' disables a filter."""
    scoring_path: str = "All"
    naics_4digit: str = "All"
    hubspot: str = "All"          # 'All' | 'In HubSpot' | 'Not in HubSpot'
    state: str = "All"
    score_min: float = 0.0
    score_max: float = 100.0

    def predicate(self, columns: list[str]) -> Column:
        conds: list[Column] = []
        if self.scoring_path != "All":
            conds.append(F.col("scoring_path") == F.lit(self.scoring_path))
        if self.naics_4digit != "All":
            conds.append(F.col("naics_4digit").cast("string") == F.lit(self.naics_4digit))
        if self.hubspot == "In HubSpot":
            conds.append(F.col("in_hubspot") == F.lit(True))
        elif self.hubspot == "Not in HubSpot":
            conds.append(F.col("in_hubspot") == F.lit(False))
        if self.state != "All" and "state" in columns:
            conds.append(F.col("state") == F.lit(self.state))
        # inclusive both ends; a null score fails the range
        conds.append(F.col("final_score").between(F.lit(float(self.score_min)), F.lit(float(self.score_max))))
        return reduce(lambda a, b: a & b, conds)


def apply_page_filter(df: DataFrame, spec: PageFilter) -> DataFrame:
    return df.filter(spec.predicate(df.columns))


@dataclass(frozen=True)
class FilterSpec:
    """Optional filters, each applied only if its column exists.
    A null boolean matches neither 'has' nor 'no'."""
    naics: str | tuple[str, ...] = "all"
    source: str = "all"
    channel: str = "all"
    research: str = "all"         # 'has_research' | 'no_research' | 'all'
    served: str = "all"           # 'served' | 'unserved' | 'all'


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    cols = set(df.columns)
    conds: list[Column] = []
    if "primary_naics" in cols and spec.naics != "all":
        if isinstance(spec.naics, (list, tuple)):
            conds.append(F.col("primary_naics").isin(*spec.naics))
        else:
            conds.append(F.col("primary_naics") == F.lit(spec.naics))
    if "source" in cols and spec.source != "all":
        conds.append(F.col("source") == F.lit(spec.source))
    if "channel_id" in cols and spec.channel != "all":
        conds.append(F.col("channel_id") == F.lit(spec.channel))
    if "has_research_doc" in cols:
        if spec.research == "has_research":
            conds.append(F.col("has_research_doc") == F.lit(True))
        elif spec.research == "no_research":
            conds.append(F.col("has_research_doc") == F.lit(False))
    if "is_served" in cols:
        if spec.served == "served":
            conds.append(F.col("is_served") == F.lit(True))
        elif spec.served == "unserved":
            conds.append(F.col("is_served") == F.lit(False))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def filter_by_served_status(df: DataFrame, served_filter: str) -> DataFrame:
    """P4: 'all' | 'served' | 'unserved'; anything else -> all."""
    if served_filter == "served":
        return df.filter(F.col("is_served") == F.lit(True))
    if served_filter == "unserved":
        return df.filter(F.col("is_served") == F.lit(False))
    return df


def filter_by_source(df: DataFrame, source_filter: str) -> DataFrame:
    """P5: 'all' or equality."""
    return df if source_filter == "all" else df.filter(F.col("source") == F.lit(source_filter))


def search_industries(df: DataFrame, query: str, synonyms: dict | None = None,
                      code_col: str = "naics_code", text_cols: tuple[str, ...] = ("naics_description", "reasoning")) -> DataFrame:
    """All-digit query (after strip, H8) -> code prefix; otherwise
    any expanded term contained, case-insensitively and literally (H6), in
    any text column; null text never matches (H7)."""
    q = (query or "").strip()
    if not q:
        return df
    if q.isdigit():
        return df.filter(F.col(code_col).cast("string").startswith(q))
    terms = config.expand_search_query(q, synonyms)
    hits = [F.contains(F.lower(F.col(c)), F.lit(t)) for c in text_cols if c in df.columns for t in terms]
    pred = reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])
    return df.filter(pred)


def select_ids(df: DataFrame, ids: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows whose id is in a frame of ids (semi join; ids can be many)."""
    return df.join(ids.select(F.col(key).cast("string").alias(key)).distinct(), on=key, how="left_semi")


def researched_only(df: DataFrame) -> DataFrame:
    """``had_web_research`` is exactly True."""
    return df.filter(F.col("had_web_research") == F.lit(True))

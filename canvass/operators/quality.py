"""Data-quality gates (A10, A13-A18, J10) and ranking invariants.

Each gate is computed by aggregations over whole tables (one ``agg`` per
table where possible) and reported as rows of a small gate-report frame:
(gate, kind, subject, value, threshold, passed, detail). Only the report,
a handful of rows, ever reaches the driver (``run_startup_validation``).
Samples of offending ids are top-5 by id (``orderBy().limit(5)`` runs as a
per-partition top-k, never a whole group in one task).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import written
from .ranking import contiguous_rank

REPORT_SCHEMA = "gate string, kind string, subject string, value double, threshold double, passed boolean, detail string"


class DataQualityError(RuntimeError):
    """A blocking gate failed."""


def _row(gate: str, kind: str, subject: str, value: Column, threshold: float | None, passed: Column,
         detail: Column | None = None) -> list[Column]:
    return [F.lit(gate).alias("gate"), F.lit(kind).alias("kind"), F.lit(subject).alias("subject"),
            value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"),
            passed.cast("boolean").alias("passed"),
            (detail if detail is not None else F.lit(None).cast("string")).alias("detail")]


def critical_fields(df: DataFrame) -> list[str]:
    new = {"final_score", "scoring_path"} <= set(df.columns)
    return config.CRITICAL_FIELDS_NEW if new else config.CRITICAL_FIELDS_OLD


def field_completeness(df: DataFrame, fields: Sequence[str] | None = None,
                       threshold: float = config.COMPLETENESS_MIN) -> DataFrame:
    """Non-null share per critical field in ONE aggregation; a missing
    field is 0 % complete; an empty table fails (H16: the mean of nothing is
    not a pass)."""
    fields = list(fields or critical_fields(df))
    present = [f for f in fields if f in df.columns]
    aggs = [F.avg(F.col(f).isNotNull().cast("double")).alias(f"c{i}") for i, f in enumerate(present)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for f in fields:
        v = F.col(f"c{present.index(f)}") if f in present else F.lit(0.0)
        parts.append(F.struct(*_row("critical_field_completeness", "blocking", f, v, threshold,
                                    F.coalesce(v >= F.lit(threshold), F.lit(False)),
                                    F.when(F.lit(f not in present), F.lit("missing column")))))
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """A10 rows: every row whose id repeats (pandas ``duplicated(keep=False)``)."""
    return df.join(duplicate_keys(df, key).select(key), on=key, how="left_semi")


def duplicates_gate(df: DataFrame, key: str, subject: str) -> DataFrame:
    """A10 report row: duplicate rows, duplicate ids, sample of 5 ids."""
    d = duplicate_keys(df, key)
    stats = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
    sample = _sample_ids(d.select(F.col(key).cast("string").alias("id")))
    return _merge_rows(stats, sample).select(*_row(
        "no_duplicates", "blocking", subject, F.col("rows"), 0.0, F.col("rows") == 0,
        F.concat(F.col("keys").cast("string"), F.lit(" ids; sample: "), F.coalesce(F.col("sample"), F.lit("")))))


def _merge_rows(*frames: DataFrame) -> DataFrame:
    """Several one-row frames with distinct columns -> one row (union + max;
    no join between them)."""
    cols = [c for f in frames for c in f.columns]
    types = {c: t for f in frames for c, t in f.dtypes}
    parts = [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in cols])
             for f in frames]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _sample_ids(ids: DataFrame, k: int = 5) -> DataFrame:
    """Top-k ids (sorted) as one comma-joined string (a one-row frame)."""
    top = ids.orderBy("id").limit(k)
    return top.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))


def join_integrity_gate(scored: DataFrame, companies: DataFrame, buildings: DataFrame) -> DataFrame:
    """Scored ids and building company ids must all exist in companies."""
    comp = companies.select("company_id").distinct()
    out = []
    for subject, df in (("scored->companies", scored), ("buildings->companies", buildings)):
        missing = df.select("company_id").distinct().join(comp, on="company_id", how="left_anti")
        stats = missing.agg(F.count(F.lit(1)).alias("keys"))
        sample = _sample_ids(missing.select(F.col("company_id").alias("id")))
        out.append(_merge_rows(stats, sample).select(*_row(
            "join_integrity", "blocking", subject, F.col("keys"), 0.0, F.col("keys") == 0,
            F.concat(F.lit("sample: "), F.coalesce(F.col("sample"), F.lit(""))))))
    return out[0].unionByName(out[1])


def er_orphan_gate(er_log: DataFrame | None, threshold: float = config.ER_ORPHAN_MAX) -> DataFrame | None:
    """Share of ``match_type = 'unmatched'`` over all rows (null types
    count in the denominator); passes below 10 %. No log or no column ->
    rate 0, pass (returns ``None`` for the caller to fill)."""
    if er_log is None or "match_type" not in er_log.columns:
        return None
    rate = F.coalesce(F.avg(F.col("match_type").eqNullSafe(F.lit("unmatched")).cast("double")), F.lit(0.0))
    return er_log.agg(rate.alias("v")).select(*_row(
        "entity_resolution", "non_blocking", "entity_resolution_log", F.col("v"), threshold,
        F.col("v") < F.lit(threshold)))


class ErLog:
    """An entity-resolution log that is written once; A14 needs only the counts observed on the way."""

    def __init__(self, log: DataFrame):
        flag = F.col("match_type").eqNullSafe(F.lit("unmatched")) if "match_type" in log.columns else F.lit(False)
        self.rows, seen = written(log, "er_log", {"n_rows": F.count(F.lit(1)), "n_unmatched": F.count_if(flag)})
        self.n_rows, self.n_unmatched = seen["n_rows"], seen["n_unmatched"]

    def gate(self, threshold: float = config.ER_ORPHAN_MAX) -> DataFrame:
        """A14, as `er_orphan_gate` reports it."""
        rate = self.n_unmatched / self.n_rows if self.n_rows else 0.0
        return self.rows.sparkSession.createDataFrame(
            [("entity_resolution", "non_blocking", "entity_resolution_log", rate, threshold, rate < threshold, None)], REPORT_SCHEMA)


def coordinate_coverage_gate(buildings: DataFrame, threshold: float = config.COORD_COVERAGE_MIN) -> DataFrame:
    """Share of buildings with both latitude and longitude; 0 rows -> 0."""
    both = (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).cast("double")
    return buildings.agg(F.coalesce(F.avg(both), F.lit(0.0)).alias("v")).select(*_row(
        "coordinate_coverage", "non_blocking", "buildings", F.col("v"), threshold, F.col("v") >= F.lit(threshold)))


def research_coverage_gate(scored: DataFrame, threshold: float = config.RESEARCH_COVERAGE_MIN) -> DataFrame:
    """Share of companies with ``has_research_doc`` true (null = no);
    missing column -> 0, fail."""
    if "has_research_doc" not in scored.columns:
        v = F.lit(0.0)
        base = scored.agg(F.count(F.lit(1)).alias("n"))
    else:
        base = scored.agg(F.count(F.lit(1)).alias("n"),
                          F.count_if(F.col("has_research_doc") == F.lit(True)).alias("k"))
        v = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0))
    return base.select(*_row("research_coverage", "non_blocking", "scored", v, threshold, v >= F.lit(threshold)))


def weights_gate(weights: DataFrame | None, weight_col: str = "weight") -> DataFrame | None:
    """Weights (a table of weights, or a one-row ``weight_sum`` frame
    read from diagnostics) must sum to 1 within 0.001."""
    if weights is None:
        return None
    total = F.sum(weight_col) if weight_col in weights.columns else F.first("weight_sum")
    return weights.agg(total.alias("v")).select(*_row(
        "scoring_weights", "non_blocking", "weights", F.col("v"), 1.0,
        F.coalesce(F.abs(F.col("v") - F.lit(1.0)) <= F.lit(config.WEIGHT_SUM_TOLERANCE), F.lit(False))))


def table_gates(df: DataFrame, key: str, subject: str, fields: Sequence[str] = (),
                coordinates: bool = False, research: bool = False) -> DataFrame:
    """One keyed pass over a table for all of its own gates: per-key row
    counts and non-null counts (partial aggregation, one shuffle), then one
    global aggregation gives completeness (A13), duplicate rows / ids (A10),
    coordinate coverage (A15) and research coverage (A16). The 5 sample ids
    come from a top-k over the duplicate keys."""
    present = [f for f in fields if f in df.columns]
    per_key = [F.count(F.lit(1)).alias("n")]
    per_key += [F.count(F.col(f)).alias(f"nn{i}") for i, f in enumerate(present)]
    if coordinates:
        per_key.append(F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geo"))
    has_research = research and "has_research_doc" in df.columns
    if has_research:
        per_key.append(F.count_if(F.col("has_research_doc") == F.lit(True)).alias("res"))
    g = df.groupBy(key).agg(*per_key)
    total = F.sum("n")
    glob = [total.alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_rows"),
            F.count_if(F.col("n") > 1).alias("dup_keys")]
    glob += [(F.sum(f"nn{i}") / total).alias(f"c{i}") for i, _ in enumerate(present)]
    if coordinates:
        glob.append(F.coalesce(F.sum("geo") / total, F.lit(0.0)).alias("geo"))
    if has_research:
        glob.append(F.coalesce(F.sum("res") / total, F.lit(0.0)).alias("res"))
    stats = g.agg(*glob)
    sample = _sample_ids(g.where(F.col("n") > 1).select(F.col(key).cast("string").alias("id")))
    one = _merge_rows(stats, sample)
    rows = []
    for f in fields:
        v = F.col(f"c{present.index(f)}") if f in present else F.lit(0.0)
        rows.append(_row("critical_field_completeness", "blocking", f, v, config.COMPLETENESS_MIN,
                         F.coalesce(v >= F.lit(config.COMPLETENESS_MIN), F.lit(False)),
                         F.when(F.lit(f not in present), F.lit("missing column"))))
    dup = F.coalesce(F.col("dup_rows"), F.lit(0))
    rows.append(_row("no_duplicates", "blocking", subject, dup, 0.0, dup == 0,
                     F.concat(F.coalesce(F.col("dup_keys"), F.lit(0)).cast("string"), F.lit(" ids; sample: "),
                              F.coalesce(F.col("sample"), F.lit("")))))
    if coordinates:
        v = F.coalesce(F.col("geo"), F.lit(0.0))
        rows.append(_row("coordinate_coverage", "non_blocking", "buildings", v, config.COORD_COVERAGE_MIN,
                         v >= F.lit(config.COORD_COVERAGE_MIN)))
    if research:
        v = F.coalesce(F.col("res"), F.lit(0.0)) if has_research else F.lit(0.0)
        rows.append(_row("research_coverage", "non_blocking", "scored", v, config.RESEARCH_COVERAGE_MIN,
                         v >= F.lit(config.RESEARCH_COVERAGE_MIN)))
    # all gate rows of the table from ONE projection of the one-row frame
    return one.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


def gate_report(spark: SparkSession, scored: DataFrame, companies: DataFrame, buildings: DataFrame,
                er_log: DataFrame | ErLog | None = None, weights: DataFrame | None = None) -> DataFrame:
    """A18 as data: blocking gates (A13, A10, J10) then non-blocking (A14,
    A17, A15, A16), every gate computed; each table's own gates in one
    keyed pass (``table_gates``)."""
    parts = [table_gates(scored, "company_id", "scored.company_id", critical_fields(scored), research=True),
             table_gates(buildings, "building_id", "buildings.building_id", coordinates=True),
             join_integrity_gate(scored, companies, buildings)]
    er = er_log.gate() if isinstance(er_log, ErLog) else er_orphan_gate(er_log)
    parts.append(er if er is not None else spark.createDataFrame(
        [("entity_resolution", "non_blocking", "entity_resolution_log", 0.0, config.ER_ORPHAN_MAX, True, "no log")],
        REPORT_SCHEMA))
    wg = weights_gate(weights)
    parts.append(wg if wg is not None else spark.createDataFrame(
        [("scoring_weights", "non_blocking", "weights", None, 1.0, False, "diagnostics not found")], REPORT_SCHEMA))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_startup_validation(spark: SparkSession, scored: DataFrame, companies: DataFrame, buildings: DataFrame,
                           er_log: DataFrame | None = None, weights: DataFrame | None = None) -> dict:
    """Compute the report (a few rows to the driver), raise on the first
    failing blocking gate in order, return the non-blocking results."""
    # the gates need ids and flags only: each table is scanned once, and that much of it is written
    fields = [f for f in critical_fields(scored) if f in scored.columns]
    flags = [c for c in ("final_score", "scoring_path", "has_research_doc") if c in scored.columns]
    kept = [written(scored.select(*dict.fromkeys(["company_id", *fields, *flags])), "gate-scored")[0],
            written(companies.select("company_id"), "gate-companies")[0],
            written(buildings.select("building_id", "company_id", "latitude", "longitude"), "gate-buildings")[0]]
    report = [r.asDict() for r in gate_report(spark, *kept, er_log, weights).collect()]
    order = ["critical_field_completeness", "no_duplicates", "join_integrity"]
    results = {"blocking_gates": {}, "non_blocking_gates": {}}
    for gate in order:
        for r in [x for x in report if x["gate"] == gate]:
            if not r["passed"]:
                results["blocking_gates"][gate] = f"FAIL: {r['subject']} {r['value']} {r['detail'] or ''}"
                raise DataQualityError(f"BLOCKING: {gate} failed for {r['subject']} "
                                       f"(value {r['value']}, threshold {r['threshold']}) {r['detail'] or ''}")
        results["blocking_gates"][gate] = "PASS"
    for r in report:
        if r["kind"] == "non_blocking":
            results["non_blocking_gates"][r["gate"]] = {"value": r["value"], "passed": r["passed"],
                                                        "detail": r["detail"]}
    return results


# ------------------------------------------------------------ rank invariants

def rank_contiguity_violations(df: DataFrame, segment_col: str = "primary_naics", rank_col: str = "rank") -> DataFrame:
    """Per segment, the sorted distinct ranks must be exactly 1..k (and
    no rank null). One aggregation; returns the violating segments."""
    g = df.groupBy(segment_col).agg(F.min(rank_col).alias("min_rank"), F.max(rank_col).alias("max_rank"),
                                    F.count_distinct(rank_col).alias("distinct_ranks"),
                                    F.count_if(F.col(rank_col).isNull()).alias("null_ranks"))
    ok = (F.col("min_rank") == 1) & (F.col("max_rank") == F.col("distinct_ranks")) & (F.col("null_ranks") == 0)
    return g.where(~F.coalesce(ok, F.lit(False)))


def rank_order_violations(df: DataFrame, segment_col: str = "primary_naics", score_col: str = "final_score",
                          rank_col: str = "rank", id_col: str = "company_id",
                          strategy: str = "distributed") -> DataFrame:
    """The rank must equal the position in (score desc, rank asc, id)
    order within the segment; returns the mismatching rows."""
    order = [F.col(score_col).desc_nulls_last(), F.col(rank_col).asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    exp = contiguous_rank(df.select(segment_col, id_col, score_col, rank_col), [segment_col], order,
                          "expected_rank", strategy=strategy)
    return exp.where(~F.col(rank_col).eqNullSafe(F.col("expected_rank")))

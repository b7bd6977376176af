"""Scoring formulas (F1-F12) and target rules.

All formulas are column expressions, so a scoring pass is one projection in
one codegen stage. Where the original only states anchors (F9, F10), the cap
is a parameter and the docstring says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .joins import small_side
from .ranking import cap_per_group


def neutral(c: Column) -> Column:
    """a missing component scores the neutral 50."""
    return F.coalesce(c, F.lit(config.NEUTRAL_COMPONENT))


def weighted_sum(parts: list[tuple[float, Column]]) -> Column:
    """Left-to-right weighted sum of (weight, component)."""
    total = None
    for w, c in parts:
        term = F.lit(float(w)) * c
        total = term if total is None else total + term
    return total


def naics_attractiveness(icp_fit: Column, market_size: Column, revenue_concentration: Column,
                         building_count: Column, revenue_per_building: Column, churn_health: Column,
                         ticket_health: Column) -> Column:
    """.25 ICP + .15 market + .15 revenue conc. + .20 buildings + .05 rev/building
    + .15 churn + .05 tickets; missing components are neutral (F5)."""
    w = config.NAICS_WEIGHTS
    return weighted_sum([(w["icp_fit"], neutral(icp_fit)), (w["market_size"], neutral(market_size)),
                         (w["revenue_concentration"], neutral(revenue_concentration)),
                         (w["building_count"], neutral(building_count)),
                         (w["revenue_per_building"], neutral(revenue_per_building)),
                         (w["churn_health"], neutral(churn_health)), (w["ticket_health"], neutral(ticket_health))])


def prospect_opportunity(icp_fit: Column, buildings: Column, revenue: Column, employees: Column,
                         contacts: Column) -> Column:
    """.50 ICP + .20 buildings + .15 revenue + .10 employees + .05 contacts."""
    w = config.PROSPECT_WEIGHTS
    return weighted_sum([(w["icp_fit"], neutral(icp_fit)), (w["buildings"], neutral(buildings)),
                         (w["revenue"], neutral(revenue)), (w["employees"], neutral(employees)),
                         (w["contacts"], neutral(contacts))])


def customer_opportunity(expansion: Column, churn: Column, profitability: Column, tickets: Column) -> Column:
    """.40 expansion + .30 churn + .20 profitability + .10 tickets."""
    w = config.CUSTOMER_WEIGHTS
    return weighted_sum([(w["expansion"], neutral(expansion)), (w["churn"], neutral(churn)),
                         (w["profitability"], neutral(profitability)), (w["tickets"], neutral(tickets))])


def final_score(is_customer: Column, naics_score: Column, company_score: Column) -> Column:
    """customers use the company score alone (H21); prospects .4 NAICS + .6 company."""
    return F.when(is_customer == F.lit(True), company_score).otherwise(
        F.lit(config.FINAL_NAICS_WEIGHT) * naics_score + F.lit(config.FINAL_COMPANY_WEIGHT) * company_score)


def market_size_score(count: Column) -> Column:
    """log scale, 1 location -> 0, 100,000+ -> 100; <= 0 or null -> null."""
    n = count.cast("double")
    raw = F.lit(100.0) * F.ln(n) / F.lit(float(math.log(config.MARKET_SIZE_FULL)))
    return F.when(n > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def profitability_score(margin: Column) -> Column:
    """margin 0-40 % -> 0-100 linear, clamped."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), margin / F.lit(config.PROFIT_MARGIN_FULL) * F.lit(100.0)))


def contact_score(contacts: Column) -> Column:
    """F8: has contacts 75, none 25."""
    return F.when(F.coalesce(contacts, F.lit(0)) > 0, F.lit(config.CONTACT_SCORE_HAS)) \
            .otherwise(F.lit(config.CONTACT_SCORE_NONE))


def log_scale(x: Column, cap: float) -> Column:
    """0..cap on a log scale (log1p(x) / log1p(cap) * 100, clamped).
    The original gives only anchors (and conflicting ones for employees), so
    ``cap`` is a caller parameter."""
    v = x.cast("double")
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) * F.log1p(F.greatest(v, F.lit(0.0)))
                                         / F.lit(float(math.log1p(cap))))))


def anchored_log(x: Column, anchors: tuple[tuple[float, float], tuple[float, float]]) -> Column:
    """The log scale through two stated examples ((value, score), (value, score)), clamped to
    0..100; a value that is not positive scores 0, null stays null."""
    (x0, s0), (x1, s1) = anchors
    v = x.cast("double")
    slope = (s1 - s0) / (math.log(x1) - math.log(x0))
    raw = F.lit(float(s0)) + F.lit(float(slope)) * (F.ln(v) - F.lit(float(math.log(x0))))
    return F.when(v > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))).when(v.isNotNull(), F.lit(0.0))


def revenue_concentration_score(revenue: Column, total_revenue: Column) -> Column:
    """an industry's percentage of all revenue (1 % -> 37, 5 % and more -> 100)."""
    share = F.try_divide(F.lit(100.0) * revenue.cast("double"), total_revenue.cast("double"))
    return anchored_log(share, config.REVENUE_CONCENTRATION_ANCHORS)


def building_count_score(served: Column) -> Column:
    """served buildings of an industry (11 -> 63, 164 and more -> 100)."""
    return anchored_log(served, config.BUILDING_COUNT_ANCHORS)


def revenue_per_building_score(per_building: Column, median: Column) -> Column:
    """average revenue per building against the median: 50 at the median, on the line of the stated examples."""
    ratio = F.try_divide(per_building.cast("double"), median.cast("double"))
    even = config.REVENUE_PER_BUILDING_EVEN
    return anchored_log(ratio, tuple((v / even, s) for v, s in config.REVENUE_PER_BUILDING_ANCHORS))


def buildings_score(locations: Column) -> Column:
    """a company's locations (11 -> 50, 100 and more -> 100)."""
    return anchored_log(locations, config.COMPANY_BUILDINGS_ANCHORS)


def revenue_score(revenue: Column) -> Column:
    """annual revenue ($24M -> 83, $250M and more -> 100)."""
    return anchored_log(revenue, config.COMPANY_REVENUE_ANCHORS)


def employees_score(employees: Column) -> Column:
    """employee count; both stated examples (75 and 3,200) score 100."""
    return log_scale(employees, config.COMPANY_EMPLOYEES_FULL)


def expansion_score(total_buildings: Column, served_buildings: Column, revenue_per_building: Column, cap: float) -> Column:
    """F3 expansion opportunity: unpenetrated buildings x revenue potential of each, log-scaled up to ``cap``
    (the original states the product, not its scale)."""
    open_buildings = F.when(total_buildings.isNotNull(), F.greatest(total_buildings - F.coalesce(served_buildings, F.lit(0)), F.lit(0)))
    return log_scale(open_buildings.cast("double") * revenue_per_building.cast("double"), cap)


def weights_frame(spark: SparkSession, channels: dict | None = None) -> DataFrame:
    """F11 overrides as a tiny frame (channel, component, weight)."""
    rows = []
    for ch, spec in (channels or config.CHANNELS).items():
        for comp, w in (spec.get("score_weights_override") or {}).items():
            rows.append((ch, comp, float(w)))
    return spark.createDataFrame(rows, "channel_id string, component string, weight double")


def channel_weights(spark: SparkSession, channels: dict | None = None, base: dict[str, float] | None = None) -> DataFrame:
    """(channel, component, base, override, weight): every component of every channel, the override before the base."""
    channels = config.CHANNELS if channels is None else channels
    base = config.BASE_CHANNEL_WEIGHTS if base is None else base
    every = spark.createDataFrame([(ch, comp, float(w)) for ch in channels for comp, w in base.items()],
                                  "channel_id string, component string, base_weight double")
    over = weights_frame(spark, channels).withColumnRenamed("weight", "override_weight")
    return every.join(over, ["channel_id", "component"], "full").withColumn("weight", F.coalesce("override_weight", "base_weight"))


def weights_valid(weight_sum: Column) -> Column:
    """|sum - 1| <= 0.001."""
    return F.abs(weight_sum - F.lit(1.0)) <= F.lit(config.WEIGHT_SUM_TOLERANCE)


# ------------------------------------------------------------------ targets

def channel_table(spark: SparkSession, channels: dict | None = None) -> DataFrame:
    """J13 lookup rows: (prefix, channel_id, priority) from the channel config."""
    rows = [(code, ch, spec.get("priority")) for ch, spec in (channels or config.CHANNELS).items()
            for code in spec["naics_codes"]]
    return spark.createDataFrame(rows, "prefix string, channel_id string, channel_priority string")


#: Prefixes of the channel config that are tested one by one.
MAX_CHANNEL_CODES = 10_000


def channel_prefix_lengths() -> list[int]:
    """Prefix lengths of the configured channel codes (driver-side config)."""
    return sorted({len(code) for spec in config.CHANNELS.values() for code in spec["naics_codes"]})


def assign_channel(df: DataFrame, channels: DataFrame, code_col: str = "primary_naics",
                   prefix_lengths: list[int] | None = None, default_channel: str = config.DEFAULT_CHANNEL) -> DataFrame:
    """Longest matching NAICS prefix wins, else the default channel.

    The channel config (up to MAX_CHANNEL_CODES prefixes, checked) becomes one
    ``isin`` test per prefix length and channel, so no row is shuffled on its
    code. A prefix listed for two channels goes to the smaller channel id.
    """
    base = df.drop("channel_id") if "channel_id" in df.columns else df
    rows = channels.select("prefix", "channel_id").limit(MAX_CHANNEL_CODES + 1).collect()
    if len(rows) > MAX_CHANNEL_CODES:
        raise ValueError(f"more than {MAX_CHANNEL_CODES} channel codes; this is a config table")
    lengths = set(prefix_lengths) if prefix_lengths is not None else {len(r["prefix"]) for r in rows}
    by_length: dict[tuple[int, str], list[str]] = {}
    for r in rows:
        if len(r["prefix"]) in lengths:
            by_length.setdefault((len(r["prefix"]), r["channel_id"]), []).append(r["prefix"])
    code, channel = F.col(code_col).cast("string"), None
    for (n, name), prefixes in sorted(by_length.items(), key=lambda x: (-x[0][0], x[0][1])):
        hit = F.substring(code, 1, n).isin(prefixes)
        channel = F.when(hit, F.lit(name)) if channel is None else channel.when(hit, F.lit(name))
    default = F.lit(default_channel)
    return base.withColumn("channel_id", default if channel is None else channel.otherwise(default))


def sqft_table(spark: SparkSession, codes: list[tuple] | None = None) -> DataFrame:
    """J14 lookup: code -> range, min, max, include (8 rows in the config)."""
    return spark.createDataFrame(
        [(c, r, lo, hi, inc) for c, r, lo, hi, inc in (codes or config.SQFT_CODES)],
        "square_footage_code string, sqft_range string, sqft_min int, sqft_max int, sqft_include boolean")


def apply_sqft_rule(buildings: DataFrame, codes: DataFrame, place_type_col: str | None = None) -> DataFrame:
    """P16 + J14: keep codes 4-8 (>= 5,000 sq ft); headquarters always kept;
    a null or unknown code is kept and flagged (the rule only says "handle
    gracefully")."""
    j = buildings.join(small_side(codes), on="square_footage_code", how="left")
    hq = (F.col(place_type_col) == F.lit("headquarters")) if place_type_col else F.lit(False)
    keep = hq | F.coalesce(F.col("sqft_include"), F.lit(True))
    return j.withColumn("sqft_unknown", F.col("sqft_include").isNull()).filter(keep)


def targets_table(spark: SparkSession, targets: list[tuple[str, int]] | None = None) -> DataFrame:
    """W6 / P17 lookup: 4-digit code -> max companies (39 rows in the config)."""
    return spark.createDataFrame(targets or config.NAICS_TARGETS, "naics_4digit string, max_companies int")


def target_industries(df: DataFrame, targets: DataFrame, code_col: str = "naics_4digit",
                      branch_col: str | None = None) -> DataFrame:
    """Keep listed 4-digit industries (broadcast semi join of 39 codes)
    and, when a branch count is given, multi-location companies only."""
    out = df.join(small_side(targets.select(F.col("naics_4digit").alias(code_col))), on=code_col, how="left_semi")
    return out.filter(F.col(branch_col) > 0) if branch_col else out


def six_digit_targets(df: DataFrame, codes: list[str] | None = None, code_col: str = "primary_naics",
                      branch_col: str | None = None) -> DataFrame:
    """P17 by six digits: companies whose code starts with a listed one, multi-location only if a branch count is given."""
    out = df.filter(F.substring(F.col(code_col).cast("string"), 1, 6).isin(config.TARGET_SIX_DIGIT if codes is None else codes))
    return out.filter(F.col(branch_col) > 0) if branch_col else out


def cap_industries(df: DataFrame, targets: DataFrame, order_cols: list[Column], code_col: str = "naics_4digit",
                   most: int | None = None) -> DataFrame:
    """At most ``max_companies`` per industry in the given order (the
    original does not state the order; callers pass one, e.g. size desc, id).
    ``most`` is the largest cap of the config; without it one small aggregation reads it."""
    if most is None:
        most = targets.agg(F.max("max_companies")).first()[0] or 0  # one value of a config table
    j = df.join(small_side(targets.withColumnRenamed("naics_4digit", code_col)), on=code_col, how="inner")
    return cap_per_group(j, code_col, "max_companies", order_cols, most)


def research_eligible(locations: Column, revenue: Column, employees: Column) -> Column:
    """5+ locations AND ($10M+ revenue OR 100+ employees); the AND binds
    the whole OR (the text is ambiguous, this reading is documented)."""
    return (F.coalesce(locations, F.lit(0)) >= 5) & (
        (F.coalesce(revenue, F.lit(0.0)) >= F.lit(10_000_000.0)) | (F.coalesce(employees, F.lit(0)) >= 100))

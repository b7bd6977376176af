"""Display formatting, tiers and fallbacks (D8-D19, D27, P18) as column
expressions: no Python per row, everything stays in generated code.

Number formatting follows Python: ``fixed`` rounds half-even on the exact
binary value (``py_round``), where Spark's ``format_string`` would round the
shortest decimal form half up. Numbers stay numeric wherever the original
kept them numeric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from .text import title_case

# FIXED VALUES: null placeholders by field
NULL_DISPLAY = {
    "employees": "N/A",
    "revenue": "N/A",
    "square_footage": "Unknown",
    "contact_notes": "(No notes)",
    "churn_probability": "Not predicted",
    "augmented_score": "Pending",
}
# FIXED VALUES: display badges and labels
SOURCE_BADGES = {"dataaxle": "🔵 DataAxle", "manual": "🟢 Manual"}
DASH = "—"
RISK_MESSAGES = {
    "High": "🚨 **High Risk**: This customer is at high risk of churn. Immediate action recommended.",
    "Medium": "⚠️ **Medium Risk**: Monitor this customer closely for signs of dissatisfaction.",
    "Low": "✅ **Low Risk**: This customer appears stable.",
}
COMPONENTS_0_1 = [("icp_fit_score", "ICP Fit Score"), ("expansion_potential", "Expansion Potential"),
                  ("decision_maker_clarity", "Decision Maker Clarity"), ("hygiene_relevance", "Hygiene Relevance"),
                  ("revenue_potential", "Revenue Potential"), ("buyer_intent", "Buyer Intent"),
                  ("geographic_fit", "Geographic Fit")]


def py_round(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals half-even on its exact binary
    value, as Python's ``format(x, '.Nf')`` and C ``printf`` do; returns a
    decimal. Spark's own rounding works on the shortest decimal form, which
    differs on ties such as 31.25 (exact) or 2.675 (binary just below).

    Only when the shortest form is itself a tie is the exact side needed:
    then the sign of ``x * 2*10^d - k`` decides, taken from the rounded
    product when it differs from ``k`` (rounding is monotonic) and otherwise
    from the exact product error ``Math.fma(x, s, -p)`` (rare rows only).
    """
    scale = 2 * 10 ** digits
    rep = x.try_cast("decimal(38,18)")                  # shortest decimal form
    twice = rep * F.lit(scale)
    k = F.floor(twice)
    repr_tie = (twice == k) & (F.pmod(k, F.lit(2)) == F.lit(1))
    s = F.lit(float(scale))
    p = x * s
    zero = F.lit(0.0)
    err = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.coalesce(x, zero), s,
                    F.coalesce(-p, zero)).cast("double")
    above = F.when(p != k.cast("double"), p > k.cast("double")).otherwise(err > 0)
    below = F.when(p != k.cast("double"), p < k.cast("double")).otherwise(err < 0)
    half = F.lit(5).cast("decimal(38,18)") / F.lit(10 ** (digits + 1))
    out = (F.when(repr_tie & above, rep + half)
            .when(repr_tie & below, rep - half)
            .otherwise(F.bround(rep, digits)))
    # from 1e20 on a double is a whole number (null beyond 38 digits, NaN and infinity)
    return F.coalesce(out.cast(f"decimal(38,{digits})"), x.try_cast(f"decimal(38,{digits})"))


def fixed(x: Column, digits: int, grouping: bool = False) -> Column:
    """Python ``f'{x:.Nf}'`` / ``f'{x:,.Nf}'`` for a double column (null,
    NaN -> null)."""
    v = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    r = py_round(v, digits)
    text = F.format_number(r, digits) if grouping else r.cast("string")
    # Python keeps the sign of a negative value that rounds to zero ('-0.0'),
    # negative zero itself included (its text form starts with '-')
    negative = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
    return F.when(negative & (r == 0), F.concat(F.lit("-"), text)).otherwise(text)


def is_null(c: Column, dtype: T.DataType | None = None) -> Column:
    """None, NaN, or blank text."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (F.trim(c) == F.lit(""))
    return c.isNull()


def as_number(c: Column) -> Column:
    """Text or number -> double; non-numeric or NaN -> null (a no-op cast
    for double columns)."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def format_score(c: Column, max_val: float = 100.0) -> Column:
    """2 decimals for 0-1 scales, 1 decimal otherwise; null -> 'N/A'."""
    return F.coalesce(fixed(as_number(c), 2 if max_val <= 1.0 else 1), F.lit("N/A"))


def format_percentage(c: Column) -> Column:
    return F.coalesce(F.concat(fixed(as_number(c), 1), F.lit("%")), F.lit("N/A"))


def format_confidence(c: Column) -> Column:
    """0-1 -> whole percent, rounded half even like Python ``round``."""
    return F.coalesce(F.concat(F.bround(as_number(c) * F.lit(100.0), 0).cast("long").cast("string"), F.lit("%")),
                      F.lit("N/A"))


def format_score_with_confidence(score: Column, confidence: Column) -> Column:
    s = fixed(as_number(score), 1)
    k = F.bround(as_number(confidence) * F.lit(100.0), 0).cast("long").cast("string")
    return F.coalesce(F.concat(s, F.lit(" ("), k, F.lit("% confidence)")), s, F.lit("N/A"))


def format_icp_fit_score(score: Column, basis: Column) -> Column:
    v = as_number(score)
    label = title_case(F.replace(basis, F.lit("_"), F.lit(" ")))
    return (F.when(v.isNull() & (basis == F.lit("no_data")), F.lit("N/A (no data)"))
             .when(v.isNull() & (basis == F.lit("partial")), F.lit("N/A (partial data)"))
             .when(v.isNull(), F.lit("N/A"))
             .when(basis.isNotNull() & (basis != F.lit("")),
                   F.concat(fixed(v, 2), F.lit(" ("), label, F.lit(")")))
             .otherwise(fixed(v, 2)))


def format_large_number(c: Column, field: str | None = None) -> Column:
    """Thousands separators; whole numbers without decimals, else 1 decimal."""
    v = as_number(c)
    placeholder = NULL_DISPLAY.get(field, "N/A") if field else "N/A"
    return (F.when(v.isNull(), F.lit(placeholder))
             .when(v == F.floor(v), fixed(v, 0, grouping=True))
             .otherwise(fixed(v, 1, grouping=True)))


def format_nullable_field(c: Column, field: str) -> Column:
    text = c.cast("string")
    return F.when(c.isNull() | (F.trim(text) == F.lit("")) | (F.lower(text) == F.lit("nan")),
                  F.lit(NULL_DISPLAY.get(field, "N/A"))).otherwise(text)


# -------------------------------------------------------------------- tiers

def tier_80_60(score: Column) -> Column:
    """D8 (industry list): green 80+, yellow 60+, else (a missing score too) red (hex colours)."""
    return F.when(score >= 80, F.lit("#28a745")).when(score >= 60, F.lit("#ffc107")) \
            .otherwise(F.lit("#dc3545"))


def tier_70_40(score: Column) -> Column:
    """D9 (badges): green 70+, yellow 40+, red below, gray when null."""
    v = as_number(score)
    return F.when(v.isNull(), F.lit("gray")).when(v >= 70, F.lit("green")).when(v >= 40, F.lit("yellow")) \
            .otherwise(F.lit("red"))


def marker_color(mode: str, is_customer: Column, has_research: Column, score: Column) -> Column:
    """By customer status, research status, or score 80/60/40."""
    if mode == "customer_status":
        return F.when(F.coalesce(is_customer, F.lit(False)), F.lit("green")).otherwise(F.lit("red"))
    if mode == "research_status":
        return F.when(F.coalesce(has_research, F.lit(False)), F.lit("blue")).otherwise(F.lit("gray"))
    if mode == "score_tier":
        s = F.coalesce(score, F.lit(0.0))
        return (F.when(s >= 80, F.lit("green")).when(s >= 60, F.lit("gold")).when(s >= 40, F.lit("orange"))
                 .otherwise(F.lit("red")))
    return F.lit("blue")


def score_band(score: Column) -> Column:
    """Export bands 90/80/70/60; null -> 0 -> red."""
    s = F.coalesce(as_number(score), F.lit(0.0))
    return (F.when(s >= 90, F.lit("green")).when(s >= 80, F.lit("light_green")).when(s >= 70, F.lit("yellow"))
             .when(s >= 60, F.lit("orange")).otherwise(F.lit("red")))


def score_delta(augmented: Column, standard: Column) -> Column:
    """Augmented - standard when both present (null propagates)."""
    return as_number(augmented) - as_number(standard)


def format_delta(augmented: Column, standard: Column) -> Column:
    d = score_delta(augmented, standard)
    r = fixed(d, 1)
    return F.when(d.isNotNull(), F.when(d >= 0, F.concat(F.lit("+"), r)).otherwise(r))


def churn_risk_message(tier: Column) -> Column:
    """High / Medium / Low message, other tiers echoed."""
    m = F.create_map(*[x for k, v in RISK_MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[tier], F.concat(F.lit("Risk Tier: "), F.coalesce(tier, F.lit("None"))))


# ------------------------------------------------------------ projections

def growth_label(code: Column) -> Column:
    """D17 growth: code trimmed and upper-cased; unknown codes shown as is."""
    key = F.upper(F.trim(code.cast("string")))
    m = F.create_map(*[x for k, v in config.GROWTH_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(code.isNull(), F.lit(DASH)).otherwise(F.coalesce(m[key], key))


def code_text(c: Column) -> Column:
    """str(int(code)) for numeric codes ('0611' -> '611'), raw text otherwise."""
    n = c.cast("string").try_cast("double")
    return F.when(c.isNull(), F.lit(DASH)).when(n.isNotNull(), n.cast("long").cast("string")) \
            .otherwise(c.cast("string"))


def int_or_zero(c: Column) -> Column:
    return F.coalesce(as_number(c).try_cast("long"), F.lit(0)).cast("long")


def location(city: Column, state: Column) -> Column:
    return F.when(city.isNotNull() & state.isNotNull(), F.concat_ws(", ", city, state)).otherwise(F.lit(DASH))


def revenue_millions(c: Column) -> Column:
    v = as_number(c)
    return F.when(v.isNotNull() & (v > 0), fixed(v / F.lit(1_000_000.0), 1)).otherwise(F.lit(DASH))


def icp_display(c: Column) -> Column:
    v = as_number(c)
    return F.when(v.isNull(), F.lit(DASH)).otherwise(v.cast("long").cast("string"))


def check_mark(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("✅")).otherwise(F.lit(""))


def coordinates(lat: Column, lon: Column) -> Column:
    """D14: '%.4f, %.4f' when both convert to numbers, else 'N/A'."""
    a, b = as_number(lat), as_number(lon)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(fixed(a, 4), F.lit(", "), fixed(b, 4))).otherwise(F.lit("N/A"))


def employee_size(location_size: Column, employees: Column) -> Column:
    v = F.coalesce(as_number(location_size), as_number(employees))
    return F.when(v.isNull(), F.lit("N/A")).otherwise(v.cast("long").cast("string"))


def sales_text(sales: Column, corporate: Column, revenue: Column) -> Column:
    v = F.coalesce(as_number(sales), as_number(corporate), as_number(revenue))
    return F.when(v.isNull(), F.lit("N/A")).otherwise(F.concat(F.lit("$"), fixed(v, 0, grouping=True)))


def fallback(*cols: Column, default: str = "N/A") -> Column:
    """First non-blank of the given columns, else the default."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != F.lit(""), c.cast("string")) for c in cols],
                      F.lit(default))


def source_badge(source: Column) -> Column:
    m = F.create_map(*[x for k, v in SOURCE_BADGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[source], source)


def flag_count(c: Column, icon: str) -> Column:
    """D18: '🚨 2' / '✅ 3' when > 0, else '—'."""
    return F.when(F.coalesce(c, F.lit(0)) > 0, F.concat(F.lit(icon + " "), c.cast("string"))).otherwise(F.lit(DASH))


def percent_or_dash(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(fixed(c, 1), F.lit("%"))).otherwise(F.lit(DASH))


def score_components_long(df: DataFrame, id_col: str = "company_id") -> DataFrame:
    """The 0-1 component scores present in ``df`` as (id, component,
    value x 100) rows, nulls skipped (one ``stack`` projection)."""
    present = [(c, label) for c, label in COMPONENTS_0_1 if c in df.columns]
    if not present:
        return df.select(F.col(id_col), F.lit(None).cast("string").alias("component"),
                         F.lit(None).cast("double").alias("value")).where(F.lit(False))
    args = ", ".join(f"'{label}', CAST(`{c}` AS DOUBLE)" for c, label in present)
    return (df.select(F.col(id_col), F.expr(f"stack({len(present)}, {args}) AS (component, raw)"))
              .where(F.col("raw").isNotNull())
              .select(id_col, "component", (F.col("raw") * F.lit(100.0)).alias("value")))


def contacts_display(df: DataFrame) -> DataFrame:
    """D16 (contacts): count 0 when missing, text fields 'N/A'."""
    return df.select(F.coalesce(F.col("contact_count"), F.lit(0)).cast("int").alias("Contact Count"),
                     F.coalesce(F.col("contact_names"), F.lit("N/A")).alias("Contact Names"),
                     F.coalesce(F.col("contact_emails"), F.lit("N/A")).alias("Contact Emails"),
                     F.coalesce(F.col("last_contact_date"), F.lit("N/A")).alias("Last Contact"))


def buildings_display(df: DataFrame) -> DataFrame:
    """D16 (buildings): served label, square feet with separators or 'N/A'."""
    sq = F.col("square_footage") if "square_footage" in df.columns else F.col("square_footage_code")
    return df.select(
        F.col("city").alias("City") if "city" in df.columns else F.lit(None).cast("string").alias("City"),
        F.col("state").alias("State") if "state" in df.columns else F.lit(None).cast("string").alias("State"),
        F.when(F.coalesce(F.col("is_served"), F.lit(False)), F.lit("✅ Served")).otherwise(F.lit("❌ Unserved"))
         .alias("Status"),
        F.coalesce(F.format_number(as_number(sq).cast("long"), 0), F.lit("N/A")).alias("Square Feet"))


def old_format_display(df: DataFrame, penetration: DataFrame | None = None) -> DataFrame:
    """Display rows of an old-format scored table already sorted and
    given a ``global_rank`` (W2): segment rank, channel, path, score text,
    flag icons, research mark, penetration, buildings, source badge. The
    score is kept numeric beside its text so sorting stays numeric (H5)."""
    cols = set(df.columns)
    if penetration is not None and "penetration_rate" not in cols:
        df = df.join(penetration.select("company_id", "penetration_rate"), on="company_id", how="left")
        cols.add("penetration_rate")

    def opt(c, default=None):
        return F.col(c) if c in cols else F.lit(default)

    score = F.col("final_score") if "final_score" in cols else F.col("augmented_score")
    seg = F.col("segment_rank") if "segment_rank" in cols else F.col("rank")
    bcol = "building_count" if "building_count" in cols else ("location_employee_size"
                                                                 if "location_employee_size" in cols else None)
    # The numeric score, then the rank, which is total
    df = df.orderBy(score.desc_nulls_last(), F.col("global_rank"))
    return df.select(
        "company_id", F.col("global_rank").alias("global_rank"), seg.alias("segment_rank"),
        F.col("company_name").alias("company"),
        F.coalesce(opt("scoring_path"), F.lit("Prospect")).alias("scoring_path"),
        F.coalesce(opt("channel_id"), F.lit("N/A")).alias("channel"),
        score.alias("score"), F.coalesce(fixed(score, 1), F.lit(DASH)).alias("score_text"),
        flag_count(opt("urgent_flags"), "🚨").alias("urgent"),
        flag_count(opt("action_flags"), "✅").alias("action"),
        F.when(F.coalesce(opt("has_research_doc"), F.lit(False)), F.lit("📄")).otherwise(F.lit(DASH)).alias("research"),
        percent_or_dash(opt("penetration_rate")).alias("penetration"),
        (int_or_zero(F.col(bcol)) if bcol else F.lit(0)).alias("buildings"),
        (source_badge(F.col("source")) if "source" in cols else F.lit(SOURCE_BADGES["dataaxle"])).alias("source"))

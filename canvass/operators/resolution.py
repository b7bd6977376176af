"""Entity resolution (J11 exact, J12 fuzzy street, A14 via the log).

Exact (J11): equi join on the normalised address key (number, street, city,
state, zip); several registry hits -> the smallest registry id.

Fuzzy (J12), for CRM records without an exact hit: the same block (state,
city, number) and a street similarity of at least ``threshold`` percent,
where similarity = 100 * (1 - levenshtein / longer length). Comparing every
pair inside a block would blow up on a hot block, so candidates come from
*prefix filtering* over padded bigrams, which is exact (no pair above the
threshold is lost):

* a pair within edit distance d shares at least (max bigrams) - 2d bigrams
  (each edit destroys at most 2 bigrams); for a string of n characters
  every partner has n' in [0.9 n, n / 0.9], which bounds d and gives a
  least overlap ``tau`` for the string;
* under one fixed total order of the bigrams (their hash), two strings that
  share ``tau`` bigrams share one of their first (|grams| - tau + 1) bigrams;
* so each street emits only its prefix bigrams, streets meet by an equi
  join on (block, bigram), and every candidate is verified with the
  built-in ``levenshtein``. Best match by similarity, then the smallest
  registry id (an aggregation, not a window).

Streets, not records, are compared: each side is first reduced to its distinct
(block, street), the registry with its smallest id, and the result is joined
back to the CRM records. An address that a third of all rows share is one
street, hence one pair. A blank component is null and matches nothing.

Below a threshold of 50 % two streets may share no bigram at all, so ``resolve``
refuses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .ranking import first_per_key

PAD_START, PAD_END = "^", "$"
MATCH_EXACT = "exact_address_components"
MATCH_FUZZY = "fuzzy_street_name"
MATCH_NONE = "unmatched"
#: Least street similarity for which the prefix filter is exact.
MIN_THRESHOLD = 50.0


def normalize_text(c: Column) -> Column:
    """lower, non-alphanumerics -> one space, trimmed; nothing left -> null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(""))


def normalize_address(df: DataFrame, id_col: str, extra: list[str] | None = None) -> DataFrame:
    return df.select(F.col(id_col).alias("rid"), *[F.col(x) for x in (extra or [])],
                     normalize_text(F.col("street_number").cast("string")).alias("n_number"),
                     normalize_text(F.col("street")).alias("n_street"),
                     normalize_text(F.col("city")).alias("n_city"),
                     normalize_text(F.col("state")).alias("n_state"),
                     normalize_text(F.col("zip").cast("string")).alias("n_zip"))


def _grams(street: Column) -> Column:
    padded = F.concat(F.lit(PAD_START), street, F.lit(PAD_END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))


def _prefix_len(n: Column, threshold: float) -> Column:
    """Leading tokens a street of n characters must index.

    A valid partner is at most L = floor(n / t) long and differs by at most
    d = floor(L * (1 - t)) edits; each edit touches at most two bigram
    occurrences, so the shared occurrences are at least tau = n + 1 - 2d
    (>= 1 for t >= 0.5); index |grams| - tau + 1 tokens. Integer arithmetic
    in basis points: a float (1-t)/t would round 9 * 0.111.. down to 0."""
    bp = int(round(threshold * 100))                      # 90.0 -> 9000
    longest = F.floor((n * F.lit(10000)) / F.lit(bp))      # exact for integer n
    d = F.floor((longest * F.lit(10000 - bp)) / F.lit(10000))
    tau = n + F.lit(1) - F.lit(2) * d
    grams = n + F.lit(1)
    return F.when(tau >= 1, grams - tau + F.lit(1)).otherwise(grams)


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - levenshtein / longer length); two empty strings -> 100."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - F.levenshtein(a, b) / longer) * F.lit(100.0))


def resolve(crm: DataFrame, registry: DataFrame, crm_id: str = "hubspot_id", crm_type: str = "hubspot_type",
            registry_id: str = "dataaxle_id", threshold: float = 90.0) -> DataFrame:
    """ER log: one row per CRM record (hubspot_id, hubspot_type, dataaxle_id,
    match_type, confidence_score)."""
    if threshold < MIN_THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {MIN_THRESHOLD}: similar streets need not share a bigram")
    # both inputs are read by several steps (exact join, anti join, bigram
    # statistics, prefix join, final join): normalise each once and cut the
    # lineage (narrow rows: id + five short fields), so a derived input is
    # not recomputed per step and a lost executor does not redo the scans
    c = reliable_checkpoint(normalize_address(crm, crm_id, extra=[crm_type]))
    r = reliable_checkpoint(normalize_address(registry, registry_id))
    key = ["n_number", "n_street", "n_city", "n_state", "n_zip"]

    exact = (c.join(r.groupBy(*key).agg(F.min("rid").alias("reg")), on=key, how="inner")
              .groupBy(F.col("rid")).agg(F.min("reg").alias("reg")))
    exact = exact.select("rid", "reg", F.lit(MATCH_EXACT).alias("match_type"), F.lit(100.0).alias("confidence"))

    rest = c.drop(crm_type).join(exact.select("rid"), on="rid", how="left_anti")
    block = ["n_state", "n_city", "n_number"]

    place = [*block, "n_street"]
    streets = rest.select(*place).distinct()
    reg_streets = r.groupBy(*place).agg(F.min("rid").alias("reg"))

    def prefixed(df):
        # columns of their own, so that a lambda reads them and does not compute them once an item
        keyed = F.transform(_grams(F.col("n_street")), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("g")))
        rows = df.where(F.col("n_street").isNotNull()).withColumn("_sorted", F.array_sort(keyed))
        rows = rows.withColumn("_prefix", F.slice("_sorted", 1, _prefix_len(F.length("n_street"), threshold).cast("int"))).drop("_sorted")
        # k-th occurrence of a bigram is its own token (multiset overlap); equal ones are neighbours here
        tokens = F.transform("_prefix", lambda x, i: F.struct(
            x["g"].alias("g"), F.size(F.filter(F.slice("_prefix", 1, i + 1), lambda y: y["g"] == x["g"])).alias("k")))
        return rows.withColumn("t", F.explode(tokens)).withColumns({"g": F.col("t.g"), "k": F.col("t.k")}).drop("t", "_prefix")

    cand = (prefixed(streets).join(prefixed(reg_streets).withColumnRenamed("n_street", "reg_street"),
                                   on=[*block, "g", "k"], how="inner")
            .select(*place, "reg", "reg_street").distinct())
    scored = cand.withColumn("sim", similarity(F.col("n_street"), F.col("reg_street"))) \
                 .where(F.col("sim") >= F.lit(threshold))
    best = first_per_key(scored.select(*place, (-F.col("sim")).alias("neg_sim"), "reg", "sim"), place,
                         ["neg_sim", "reg"], ["reg", "sim"])
    fuzzy = (rest.join(best, on=place, how="inner").groupBy("rid")
             .agg(F.min(F.struct((-F.col("sim")).alias("neg_sim"), "reg")).alias("x"))
             .select("rid", "x.reg", F.lit(MATCH_FUZZY).alias("match_type"), F.round(-F.col("x.neg_sim"), 1).alias("confidence")))

    matched = exact.unionByName(fuzzy)
    base = c.select("rid", F.col(crm_type).alias("hubspot_type"))
    out = base.join(matched, on="rid", how="left")
    return out.select(F.col("rid").alias("hubspot_id"), "hubspot_type", F.col("reg").alias("dataaxle_id"),
                      F.coalesce(F.col("match_type"), F.lit(MATCH_NONE)).alias("match_type"),
                      F.col("confidence").cast("double").alias("confidence_score"))


def prefix_is_exact(threshold: float) -> bool:
    """Sanity bound used by tests: the least overlap stays positive."""
    bp = int(round(threshold * 100))
    return all(n + 1 - 2 * ((n * 10000 // bp) * (10000 - bp) // 10000) >= 1 for n in range(0, 500))

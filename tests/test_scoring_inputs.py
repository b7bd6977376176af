"""Exact group medians and the scores on the stated anchors."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from canvass import config
from canvass.operators import medians, scoring


@pytest.mark.parametrize("bits", [7, 16])
def test_group_medians_equal_sorting(spark, bits):
    """Negative and repeated values, odd and even groups, a null group, null values, one hot group."""
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(300)]
    rows += [("hot", rng.randrange(50)) for _ in range(200)] + [("one", -7), ("two", 3), ("two", 4), ("none", None), ("a", None)]
    want = {}
    for g in {g for g, v in rows}:
        values = [v for h, v in rows if h == g and v is not None]
        if values:
            want[g] = (len(values), float(statistics.median(values)))
    df = spark.createDataFrame([(g, v, 1) for g, v in rows], "prefix string, rank long, digit int")  # names used inside
    got = medians.group_medians(df, ["prefix"], "rank", digit_bits=bits).collect()
    assert {r.prefix: (r.n_values, r["median"]) for r in got} == want
    whole = medians.group_medians(df, [], "rank", "m", digit_bits=bits).collect()
    values = [v for _, v in rows if v is not None]
    assert [tuple(r) for r in whole] == [(len(values), float(statistics.median(values)))]


def test_medians_of_an_empty_table(spark):
    df = spark.createDataFrame([("a", None)], "g string, v long")
    assert medians.group_medians(df, ["g"], "v").collect() == []


def test_stated_anchors(spark):
    """Each component gives the scores that the methodology states for its examples."""
    row = spark.range(1).select(
        scoring.revenue_concentration_score(F.lit(13), F.lit(100)).alias("conc_13"),
        scoring.revenue_concentration_score(F.lit(1), F.lit(100)).alias("conc_1"),
        scoring.building_count_score(F.lit(164)).alias("served_164"), scoring.building_count_score(F.lit(11)).alias("served_11"),
        scoring.revenue_per_building_score(F.lit(5550.0), F.lit(2000.0)).alias("per_5550"),
        scoring.revenue_per_building_score(F.lit(1187.0), F.lit(2000.0)).alias("per_1187"),
        scoring.revenue_per_building_score(F.lit(2000.0), F.lit(2000.0)).alias("per_median"),
        scoring.buildings_score(F.lit(11)).alias("b_11"), scoring.buildings_score(F.lit(400)).alias("b_400"),
        scoring.revenue_score(F.lit(24e6)).alias("r_24"), scoring.revenue_score(F.lit(250e6)).alias("r_250"),
        scoring.employees_score(F.lit(75)).alias("e_75"), scoring.employees_score(F.lit(3200)).alias("e_3200"),
        scoring.market_size_score(F.lit(230_965)).alias("m_231k"), scoring.market_size_score(F.lit(3600)).alias("m_3600"),
        scoring.contact_score(F.lit(2)).alias("c_2"), scoring.contact_score(F.lit(None).cast("int")).alias("c_none"),
        scoring.buildings_score(F.lit(0)).alias("b_0"), scoring.revenue_score(F.lit(None).cast("double")).alias("r_null")).first()
    want = {"conc_13": 100, "conc_1": 37, "served_164": 100, "served_11": 63, "per_5550": 91.8, "per_1187": 28.6, "per_median": 50,
            "b_11": 50, "b_400": 100, "r_24": 83, "r_250": 100, "e_75": 100, "e_3200": 100, "m_231k": 100, "m_3600": 71.1,
            "c_2": config.CONTACT_SCORE_HAS, "c_none": config.CONTACT_SCORE_NONE, "b_0": 0}
    for name, score in want.items():
        assert row[name] == pytest.approx(score, abs=0.1), name
    assert row.r_null is None


def test_expansion_counts_open_buildings_only(spark):
    df = spark.createDataFrame([(10, 4, 100.0), (10, None, 100.0), (4, 9, 100.0), (None, 1, 100.0)], "total int, served int, rev double")
    got = [r[0] for r in df.select(scoring.expansion_score(F.col("total"), F.col("served"), F.col("rev"), 1000.0)).collect()]
    assert 0 < got[0] < got[1] and got[1] == pytest.approx(100.0) and got[2] == 0.0 and got[3] is None

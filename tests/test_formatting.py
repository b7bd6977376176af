"""Python-compatible number formatting and display helpers."""

import random

from pyspark.sql import functions as F

from canvass.functions import formatting as fmt


def test_py_round_matches_python(spark):
    rnd = random.Random(3)
    vals = [0.25, 0.75, 2.675, 1.45, 31.25, -2.675, -0.25, 1234.5, 2.5, 0.125, 99.95, 100.0, 0.0, 1e-7]
    vals += [rnd.uniform(-1000, 1000) for _ in range(300)]
    vals += [round(rnd.uniform(0, 100), 2) for _ in range(300)] + [k / 8 for k in range(-40, 40)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = df.select("x", fmt.fixed(F.col("x"), 1).alias("a"), fmt.fixed(F.col("x"), 2).alias("b"),
                    fmt.fixed(F.col("x"), 0, grouping=True).alias("c")).collect()
    for r in out:
        assert r.a == f"{r.x:.1f}", r
        assert r.b == f"{r.x:.2f}", r
        assert r.c == f"{r.x:,.0f}", r


def test_formatters(spark):
    df = spark.createDataFrame([(85.55, 0.875, None, "G"), (None, None, 12.0, " s ")],
                               "s double, c double, n double, g string")
    r = df.select(fmt.format_score(F.col("s")).alias("fs"), fmt.format_confidence(F.col("c")).alias("fc"),
                  fmt.format_score_with_confidence(F.col("s"), F.col("c")).alias("fsc"),
                  fmt.tier_70_40(F.col("s")).alias("t"), fmt.score_band(F.col("s")).alias("b"),
                  fmt.growth_label(F.col("g")).alias("g"), fmt.format_large_number(F.col("n"), "employees").alias("n")
                  ).collect()
    assert (r[0].fs, r[0].fc, r[0].fsc, r[0].t, r[0].b, r[0].g) == ("85.5", "88%", "85.5 (88% confidence)", "green", "light_green", "📈 High")
    assert (r[1].fs, r[1].fc, r[1].t, r[1].b, r[1].g, r[1].n) == ("N/A", "N/A", "gray", "red", "➡️ Stable", "12")
    assert r[0].n == "N/A"

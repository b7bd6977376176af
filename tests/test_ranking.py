"""Ranking operators: distributed ranks equal plain window ranks, hot groups,
ties, nulls, first/last per key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from canvass.operators import ranking
from conftest import rows


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        # one segment holds a third of all rows; scores with many ties and nulls
        seg = "HOT" if i % 3 == 0 else f"S{rnd.randint(0, 40)}"
        score = None if rnd.random() < 0.05 else float(rnd.randint(0, 20))
        old = None if rnd.random() < 0.05 else rnd.randint(1, 50)
        data.append((f"{i:05d}", seg, score, old))
    return spark.createDataFrame(data, "company_id string, primary_naics string, final_score double, rank int")


def test_distributed_rank_matches_window(spark):
    df = _skewed(spark)
    order = [F.col("final_score").desc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("company_id")]
    a = ranking.contiguous_rank(df, ["primary_naics"], order, "pos", strategy="distributed", num_partitions=7)
    b = ranking.contiguous_rank(df, ["primary_naics"], order, "pos", strategy="window")
    assert rows(a, "company_id", "pos") == rows(b, "company_id", "pos")
    # the hot group is spread over several range partitions, ranks still 1..n
    hot = a.filter(F.col("primary_naics") == "HOT")
    n = hot.count()
    assert sorted(r[0] for r in hot.select("pos").collect()) == list(range(1, n + 1))


def test_global_rank_contiguous(spark):
    df = _skewed(spark, 500)
    g = ranking.global_rank(df, "final_score", "global_rank", "company_id")
    w = Window.orderBy(F.col("final_score").desc_nulls_last(), F.col("company_id"))
    exp = df.withColumn("global_rank", F.row_number().over(w))
    assert rows(g, "company_id", "global_rank") == rows(exp, "company_id", "global_rank")


def test_rank_within_segments_replaces_rank_and_drops_null_segment(spark):
    df = spark.createDataFrame(
        [("1", "A", 90.0, 7), ("2", "A", 90.0, 3), ("3", "A", None, 1), ("4", None, 99.0, 1), ("5", "B", 10.0, 9)],
        "company_id string, primary_naics string, final_score double, rank int")
    out = ranking.rank_within_segments(df, "primary_naics", "final_score", "rank", "company_id")
    assert out.columns == df.columns
    # tie on score broken by old rank; null score last; null segment dropped
    assert rows(out, "company_id", "rank") == [("1", 2), ("2", 1), ("3", 3), ("5", 1)]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, pos int, v string")
    assert rows(ranking.first_per_key(df, ["k"], ["pos"], ["v"])) == [("a", "x"), ("b", "z")]
    assert rows(ranking.last_per_key(df, ["k"], ["pos"], ["v"])) == [("a", "y"), ("b", "z")]


def test_cap_per_group(spark):
    df = spark.createDataFrame([("g", i, 2) for i in range(5)] + [("h", 1, 2)], "g string, v int, cap int")
    out = ranking.cap_per_group(df, "g", "cap", [F.col("v").desc()])
    assert rows(out, "g", "v") == [("g", 3), ("g", 4), ("h", 1)]


from hypothesis import given, settings, HealthCheck, strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["HOT", "HOT", "HOT", "a", "b", None]),
                          st.one_of(st.none(), st.integers(0, 5).map(float))), min_size=0, max_size=60),
       st.integers(1, 7))
def test_distributed_rank_property(spark, data, parts):
    df = spark.createDataFrame([(f"{i:03d}", g, s) for i, (g, s) in enumerate(data)],
                               "company_id string, seg string, score double")
    order = [F.col("score").desc_nulls_last(), F.col("company_id")]
    a = ranking.contiguous_rank(df, ["seg"], order, "pos", num_partitions=parts)
    b = ranking.contiguous_rank(df, ["seg"], order, "pos", strategy="window")
    assert rows(a, "company_id", "pos") == rows(b, "company_id", "pos")


def test_cluster_conf_sizes():
    from canvass.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600  # 100 TiB in blocks of 256 MiB
    assert int(cluster_conf(10 * 1024 ** 3, 8)["spark.sql.shuffle.partitions"]) == 40


def test_first_row_deals_rows_by_the_key_alone(spark):
    """The rows, however wide, are shuffled by the key once: not by the order as well, and by the key again."""
    from canvass.operators.ranking import first_per_key, last_per_key
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), ("b", 3, "z"), (None, 1, "n")], "k string, o int, v string")
        for pick, want in ((first_per_key, {("a", "y"), ("b", "z")}), (last_per_key, {("a", "x"), ("b", "z")})):
            out = pick(df, ["k"], ["o"], ["v"])
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(_cv_" not in plan and plan.count("Exchange hashpartitioning(") == 2
            assert sorted(map(tuple, out.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

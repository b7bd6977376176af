"""First and last rows by file order, packed order keys, caps by a window group limit: results and plans."""

import random

import pytest
from pyspark.sql import functions as F

from canvass.operators import joins, ranking
from canvass.plans import registry
from canvass.sources import readers
from canvass.sources.scan_order import SCAN_ORDER, with_scan_order
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_order_is_file_order(spark, tmp_path):
    """CSV in several files and blocks: names first, then rows as they stand."""
    rng = random.Random(2)
    rows = []
    for f in ("a", "b", "c"):
        lines = [(f"{rng.randrange(40)}", f"{f}{i}") for i in range(3000)]
        rows += lines
        (tmp_path / f"{f}.csv").write_text("company_id,website\n" + "".join(f"{k},{v}\n" for k, v in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = with_scan_order(readers._read_any(spark, str(tmp_path), multiline=False))
        got = [(r.company_id, r.website) for r in df.collect() if True]
        ordered = [(r.company_id, r.website) for r in sorted(df.collect(), key=lambda r: r[SCAN_ORDER])]
        assert sorted(got) == sorted(rows) and ordered == rows
        assert df.select(SCAN_ORDER).distinct().count() == len(rows)
        first = {r.company_id: r.website for r in ranking.first_per_key(df, ["company_id"], [SCAN_ORDER], ["website"]).collect()}
        last = {r.company_id: r.website for r in ranking.last_per_key(df, ["company_id"], [SCAN_ORDER], ["website"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert last == dict(rows) and first == dict(reversed(rows))


def test_readers_keep_the_first_row_of_the_file(spark, tmp_path):
    (tmp_path / "companies.csv").write_text("company_id,name,building_count_estimate,primary_naics,hq_latitude,hq_longitude\n7,first,3,1,1,1\n8,other,1,1,1,1\n7,second,1,1,1,1\n")
    comp = readers.load_companies(spark, str(tmp_path / "companies.csv"))
    scored = spark.createDataFrame([("7",), ("8",), ("9",)], "company_id string")
    got = {r.company_id: r.building_count_estimate for r in joins.enrich_raw_fields(scored, comp, ["building_count_estimate"]).collect()}
    assert got == {"7": 3, "8": 1, "9": None}


@pytest.mark.parametrize("last", [False, True])
def test_packed_order_equals_sorting(spark, last):
    """Several keys with nulls, negatives and the extremes of each type."""
    rng = random.Random(6)
    big = [-2 ** 63, -1, 0, 2 ** 63 - 1, None]
    rows = [(rng.randrange(12), rng.choice(big + [rng.randrange(-9, 9)]), rng.choice([True, False, None]), f"v{rng.randrange(5)}") for _ in range(400)]
    rows += [(99, 5, True, "same")] * 3 + [(None, 1, True, "no key")]
    df = spark.createDataFrame(rows, "k int, a long, b boolean, v string")
    pick = ranking.last_per_key if last else ranking.first_per_key
    got = pick(df, ["k"], ["a", "b"], ["a", "b", "v"]).collect()
    assert len(got) == len({r[0] for r in rows if r[0] is not None})

    def key(r):
        return (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or False)
    for r in got:
        own = [x for x in rows if x[0] == r.k]
        best = (max if last else min)(map(key, own))
        assert key((r.k, r.a, r.b)) == best and any(x[1:] == (r.a, r.b, r.v) for x in own)


def test_no_sort_aggregate_on_row_choice(spark):
    for name in ("export_rankings", "export_first_rows", "first_raw_fields", "last_penetration_rate", "company_lookup", "raw_field_enrichment"):
        assert "SortAggregate" not in plan(registry.QUERIES[name](spark, SF_SMALL)), name


def test_caps_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(f"{i % 3}", i, 4 + i % 3) for i in range(300)], "g string, v int, cap int")
    out = ranking.cap_per_group(df, "g", "cap", [F.col("v").desc()], most=6)
    assert plan(out).count("WindowGroupLimit") == 2  # before and after the exchange
    assert sorted((r.g, r.v) for r in out.collect()) == sorted((str(i % 3), i) for i in range(300) if i >= 300 - 3 * (4 + i % 3))
    assert "WindowGroupLimit" in plan(registry.QUERIES["industry_caps"](spark, SF_SMALL))

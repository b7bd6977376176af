"""Streaming refresh of interaction counts equals the batch aggregation."""

import os
import tempfile

from canvass.operators import aggregates
from canvass.sources import schemas
from canvass.streaming.refresh import current_counts, start_interaction_refresh
from conftest import rows


def _write(spark, rows_, path):
    spark.createDataFrame(rows_, schemas.CRM_INTERACTIONS).coalesce(1).write.option("header", "true").csv(path)


def test_refresh_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="canvass-stream-")
    src, out, ckpt = (os.path.join(root, x) for x in ("src", "out", "ckpt"))
    week1 = [("e1", "1", "note", "", ""), ("e2", "1", "note", "", ""), ("e3", "2", "call", "", "")]
    week2 = [("e4", "1", "note", "", ""), ("e5", "3", "email", "", "")]
    _write(spark, week1, os.path.join(src, "w1"))
    q = start_interaction_refresh(spark, src + "/*", out, ckpt)
    q.awaitTermination(120)
    _write(spark, week2, os.path.join(src, "w2"))
    q = start_interaction_refresh(spark, src + "/*", out, ckpt)     # next weekly run resumes from the checkpoint
    q.awaitTermination(120)
    got = rows(current_counts(spark, out), "company_id", "engagement_type", "n_engagements")
    batch = aggregates.interaction_counts(spark.createDataFrame(week1 + week2, schemas.CRM_INTERACTIONS))
    assert got == rows(batch, "company_id", "engagement_type", "n_engagements")
    assert got == [("1", "note", 3), ("2", "call", 1), ("3", "email", 1)]

"""Polls from documents to committed tables."""

import pytest

from tidemark.operators import poll, sinks
from tests import golden_feeds as feed_queries

SCHEMA = "source_id string, format string, body string, error string, priority int, source_label string, source_file string, job_type string"


def _documents(spark, markdown, table, error=None):
    rows = [("m", "markdown", markdown, error, 0, "M", "m.md", "Internship"), ("h", "html_table", table, None, 1, "H", "h.md", "Internship")]
    return spark.createDataFrame(rows, SCHEMA)


def test_polls_are_committed(spark, tmp_path):
    store = sinks.Snapshots(spark, f"file://{tmp_path}/store")
    first = poll.run_poll(store, _documents(spark, feed_queries.MARKDOWN, feed_queries.TABLE), "2026-01-01T00:00:00Z")
    assert first.step.baseline and set(first.changed) == {"entities", "memberships", "sources", "facts", "batches"}
    assert {r["source_id"]: (r["ok"], r["parsed"], r["matching"]) for r in first.sources.collect()} == {"m": (True, 3, 2), "h": (True, 2, 2)}
    assert tuple(first.counts.first()) == (4, 4, 0)
    before = {r["canonical_id"]: r["active"] for r in store.read("entities").collect()}
    assert len(before) == 4 and all(before.values()) and store.read("batches").count() == 0
    second = poll.run_poll(store, _documents(spark, "# nothing", feed_queries.TABLE.replace("orbit.example/j/1", "orbit.example/j/2")), "2026-01-02T00:00:00Z")
    after = {r["canonical_id"]: r["active"] for r in store.read("entities").collect()}
    assert [r["source_id"] for r in second.sources.where("not ok").collect()] == ["m"]
    assert {i for i in after if not after[i]} == {"url:https://orbit.example/j/1"}  # what the broken feed listed stays
    assert [list(r["job_ids"]) for r in store.read("batches").collect()] == [["url:https://orbit.example/j/2"]]
    with pytest.raises(ValueError, match="no source answered"):
        poll.run_poll(store, _documents(spark, None, "", error="HTTP 500"), "2026-01-03T00:00:00Z")

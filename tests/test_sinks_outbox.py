import pytest
from pyspark.sql import functions as F

from tidemark.functions import settings
from tidemark.operators import outbox, render, sinks
from tidemark.sources import connectors, state


def test_commit_skips_what_is_unchanged(spark, tmp_path):
    store = sinks.Snapshots(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    assert store.commit(a=a, b=a) == ["a", "b"]
    assert store.commit(a=a.orderBy(F.desc("i")), b=a.limit(1)) == ["b"]
    assert store.manifest()["version"] == 2 and store.read("a").count() == 2 and store.read("b").count() == 1
    assert store.read("c", "i int").count() == 0
    with pytest.raises(ValueError):
        store.read("c")


def test_json_document_is_deterministic(spark):
    a = spark.createDataFrame([(2, None), (1, "ä")], "i int, t string")
    assert sinks.json_document(a, ["i"]) == sinks.json_document(a.orderBy("i"), ["i"]) == '[\n  {\n    "i": 1,\n    "t": "ä"\n  },\n  {\n    "i": 2,\n    "t": null\n  }\n]\n'


def test_delivery_is_idempotent(spark):
    box = spark.createDataFrame([("b1", "2026-01-01", None, "pending"), ("b2", "2026-01-02", None, "pending"), ("b3", "2026-01-03", 9, "sent")], "batch_id string, created_at string, issue_number int, status string")
    issues = spark.createDataFrame([(5, None, "<!-- batch:v1:b1 -->"), (4, "pr", "<!-- batch:v1:b2 -->")], "number int, pull_request string, body string")
    sent = []

    def create(row):
        sent.append(row["batch_id"])
        if row["batch_id"] == "b2" and len(sent) == 1:
            raise OSError("down")
        return 77

    first = {r["batch_id"]: tuple(r)[1:] for r in outbox.deliver(box, issues, create).collect()}
    assert first == {"b1": (5, "sent"), "b2": (None, "pending: OSError"), "b3": (9, "sent")} and sent == ["b2"]


def test_entries_and_promotion(spark):
    batches = spark.createDataFrame([("b", ["i", "fallback:f"], ["u2", "gone"])], "batch_id string, job_ids array<string>, job_urls array<string>")
    history = spark.createDataFrame([("i", "u1", ["u2"]), ("d", "u3", [])], "canonical_id string, application_url string, url_aliases array<string>")
    assert outbox.deliverable(outbox.entries_by_id(batches, history)).count() == 0
    moved = outbox.promoted_ids(batches, spark.createDataFrame([("fallback:f", "d")], "fallback_id string, canonical_id string"))
    assert moved.first()["job_ids"] == ["d", "i"]
    assert outbox.deliverable(outbox.entries_by_id(moved, history)).count() == 1
    assert [(r["url"], r["canonical_id"]) for r in outbox.entries_by_url(batches, history).orderBy("position").collect()] == [("u2", "i"), ("gone", None)]


def test_retention_boundary(spark):
    mark = "<!-- batch:v1:x -->"
    rows = [(1, "2026-01-01T00:00:00Z", mark, None), (2, "2025-12-01T00:00:00Z", mark, None), (3, "2026-01-01T00:00:01Z", mark, None), (4, "2025-01-01T00:00:00Z", "user", None), (5, "2025-01-01T00:00:00Z", mark, "pr"), (6, "soon", mark, None), (7, "2025-01-01T00:00:00", mark, None)]
    issues = spark.createDataFrame(rows, "number int, created_at string, body string, pull_request string")
    assert sorted(r["number"] for r in outbox.expired(issues, "2026-01-22T00:00:00Z").collect()) == [1, 2]


def test_scan_targets_and_records(spark):
    t = lambda *rows: spark.createDataFrame([*rows], "canonical_id string, issue_number int")
    found = {r["canonical_id"]: (r["issue_number"], r["origin"]) for r in outbox.scan_targets(t(("a", 1), ("b", 2)), t(("b", 4), ("b", 3))).collect()}
    assert found == {"a": (1, "retry"), "b": (3, "delivery")}
    scans = spark.createDataFrame([("a", "failed", 1, 1, "t0", "t0"), ("b", "failed", 2, 1, "t0", "t0"), ("c", "failed", 1, 0, "t0", "t0")], "canonical_id string, status string, attempt_count int, issue_number int, first_scanned string, last_scanned string")
    history = t(("a", 0), ("b", 0), ("c", 0)).select("canonical_id")
    assert [r["canonical_id"] for r in outbox.retryable(scans, history).collect()] == ["a"]
    new = spark.createDataFrame([("a", "partial", 1, "t1")], "canonical_id string, status string, issue_number int, last_scanned string")
    a = {r["canonical_id"]: r for r in outbox.recorded(scans, new).collect()}["a"]
    assert (a["attempt_count"], a["first_scanned"], a["last_scanned"], a["status"]) == (2, "t0", "t1", "partial")


def test_block_upsert_is_idempotent(spark):
    once = spark.createDataFrame([("text",), ("",)], "b string").select(render.upsert_block(F.col("b"), "1", F.lit("a\\b $1")).alias("b"))
    twice = once.select(render.upsert_block(F.col("b"), "1", F.lit("a\\b $1")).alias("b"))
    assert [r["b"] for r in once.collect()] == [r["b"] for r in twice.collect()]


def test_dashboard_and_alerts(spark):
    columns = "active boolean, first_seen string, last_seen string, company string, position string, job_type string, category string, location string, salary string, labels string, application_url string"
    rows = [(True, "2026-01-01", "2026-01-02", "B|x", "P", "J", "K", "L", None, "s", "u1"), (True, "2026-01-03", "2026-01-03", "a", "P", "J", "K", "L", "$1", None, "u2"), (True, "2026-01-01", "2026-01-01", "a", "P", "J", "K", "L", "", "", "u3")]
    entities = spark.createDataFrame(rows, columns)
    lines = [r["line"] for r in render.dashboard(entities, "Title", "About.").collect()]
    head = ["| " + " | ".join(render.COLUMNS) + " |", "|" + "---|" * 11]
    assert lines == [
        render.GENERATED, "", "# Title", "", "About.", "", "## Active Jobs (3)", "", *head,
        "| a | P | J | K | L | Unknown | $1 | 2026-01-03 | 2026-01-03 | Yes | [Apply](<u2>) |", "| a | P | J | K | L | Unknown | N/A | 2026-01-01 | 2026-01-01 | Yes | [Apply](<u3>) |",
        "| B\\|x | P | J | K | L | s | N/A | 2026-01-01 | 2026-01-02 | Yes | [Apply](<u1>) |", "", "## Historical / Closed or Removed Jobs (0)", "", *head, "| _No historical matching jobs_ |" + "  |" * 10, "",
    ]
    assert [r["line"] for r in render.dashboard(entities, "Title", "About.", initialized=False).collect()][-2:] == [render.NO_BASELINE, ""]
    alerts = render.alert_bodies(entities.limit(1).withColumns({"batch_id": F.lit("k"), "canonical_id": F.lit("i"), "posted": F.lit("today")})).first()
    assert alerts["title"] == "1 new entry"
    assert alerts["body"] == "# New postings\n\n## B|x\n\n**P**\n\n- **Type:** J\n- **Category:** K\n- **Location:** L\n- **Sources:** s\n- **Salary:** N/A\n- **Age:** N/A\n- **Posted:** today\n\n### [Apply to B|x →](<u1>)\n\n---\n\nDetected automatically.\n\n<!-- batch:v1:k -->\n"
    assert "batch:v1" not in render.test_body() + render.test_body("https://x.example/1")


def test_effects_are_isolated(spark):
    """One issue that can't be closed, patched, labelled or whose batch lacks an entry stops no other."""
    mark, seen = "<!-- batch:v1:x -->", []
    issues = spark.createDataFrame([(1, "2026-01-01T00:00:00Z", mark, None), (2, "2026-01-01T00:00:00Z", mark, None)], "number int, created_at string, body string, pull_request string")

    def act(*row):
        seen.append(row)
        if row[0] == 1:
            raise OSError("down")

    assert [tuple(r) for r in outbox.close_expired(issues, act, "2026-03-01T00:00:00Z").orderBy("number").collect()] == [(1, False, "OSError"), (2, True, None)]
    bodies = spark.createDataFrame([(1, "one"), (2, None), (3, "three\n\n<!-- scan:start c -->\nC\n<!-- scan:end c -->\n")], "number int, body string")
    blocks = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B"), ("a", 2, "A"), ("c", 3, "C")], "canonical_id string, issue_number int, block string")
    updates = outbox.issue_updates(blocks, bodies)
    assert {r["number"]: r["body"].count("scan:start") for r in updates.collect()} == {1: 2, 2: 1}  # the third is as it should be
    assert [tuple(r)[:2] for r in outbox.update_issues(updates, act).orderBy("number").collect()] == [(1, False), (2, True)]
    box = spark.createDataFrame([("b1", "t", None, "pending"), ("b2", "t", None, "pending")], "batch_id string, created_at string, issue_number int, status string")
    whole = spark.createDataFrame([("b2",)], "batch_id string")
    none = spark.createDataFrame([], "number int, pull_request string, body string")
    sent = {r["batch_id"]: tuple(r)[1:] for r in outbox.deliver(box, none, lambda row: 1, label=act, complete=whole).collect()}
    assert sent == {"b1": (None, "pending: entries missing"), "b2": (1, "sent")}
    batches = spark.createDataFrame([("b1", ["i", "j"], True), ("b2", ["j", "gone"], True), ("b3", ["k"], False)], "batch_id string, job_ids array<string>, scan_eligible boolean")
    told = spark.createDataFrame([("b2", 8, "sent"), ("b1", 7, "sent"), ("b3", 9, "sent")], "batch_id string, issue_number int, status string")
    history = spark.createDataFrame([("i",), ("j",), ("k",)], "canonical_id string")
    assert sorted(tuple(r) for r in outbox.delivery_targets(told, batches, history).collect()) == [("i", 7), ("j", 7)]


def test_settings():
    env = {"A": " Yes ", "B": "yess", "N": "3", "Z": "0", "X": "x"}
    assert settings.flag(env, "A") and not settings.flag(env, "B", True) and settings.flag(env, "none", True)
    assert [settings.positive(env, k, 5) for k in ("N", "Z", "X", "none")] == [3, 5, 5, 5]


def test_connectors(spark):
    spark.dataSource.register(connectors.FeedSource)
    spark.dataSource.register(connectors.PagedSource)
    lines = "\n".join(["a\trepo\tmain\tx.md", "b\trepo\tmain\tmissing.md", "c\tbroken\tmain\ty.md"])
    rows = {r["source_id"]: r for r in spark.read.format("feeds").option("sources", lines).option("base", "local").option("fetcher", "tests.feeds:fetch").load().collect()}
    assert rows["a"]["body"] == "body of local/repo/abcdef1234567/x.md" and rows["b"]["revision"] and rows["b"]["error"] and rows["c"]["revision"] is None and "404" in rows["c"]["error"]
    paged = spark.read.format("paged").option("start", "1").option("fetcher", "tests.feeds:pages").load()
    assert sorted(int(r["item"]) for r in paged.collect()) == [10, 11, 12, 20, 21, 22]


def test_retries():
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert connectors.with_retries(fetch, "u", wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(connectors.Permanent):
        connectors.with_retries(lambda u: (_ for _ in ()).throw(connectors.Permanent()), "u", wait=waits.append)
    assert len(waits) == 2


def test_stored_histories(spark, tmp_path):
    old = tmp_path / "v1.json"
    old.write_text('{"schema_version": 1, "initialized": true, "jobs": {"https://jobs.lever.co/A/1?utm_source=x": {"company": "A", "first_seen": "2026-01-02", "active": false}, "https://jobs.lever.co/a/1": {"company": "B", "first_seen": "2026-01-01", "active": true}}}')
    found = state.entries(state.read(spark, str(old))).collect()
    assert [(r["canonical_id"], r["company"], r["active"], len(r["url_aliases"])) for r in found] == [("lever:a:1", "B", True, 2)]
    assert state.needs_baseline(state.read(spark, str(old))).first()["baseline"]
    missing = str(tmp_path / "none.json")
    assert state.entries(state.read(spark, missing)).count() == state.entries(state.read_current(spark, missing)).count() == state.read_questions(spark, missing).count() == 0
    asked = tmp_path / "q.json"
    asked.write_text('{"schema_version": 1, "scans": {"a": {"status": "partial", "questions": [{"label": "Your answer: \\"token\\": x"}]}}}')
    assert state.read_questions(spark, str(asked)).count() == 1
    asked.write_text('{"schema_version": 1, "scans": {"a": {"metadata": [{"deep": {"Session-Cookie": 1}}]}}}')
    with pytest.raises(Exception, match="prohibited"):
        state.read_questions(spark, str(asked)).collect()
    bad = tmp_path / "v9.json"
    bad.write_text('{"schema_version": 9}')
    with pytest.raises(Exception, match="known version"):
        state.read(spark, str(bad)).collect()


def test_scan_violations(spark):
    rows = spark.createDataFrame([("a", "a", "p", "partial", 1, 1, ["method"]), ("b", "x", "", "odd", 0, 1, ["Auth_Token"])], "canonical_id string, key string, provider string, status string, attempt_count int, issue_number int, metadata_keys array<string>")
    found = state.scan_violations(rows).collect()
    assert {r["canonical_id"] for r in found} == {"b"} and {r["violation"] for r in found} == {"key", "provider", "status", "attempts", "prohibited field"}

"""Actions as a sink, commits by bucket, and scans that are stored before alerts are changed."""

import pytest
from pyspark.sql import functions as F

from tests import outside
from tidemark.operators import actions, enrichment, outbox, render, sinks


@pytest.fixture
def folder(tmp_path):
    outside.use(tmp_path)
    return f"file://{tmp_path}"


def ids(df):
    return sorted(r["canonical_id"] for r in df.collect())


def test_batches_are_sent_once(spark, folder):
    box = spark.createDataFrame([("new", "2026-01-02", None, "pending"), ("down", "2026-01-01", None, "pending"), ("there", "2026-01-03", None, "pending"), ("marked", "2026-01-01", None, "pending"), ("old", "2025-01-01", 9, "sent"), ("part", "2026-01-01", None, "pending")], "batch_id string, created_at string, issue_number int, status string")
    issues = spark.createDataFrame([(5, None, "<!-- batch:v1:marked -->")], "number int, pull_request string, body string")
    complete = box.where("batch_id <> 'part'").select("batch_id")
    send = lambda: {r["batch_id"]: tuple(r)[1:] for r in outbox.send(box, issues, "tests.outside:create", folder, "tests.outside:find", "tests.outside:label", complete).collect()}
    assert send() == {"new": (102, "sent"), "down": (None, "pending: OSError"), "there": (55, "sent"), "marked": (5, "sent"), "old": (9, "sent"), "part": (None, "pending: entries missing")}
    assert [c["batch_id"] for c in outside.calls("create")] == ["down", "new"]  # by time and id; what is there isn't sent
    assert [c["key"] for c in outside.calls("label")] == ["new"]  # one try, and its failure stops nothing


def test_outcomes_are_those_of_published_runs(spark, folder):
    rows = spark.range(20).select(F.col("id").cast("string").alias("batch_id")).repartition(4)
    told = actions.perform(rows, "tests.outside:create", f"{folder}/a", "batch_id")
    assert told.count() == 20 and told.where("status = 'done'").count() == 20 and len(outside.calls("create")) == 20
    assert actions.outcomes(spark, f"{folder}/nothing").count() == 0
    writer = actions.ActionWriter({"path": f"{folder}/b", "key": "batch_id", "act": "tests.outside:create"})
    first = writer.write(iter(rows.limit(3).collect()))
    writer.write(iter(rows.limit(3).collect()))  # an attempt that is never told of
    writer.abort([first, None])
    assert actions.outcomes(spark, f"{folder}/b").count() == 3
    assert actions.perform(rows.limit(0), "tests.outside:create", f"{folder}/c", "batch_id").count() == 0


def test_only_changed_buckets_are_written(spark, folder):
    store = sinks.Snapshots(spark, f"{folder}/store")
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.array(F.struct("id")).alias("a"))
    commit = lambda df: store.commit(keys={"t": ["k"]}, buckets=16, t=df)
    buckets = lambda: store.manifest()["tables"]["t"]["buckets"]
    assert commit(rows) == ["t"] and commit(rows.orderBy(F.desc("k"))) == []
    before = buckets()
    changed = rows.withColumn("v", F.when(F.col("k") == "17", -1).otherwise(F.col("v")))
    assert commit(changed) == ["t"]
    after = buckets()
    assert sum(after[b] != before[b] for b in after) == 1 and len(after) == 16  # one row is one bucket, the others stay where they are
    assert sorted(map(repr, store.read("t").select("k", "v", "a").collect())) == sorted(map(repr, changed.select("k", "v", "a").collect()))
    assert commit(changed.where("k <> '17'")) == ["t"] and store.read("t").count() == 399
    assert commit(rows.limit(0)) == ["t"] and store.read("t").count() == 0 and store.read("t").columns == ["k", "v", "a"]
    wider = rows.withColumn("w", F.lit(1))
    assert commit(wider) == ["t"] and store.read("t").columns == ["k", "v", "a", "w"]


def test_index_of_links_reads_and_writes_their_buckets_alone(spark, folder, monkeypatch):
    store = sinks.Snapshots(spark, f"{folder}/store")
    kind = "canonical_id string, application_url string, url_aliases array<string>"
    entries = spark.createDataFrame([(f"e{i:03}", f"u{i}", [f"a{i}", "shared"]) for i in range(1, 200)], kind)
    assert outbox.index_links(store, entries) and not outbox.index_links(store, entries)
    before = store.manifest()["tables"]["links"]
    assert outbox.index_links(store, spark.createDataFrame([("e000", "u0", ["shared"]), ("e900", "u7", None)], kind))  # e007 keeps u7
    after = store.manifest()["tables"]["links"]
    assert 1 <= sum(after["buckets"][b] != before["buckets"].get(b) for b in after["buckets"]) <= 2 and after["hash"] != before["hash"]
    batches = spark.createDataFrame([("b", ["u7", "a9", "shared", "u0", "none"])], "batch_id string, job_urls array<string>")
    read = []
    monkeypatch.setattr(store, "_folders", lambda buckets, types, old=store._folders: read.append(len(buckets)) or old(buckets, types))
    found = [(r["url"], r["canonical_id"], r["found"]) for r in outbox.entries_by_index(batches, store).orderBy("position").collect()]
    assert found == [("u7", "e007", True), ("a9", "e009", True), ("shared", "e000", True), ("u0", "e000", True), ("none", None, False)] and read[0] <= 5
    with pytest.raises(ValueError, match="other keys"):
        store.upsert("links", entries, ["canonical_id"], lambda a, b: b)


ENTRIES = "canonical_id string, application_url string"
TARGETS = "canonical_id string, issue_number long"


@pytest.fixture
def setting(spark, folder):
    store = sinks.Snapshots(spark, f"{folder}/store")
    entries = spark.createDataFrame([(c, f"https://jobs.example.com/{c}") for c in ("alpha", "broken", "charlie", "delta")], ENTRIES)
    bodies = lambda *rows: spark.createDataFrame([*rows], "number long, body string")
    run = lambda deliveries, shown, now="t1", inspect=None, **more: enrichment.enrich(store, spark.createDataFrame(deliveries, TARGETS), entries, bodies(*shown), inspect or enrichment.static_inspection("tests.outside:page"), "tests.outside:patch", now, **more)
    return store, run


def stored(store):
    return {r["canonical_id"]: r for r in store.read("scans", enrichment.SCAN).collect()}


def test_scans_are_stored_and_one_failure_stops_no_other(spark, setting):
    store, run = setting
    told = run([("alpha", 12), ("broken", 12), ("charlie", 13), ("ghost", 12)], [(12, "# Alert"), (13, "# Other")])
    assert ids(told.attempted) == ids(told.persisted) == ["alpha", "broken", "charlie"]
    assert ids(told.updated) == ["alpha", "broken"] and {(r["canonical_id"], r["step"]) for r in told.failed.collect()} == {("broken", "scan"), ("charlie", "update")}
    scans = stored(store)
    assert scans["broken"]["status"] == "failed" and scans["broken"]["attempt_count"] == 1
    assert {c: r["update_pending"] for c, r in scans.items()} == {"alpha": False, "broken": False, "charlie": True}
    assert [q["label"] for q in scans["alpha"]["questions"]] == ["Why us?"]
    (body,) = (c["body"] for c in outside.calls("patch") if c["number"] == 12)
    assert body.count("scan:start alpha") == body.count("scan:start broken") == 1 and "Why us?" in body

    # the failed update is done by the next run, and its form isn't looked at again; the failed scan is tried once more
    asked = len(outside.calls("page"))
    again = run([], [(12, body), (13, "# Other")], "t2")
    assert ids(again.attempted) == ["broken"] and [c["url"] for c in outside.calls("page")[asked:]] == ["https://jobs.example.com/broken"]
    scans = stored(store)
    assert "charlie" in ids(again.updated) and not any(r["update_pending"] for r in scans.values())
    assert (scans["broken"]["attempt_count"], scans["broken"]["first_scanned"], scans["broken"]["last_scanned"]) == (2, "t1", "t2")
    version = store.manifest()["version"]
    last = run([("alpha", 12)], [(12, body), (13, "# Other")], "t3")  # the bound is reached, and what was found is final
    assert ids(last.attempted) == [] and store.manifest()["version"] == version


def test_a_run_that_ends_between_both_commits_looks_at_no_form_twice(spark, setting, monkeypatch):
    store, run = setting

    def lost(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(actions, "perform", lost)
        with pytest.raises(KeyboardInterrupt):
            run([("alpha", 12)], [(12, "# Alert")])
    assert stored(store)["alpha"]["update_pending"] and outside.calls("patch") == [] and len(outside.calls("page")) == 1
    told = run([], [(12, "# Alert")], "t2")
    assert ids(told.attempted) == [] and ids(told.updated) == ["alpha"]
    assert len(outside.calls("page")) == 1 and len(outside.calls("patch")) == 1 and not stored(store)["alpha"]["update_pending"]


def test_what_mustnt_be_stored_isnt(spark, setting):
    store, run = setting

    def inspect(targets):
        metadata = F.when(F.col("canonical_id") == "alpha", '{"a": [{"csrf_t\\u006fken": 1}]}').when(F.col("canonical_id") == "charlie", '{"kind": "token"}')
        status = F.when(F.col("canonical_id") == "delta", "odd").otherwise("partial")
        told = targets.select("canonical_id", F.lit("generic").alias("provider"), status.alias("status"), F.lit("see https://x.example/?token=1").alias("reason"), metadata.alias("metadata"))
        return told, spark.createDataFrame([], "page_id string, " + enrichment._QUESTION[7:-1])

    told = run([("alpha", 12), ("charlie", 12), ("delta", 12)], [(12, "# Alert")], inspect=inspect)
    assert {r["canonical_id"]: r["error"] for r in told.failed.collect()} == {"alpha": "prohibited field", "delta": "status"}
    assert list(stored(store)) == ["charlie"] and "https" not in stored(store)["charlie"]["reason"]

    def none(targets):
        raise OSError("no inspector")

    told = run([("delta", 12)], [(12, "# Alert")], inspect=none)
    assert stored(store)["delta"]["status"] == "failed" and stored(store)["delta"]["error_message"].startswith("OSError")


def test_blocks_of_alerts_that_have_them_change_nothing(spark):
    scans = spark.createDataFrame([("a", "generic", "u", "partial", None, None, [], None, 1, "t", "t", 7, True)], enrichment.SCAN)
    _, first = enrichment.pending_updates(scans, spark.createDataFrame([(7, "x")], "number long, body string"))
    body = first.first()["body"]
    assert enrichment.pending_updates(scans, spark.createDataFrame([(7, body)], "number long, body string"))[1].count() == 0
    assert render.GENERATED not in body

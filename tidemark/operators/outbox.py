"""Delivery of pending alerts: resolution of their entries, idempotent sending, enrichment targets, retention."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V

from . import actions, render
from .sinks import Snapshots

BATCH_MARK = r"<!-- batch:v1:(\w+) -->"


def append(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """The outbox with the batches it hasn't got yet; a batch's id depends on its members, so a repeated run adds none."""
    return outbox.unionByName(new.join(outbox.select("batch_id"), "batch_id", "left_anti"), allowMissingColumns=True)


def entries_by_id(batches: DataFrame, history: DataFrame) -> DataFrame:
    """`(batch_id, position, canonical_id, <history>, found)` of `batches(batch_id, job_ids)`."""
    ids = batches.select("batch_id", F.posexplode("job_ids").alias("position", "canonical_id"))
    return ids.join(history.withColumn("found", F.lit(True)), "canonical_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def entries_by_url(batches: DataFrame, history: DataFrame) -> DataFrame:
    """The same for batches that only name links: the first entry (by id) with the link as its own or as an alias."""
    links = batches.select("batch_id", F.posexplode("job_urls").alias("position", "url"))
    known = history.select("canonical_id", F.explode(F.array_distinct(F.concat(F.array("application_url"), F.coalesce("url_aliases", F.array().cast("array<string>"))))).alias("url"))
    first = known.groupBy("url").agg(F.min("canonical_id").alias("canonical_id"))
    return links.join(first, "url", "left").withColumn("found", F.col("canonical_id").isNotNull())


def index_links(store: Snapshots, entries: DataFrame, name: str = "links") -> bool:
    """Add the links of `entries(canonical_id, application_url, url_aliases)` to the index kept in the store, link by link.

    A poll gives the entries that it saw: only the buckets of their links are read and written, and the rest of the
    index, however large, stays where it is. A link that several entries have is the first one's, by id.
    """
    urls = F.array_distinct(F.concat(F.array("application_url"), F.coalesce("url_aliases", F.array().cast("array<string>"))))
    links = entries.select(F.explode(urls).alias("url"), "canonical_id").where("url is not null")
    first = lambda rows: rows.groupBy("url").agg(F.min("canonical_id").alias("canonical_id"))
    return store.upsert(name, first(links), ["url"], lambda stored, new: first(stored.unionByName(new)))


def entries_by_index(batches: DataFrame, store: Snapshots, name: str = "links") -> DataFrame:
    """`entries_by_url` by the index: of the history only the buckets that the batches' links fall into are read."""
    links = batches.select("batch_id", F.posexplode("job_urls").alias("position", "url"))
    known = store.look_up(name, links.select("url"))
    return links.join(known, "url", "left").withColumn("found", F.col("canonical_id").isNotNull())


def deliverable(entries: DataFrame) -> DataFrame:
    """Batches none of whose entries is missing."""
    return entries.groupBy("batch_id").agg(F.bool_and("found").alias("complete")).where("complete").select("batch_id")


def ordered(batches: DataFrame, *group: str) -> DataFrame:
    """`batches` with `position`, the order of delivery in their group: by time, then id."""
    return batches.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("created_at", "batch_id")).cast("long"))


def sent_marks(issues: DataFrame) -> DataFrame:
    """`(batch_id, issue_number)`: the first issue that isn't a pull request for each batch named in a body."""
    named = issues.where("pull_request is null").select("number", F.explode(F.regexp_extract_all("body", F.lit(BATCH_MARK), 1)).alias("batch_id"))
    return named.groupBy("batch_id").agg(F.min("number").alias("issue_number"))


def deliver(outbox: DataFrame, issues: DataFrame, create: Callable[[dict], int], label: Callable[[int], None] | None = None, complete: DataFrame | None = None) -> DataFrame:
    """Send pending batches in order of time and id; `(batch_id, issue_number, status)`.

    A batch whose mark an issue has is only marked sent; one that isn't in `complete` (as of `deliverable`) stays
    pending. Sending is an outside effect of few, ordered calls, so it runs on the driver, one batch at a time; a batch
    that fails stays pending and stops no other. A label is tried once, and an issue without it is sent all the same.
    """
    spark = outbox.sparkSession
    known = outbox.join(sent_marks(issues).withColumnRenamed("issue_number", "found_issue"), "batch_id", "left")
    if complete is not None:
        known = known.join(complete.select("batch_id", F.lit(True).alias("whole")), "batch_id", "left")
    done = known.where("status = 'sent' or found_issue is not null").select("batch_id", F.coalesce("found_issue", "issue_number").alias("issue_number"), F.lit("sent").alias("status"))
    rows = []
    for row in known.where("status <> 'sent' and found_issue is null").orderBy("created_at", "batch_id").toLocalIterator():
        if complete is not None and not row["whole"]:
            rows.append((row["batch_id"], None, "pending: entries missing"))
            continue
        try:
            rows.append((row["batch_id"], create(row.asDict()), "sent"))
        except Exception as error:  # what a sender raises is its own; the batch is tried again
            rows.append((row["batch_id"], None, f"pending: {type(error).__name__}"))
            continue
        if label is not None:
            with contextlib.suppress(Exception):
                label(rows[-1][1])
    return done.unionByName(spark.createDataFrame(rows, done.schema))


def send(outbox: DataFrame, issues: DataFrame, create: str, path: str, find: str | None = None, label: str | None = None, complete: DataFrame | None = None) -> DataFrame:
    """`deliver` by the sink of `actions`: `(batch_id, issue_number, status)`.

    Pending batches are sent one after the other, by time and id; create, find and label are functions named as
    `module:function`. find is asked for a batch's issue right before it is sent, so an attempt that is repeated after a
    lost executor sends nothing twice; what `issues` already shows isn't asked for.
    """
    known = outbox.join(sent_marks(issues).withColumnRenamed("issue_number", "found_issue"), "batch_id", "left")
    if complete is not None:
        known = known.join(complete.select("batch_id", F.lit(True).alias("whole")), "batch_id", "left")
    done = known.where("status = 'sent' or found_issue is not null").select("batch_id", F.coalesce("found_issue", "issue_number").cast("long").alias("issue_number"), F.lit("sent").alias("status"))
    rest = known.where("status <> 'sent' and found_issue is null")
    whole = F.coalesce("whole", F.lit(False)) if complete is not None else F.lit(True)
    told = actions.perform(rest.where(whole).drop("found_issue", "whole"), create, f"{path}/sent", "batch_id", find, ["created_at", "batch_id"])
    sent = told.select(F.col("key").alias("batch_id"), F.col("value").try_cast("long").alias("issue_number"), F.when(F.col("status") == actions.FAILED, F.concat(F.lit("pending: "), F.split("error", ":")[0])).otherwise("sent").alias("status"))
    if label is not None:  # tried once; an issue without it is sent all the same
        actions.perform(told.where(f"status = '{actions.DONE}'"), label, f"{path}/labels", "key")
    missing = rest.where(~whole).select("batch_id", F.lit(None).cast("long").alias("issue_number"), F.lit("pending: entries missing").alias("status"))
    return done.unionByName(sent).unionByName(missing)


def _each(rows: DataFrame, act: Callable[..., None], *columns: str) -> DataFrame:
    """`act` on each of a few rows, one after another on the driver; `(<first column>, done, error)`. One that fails stops no other."""
    out = []
    for row in rows.select(*columns).orderBy(columns[0]).toLocalIterator():
        try:
            act(*row)
            out.append((row[0], True, None))
        except Exception as error:
            out.append((row[0], False, type(error).__name__))
    return rows.sparkSession.createDataFrame(out, f"{columns[0]} {dict(rows.dtypes)[columns[0]]}, done boolean, error string")


def close_expired(issues: DataFrame, close: Callable[[int], None], now: str, days: int = V.ALERT_RETENTION_DAYS) -> DataFrame:
    """Close the alert issues that are past their time; `(number, done, error)`. Closing deletes nothing."""
    if days < 1:
        raise ValueError("days must be positive")
    return _each(expired(issues, now, days), close, "number")


def delivery_targets(delivered: DataFrame, batches: DataFrame, history: DataFrame, eligible_only: bool = True) -> DataFrame:
    """`(canonical_id, issue_number)` to scan after a delivery: known entries of batches sent, the first batch's issue for each."""
    sent = delivered.where("status = 'sent' and issue_number >= 1").select("batch_id", F.col("issue_number").alias("issue"))
    chosen = batches.where("scan_eligible") if eligible_only else batches
    ids = chosen.join(sent, "batch_id").select("batch_id", "issue", F.explode("job_ids").alias("canonical_id"))
    known = ids.join(history.select("canonical_id"), "canonical_id", "left_semi")
    return known.groupBy("canonical_id").agg(F.min_by("issue", "batch_id").alias("issue_number"))


def issue_updates(blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """`(number, body)` of the issues whose text changes as blocks `(canonical_id, issue_number, block)` are laid into it."""
    own = blocks.groupBy(F.col("issue_number").alias("number")).agg(F.array_sort(F.collect_list(F.struct("canonical_id", "block"))).alias("blocks"))
    both = bodies.join(own, "number").withColumn("old", F.coalesce("body", F.lit("")))
    new = F.aggregate("blocks", F.col("old"), lambda body, x: render.upsert_block(body, x["canonical_id"], x["block"]))
    return both.withColumn("body", new).where("body <> old").select("number", "body")


def update_issues(updates: DataFrame, patch: Callable[[int, str], None]) -> DataFrame:
    """Patch the issues; `(number, done, error)`. Scans are stored before, so what fails is laid in by the next run without another scan."""
    return _each(updates, patch, "number", "body")


def scan_targets(retries: DataFrame, deliveries: DataFrame, backfill: DataFrame | None = None) -> DataFrame:
    """`(canonical_id, issue_number, origin)`: a delivery covers a retry, a backfill both; the first issue of each wins."""
    parts = [retries.select("canonical_id", "issue_number", F.lit(2).alias("rank"), F.lit("retry").alias("origin")), deliveries.select("canonical_id", "issue_number", F.lit(1).alias("rank"), F.lit("delivery").alias("origin"))]
    if backfill is not None:
        parts.append(backfill.select("canonical_id", "issue_number", F.lit(0).alias("rank"), F.lit("backfill").alias("origin")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy("canonical_id").agg(F.min_by(F.struct("issue_number", "origin"), F.struct("rank", "issue_number")).alias("b"))
    return best.select("canonical_id", "b.*")


def retryable(scans: DataFrame, history: DataFrame) -> DataFrame:
    """Failed scans that may be tried again."""
    open_scans = scans.where((F.col("status") == "failed") & (F.col("attempt_count") < V.SCAN_ATTEMPTS) & (F.col("issue_number") >= 1))
    return open_scans.join(history.select("canonical_id"), "canonical_id", "left_semi")


def recorded(scans: DataFrame, results: DataFrame) -> DataFrame:
    """Scans with new results laid over them: attempts counted on, the first time kept."""
    old = scans.select("canonical_id", F.col("attempt_count").alias("old_count"), F.col("first_scanned").alias("old_first"))
    new = results.join(old, "canonical_id", "left").withColumns({"attempt_count": F.coalesce("old_count", F.lit(0)) + 1, "first_scanned": F.coalesce("old_first", "last_scanned")}).drop("old_count", "old_first")
    return new.unionByName(scans.join(new.select("canonical_id"), "canonical_id", "left_anti"), allowMissingColumns=True)


def promoted_ids(batches: DataFrame, promotions: DataFrame) -> DataFrame:
    """Batches in which a fallback id that was taken over reads as the id that took it."""
    ids = batches.select("batch_id", F.explode("job_ids").alias("fallback_id")).join(promotions.select("fallback_id", "canonical_id"), "fallback_id", "left")
    named = ids.groupBy("batch_id").agg(F.array_sort(F.collect_set(F.coalesce("canonical_id", "fallback_id"))).alias("job_ids"))
    return batches.drop("job_ids").join(named, "batch_id", "left")


def expired(issues: DataFrame, now: str, days: int = V.ALERT_RETENTION_DAYS) -> DataFrame:
    """Alert issues (not pull requests, with a batch's mark) created up to `days` before `now`, that moment included.

    A time that can't be read, or has no zone, keeps its issue.
    """
    alert = F.col("pull_request").isNull() & F.col("body").rlike(BATCH_MARK)
    zoned = F.col("created_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    created = F.when(zoned, F.try_to_timestamp("created_at"))
    return issues.where(alert & (created <= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")))

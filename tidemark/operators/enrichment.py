"""Enrichment of alerts with what their forms ask: scans are stored before any alert is changed.

An entry's scan goes through two states. It is committed as pending, with its result, before the alert's text is touched; a second
commit clears it once the text has it. A run that ends between both leaves pending scans, which the next run lays into
their alerts without looking at a form again. Failed scans are tried again up to a bound; whatever else was found is
final. One entry's trouble, with its page, its result or its alert, is told and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.functions import values as V
from tidemark.functions.lineage import cut
from tidemark.sources import connectors, forms, state

from . import actions, inspection, outbox, render
from .sinks import Snapshots

_QUESTION = "struct<ordinal: int, label: string, field_type: string, required: boolean, options: array<string>, category: string, section: string, is_custom: boolean, field_name: string>"
SCAN = (
    "canonical_id string, provider string, application_url string, status string, reason string, error_message string, questions array<" + _QUESTION + ">, metadata string, "
    "attempt_count int, first_scanned string, last_scanned string, issue_number long, update_pending boolean"
)
FAILED = "Application inspection failed."


@dataclass
class Enrichment:
    """Ids by what came of them: looked at, stored, laid into their alerts, and failed in one of these (with `step` and `error`)."""

    attempted: DataFrame
    persisted: DataFrame
    updated: DataFrame
    failed: DataFrame


def static_inspection(fetcher: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """An inspector of public pages: their forms, as they are without scripts. fetcher: as of `connectors.public_pages`."""

    def inspect(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = targets.sparkSession
        pages = connectors.public_pages(targets.select(F.col("application_url").alias("url")).distinct(), fetcher)
        known = cut(targets.join(pages, targets["application_url"] == pages["url"]).drop("url"))  # pages are asked for once
        asked = forms.questions(known.select(F.col("canonical_id").alias("page_id"), "html"))
        counts = asked.groupBy("page_id").agg(F.count("*").alias("n_questions"))
        static = known.join(counts.withColumnRenamed("page_id", "canonical_id"), "canonical_id", "left").select("canonical_id", "http_status", "final_url", "html", F.coalesce("n_questions", F.lit(0)).cast("int").alias("n_questions"), "error")
        none = lambda like: spark.createDataFrame([], like.schema)
        schemas = spark.createDataFrame([], "canonical_id string, http_status int, n_questions int, error string")
        told = inspection.inspect(targets.select("canonical_id", "application_url"), schemas, static, none(static), none(static))
        return told, asked

    return inspect


def due(targets: DataFrame, scans: DataFrame, entries: DataFrame, attempts: int = V.SCAN_ATTEMPTS) -> DataFrame:
    """`(canonical_id, application_url, issue_number)` to look at: entries without a scan, or with a failed one below the bound."""
    had = scans.select("canonical_id", F.col("status").alias("was"), "attempt_count")
    again = F.col("was").isNull() | ((F.col("was") == "failed") & (F.col("attempt_count") < attempts))
    known = targets.join(had, "canonical_id", "left").where(again).select("canonical_id", F.col("issue_number").cast("long").alias("issue_number"))
    return known.join(entries.select("canonical_id", "application_url"), "canonical_id")


def records(looked_at: DataFrame, told: DataFrame, questions: DataFrame, now: str) -> DataFrame:
    """Scans of this run, pending: what an inspector said of each entry, or that it said nothing."""
    asked = forms.ordered(questions).select(F.col("page_id").alias("canonical_id"), F.col("questions").cast(f"array<{_QUESTION}>").alias("questions"))
    shown = lambda c, t="string": (F.col(f"t.{c}") if c in told.columns else F.lit(None)).cast(t)
    both = looked_at.alias("d").join(told.alias("t"), F.col("d.canonical_id") == F.col("t.canonical_id"), "left").join(asked.alias("q"), F.col("d.canonical_id") == F.col("q.canonical_id"), "left")
    none = F.col("t.canonical_id").isNull()
    return both.select(
        "d.canonical_id", F.when(none, urls.provider(F.col("d.application_url"))).otherwise(shown("provider")).alias("provider"), "d.application_url",
        F.when(none, "failed").otherwise(shown("status")).alias("status"), F.when(none, FAILED).otherwise(text.safe_message(shown("reason"))).alias("reason"),
        F.when(none, "no result").otherwise(text.safe_message(shown("error_message"))).alias("error_message"), F.coalesce("q.questions", F.array().cast(f"array<{_QUESTION}>")).alias("questions"),
        shown("metadata").alias("metadata"), F.lit(1).alias("attempt_count"), F.lit(now).alias("first_scanned"), F.lit(now).alias("last_scanned"), "d.issue_number", F.lit(True).alias("update_pending"),
    )


def violations(scans: DataFrame) -> DataFrame:
    """`(canonical_id, error)` of scans that mustn't be stored: the first rule of `state.scan_violations` that each breaks.

    Keys are read from the whole metadata, at any depth, as they are decoded.
    """
    own = scans.select("canonical_id", F.col("canonical_id").alias("key"), "provider", "application_url", "status", "attempt_count", "issue_number", "metadata", state.keys(F.coalesce("metadata", F.lit(""))).alias("metadata_keys"))
    return state.scan_violations(own).groupBy("canonical_id").agg(F.min("violation").alias("error"))


def pending_updates(scans: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(canonical_id, issue_number)` of pending scans, and `(number, body)` of the alerts whose text changes by them."""
    pending = scans.where("update_pending and issue_number >= 1")
    asked = pending.select(F.col("canonical_id").alias("page_id"), F.explode("questions").alias("q")).select("page_id", "q.*")
    blocks = render.scan_blocks(pending.select(F.col("canonical_id").alias("page_id"), "provider", "status", "application_url", "reason"), asked)
    own = pending.select("canonical_id", "issue_number").join(blocks.withColumnRenamed("page_id", "canonical_id"), "canonical_id")
    return own.select("canonical_id", "issue_number"), outbox.issue_updates(own, bodies)


def enrich(store: Snapshots, deliveries: DataFrame, entries: DataFrame, bodies: DataFrame, inspect: Callable, patch: str, now: str, backfill: DataFrame | None = None, attempts: int = V.SCAN_ATTEMPTS) -> Enrichment:
    """Look at the forms of delivered alerts' entries, store what was found, and lay it into the alerts.

    deliveries, backfill: `(canonical_id, issue_number)`; entries: `(canonical_id, application_url)`; bodies:
    `(number, body)` of the alerts as they are; inspect: `(targets) -> (results, questions)`, lazily; patch: a function
    named as `module:function`, which gets a row `(number, body)`. The table `scans` of the store is committed twice.
    """
    spark = store.spark
    scans = store.read("scans", SCAN)
    targets = outbox.scan_targets(outbox.retryable(scans, entries), deliveries, backfill)
    looked_at = cut(due(targets, scans, entries, attempts))
    try:
        told, questions = inspect(looked_at)
        found = cut(records(looked_at, told, questions, now))
    except Exception as error:  # an inspector that can't be had fails all its entries, and they are stored as such
        nothing = spark.createDataFrame([], "canonical_id string, status string"), spark.createDataFrame([], "page_id string, " + _QUESTION[7:-1])
        said = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        found = cut(records(looked_at, *nothing, now).withColumn("error_message", text.safe_message(F.lit(said))))
    broken = cut(violations(found))
    good = found.join(broken, "canonical_id", "left_anti")
    store.commit(keys={"scans": ["canonical_id"]}, scans=outbox.recorded(scans, good).select(scans.columns))

    stored = store.read("scans", SCAN)
    pending, updates = pending_updates(stored, bodies)
    pending = cut(pending)
    told = cut(actions.perform(updates, patch, f"{store.base}/updates", "number"))
    failed = told.where(f"status = '{actions.FAILED}'").select(F.col("key").cast("long").alias("issue_number"), "error")
    there = pending.join(bodies.select(F.col("number").alias("issue_number")).distinct(), "issue_number", "left_semi")
    updated = cut(there.join(failed, "issue_number", "left_anti").select("canonical_id"))
    cleared = stored.join(updated.withColumn("laid", F.lit(True)), "canonical_id", "left").withColumn("update_pending", F.col("update_pending") & F.col("laid").isNull()).select(stored.columns)
    store.commit(keys={"scans": ["canonical_id"]}, scans=cleared)

    absent = pending.join(bodies.select(F.col("number").alias("issue_number")), "issue_number", "left_anti").select("canonical_id", F.lit("update").alias("step"), F.lit("no such alert").alias("error"))
    wrong = pending.join(failed, "issue_number").select("canonical_id", F.lit("update").alias("step"), "error").unionByName(absent)
    scanned = good.where("status = 'failed'").select("canonical_id", F.lit("scan").alias("step"), F.col("error_message").alias("error"))
    return Enrichment(looked_at.select("canonical_id"), good.select("canonical_id"), updated, scanned.unionByName(broken.select("canonical_id", F.lit("store").alias("step"), "error")).unionByName(wrong))


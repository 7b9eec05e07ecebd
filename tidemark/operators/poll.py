"""A poll from the documents of all feeds to the committed history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.lineage import cut
from tidemark.sources import registry

from . import history, outbox, resolve
from .sinks import Snapshots

_TABLES = ["entities", "memberships", "sources", "batches"]
#: Tables that grow with history are committed by key, so a poll writes the buckets that it changes.
_KEYS = {"entities": ["canonical_id"], "memberships": ["canonical_id"], "batches": ["batch_id"]}


@dataclass
class Poll:
    """step: the history after the poll, new ids and counts; sources: `(source_id, ok, parsed, matching, error)`; changed: the tables committed;
    counts: one row with the observations, the entries they come to and how many repeat one."""

    step: history.Step
    sources: DataFrame
    changed: list[str]
    counts: DataFrame


def stored(store: Snapshots) -> history.History:
    """The committed history; an empty one before the first commit."""
    none = history.empty(store.spark)
    facts = store.read("facts", "initialized boolean, scope string").collect()
    tables = {t: store.read(t, getattr(none, t).schema) for t in _TABLES}
    return history.History(**tables, initialized=bool(facts and facts[0]["initialized"]), scope=facts[0]["scope"] if facts else None)


def run_poll(store: Snapshots, documents: DataFrame, at: str, initialize: bool = False, dry_run: bool = False) -> Poll:
    """Parse, filter, resolve and fold the documents `(source_id, format, body, error, priority, source_label, source_file, job_type)`.

    Sources whose poll isn't ok keep what they listed before; if none is ok, nothing is done and an error is raised. All
    tables are committed together, and none on a dry run.
    """
    spark = store.spark
    documents = documents.persist()  # as many rows as there are feeds
    polls, step, kept = registry.outcomes(documents).persist(), None, []
    try:
        told = polls.orderBy("source_id").collect()
        answered = [r["source_id"] for r in told if r["ok"]]
        if not answered:
            raise ValueError("no source answered: " + "; ".join(f"{r['source_id']}: {r['error']}" for r in told))
        rows = cut(registry.parse(documents.where(F.col("source_id").isin(answered))).where("valid").drop("valid"))  # each step is written, so that plans stay small
        matching = rows.where(text.location_matches(F.col("location")))
        observed = matching.withColumns({"run_id": F.lit(at), "obs_id": F.xxhash64("source_id", "company", "position", "location", "application_url", "source_url")})
        known = cut(resolve.identified(observed, documents.select("source_id", "priority")))
        members = cut(resolve.attach_wrappers(known))
        kept += [rows, known, members]
        step = history.apply_run(stored(store), members, answered, at, initialize)
        matching = members.groupBy("source_id").agg(F.count("*").alias("matching"))
        found = step.history.entities.join(members.select("canonical_id").distinct(), "canonical_id", "left_semi").select("canonical_id", "application_url", "url_aliases")
        summary = polls.join(matching, "source_id", "left").fillna(0, ["matching"]).select("source_id", "ok", "parsed", "matching", "error")
        summary = spark.createDataFrame(summary.collect(), summary.schema)
        counted = resolve.counts(members).drop("run_id")
        counted = spark.createDataFrame(counted.collect() or [(0, 0, 0)], counted.schema)  # one row; none where nothing matched
        changed = []
        if not dry_run:
            facts = spark.createDataFrame([(step.history.initialized, step.history.scope)], "initialized boolean, scope string")
            changed = store.commit(keys=_KEYS, **{t: getattr(step.history, t) for t in _TABLES}, facts=facts)
            outbox.index_links(store, found)
            step.history, counts = stored(store), step.counts.collect()
            step.counts = spark.createDataFrame(counts, step.counts.schema)
            step.new = spark.createDataFrame(step.new.collect(), step.new.schema)  # the ids of one alert
        return Poll(step, summary, changed, counted)
    finally:
        documents.unpersist()
        polls.unpersist()
        if step is not None:
            step.release()
        for df in kept:  # those that were kept in memory, there being no shared folder
            df.unpersist()

"""Stored history, one poll after another: the incremental form of the lifecycle.

Three tables and a row of facts are all that a poll needs of what was before. `apply_run` gives the next ones by joins
on the entity's id; what a poll doesn't touch is carried over as it is. Intermediate tables, which several results read, are
written to the shared folder, or else kept in memory until `Step.release`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.lineage import cut
from tidemark.functions import values as V

from . import lifecycle, outbox, resolve

VALUES = ["company", "position", "location", "salary", "application_url", "age", "category", "job_type", "posted", "season"]
STICKY = ["FAANG+", "Quant"]
_ENTITY = "canonical_id string, " + ", ".join(f"{c} string" for c in VALUES) + ", direct boolean, url_aliases array<string>, active boolean, first_seen {at}, last_seen {at}, inactive_at {at}"
_MEMBERSHIP = "canonical_id string, source_id string, first_seen {at}, last_seen {at}, inactive_at {at}, active boolean, v {v}"
_OUTBOX = "batch_id string, created_at {at}, issue_number int, job_ids array<string>, job_urls array<string>, status string, scan_eligible boolean"


@dataclass
class History:
    """entities: one row for each id, with values and lifecycle; memberships: for each id and source, with what it said
    last; sources: the ids that have answered before; batches: the outbox; initialized, scope: facts of the whole."""

    entities: DataFrame
    memberships: DataFrame
    sources: DataFrame
    batches: DataFrame
    initialized: bool = False
    scope: str | None = None


@dataclass
class Step:
    """What a poll comes to: the next history, the ids that are new and alert, and counts in one row."""

    history: History
    new: DataFrame
    counts: DataFrame
    baseline: bool
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what was kept for the tables above, once they are written."""
        for df in self.held:
            df.unpersist()


def empty(spark: SparkSession, at: str = "string") -> History:
    """A history before the first poll; at: the type of times."""
    meaning = spark.range(0).select(lifecycle.meaning(spark.range(0)).alias("v")).schema["v"].dataType.simpleString()
    table = lambda schema: spark.createDataFrame([], schema.format(at=at, v=meaning))
    return History(table(_ENTITY), table(_MEMBERSHIP), spark.createDataFrame([], "source_id string"), table(_OUTBOX), False, None)


def merged(old: str, new: str) -> dict[str, Column]:
    """An entity's values from what is stored and what was seen: what is known is never given up for less."""
    was, now = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    longer = lambda c: F.when(F.length(was(c)) > F.coalesce(F.length(now(c)), F.lit(0)), was(c)).otherwise(now(c))
    kept = F.coalesce(now("category") == "Unknown", F.lit(True)) | was("category").isin(STICKY)
    clean = text.counts_locations(was("location")) & ~text.counts_locations(now("location")) & now("location").isNotNull()
    return {
        "company": longer("company"),
        "position": longer("position"),
        "location": F.when(clean, now("location")).otherwise(longer("location")),
        "salary": F.coalesce(now("salary"), was("salary")),
        "application_url": F.when(was("direct") & ~now("direct"), was("application_url")).otherwise(now("application_url")),
        "age": F.coalesce(was("age"), now("age")),
        "category": F.when(was("category").isNotNull() & kept, was("category")).otherwise(now("category")),
        "job_type": now("job_type"),
        "posted": F.coalesce(now("posted"), was("posted")),
        "season": F.coalesce(now("season"), was("season")),
    }


def promotions(entities: DataFrame, found: DataFrame) -> DataFrame:
    """`(fallback_id, canonical_id)`: stored ids by key that a direct entity, new in this poll, takes over.

    The key is exact in all its fields; where several new entities have it, the one with the smallest id does.
    """
    key = text.fingerprint(*(F.col(c) for c in ("company", "position", "job_type", "location", "season")))
    direct = found.where(~F.col("canonical_id").startswith("fallback:")).join(entities.select("canonical_id"), "canonical_id", "left_anti")
    keyed = direct.select("canonical_id", F.concat(F.lit("fallback:"), key).alias("fallback_id"))
    stored = entities.select(F.col("canonical_id").alias("fallback_id"))
    return keyed.join(stored, "fallback_id").groupBy("fallback_id").agg(F.min("canonical_id").alias("canonical_id"))


def _renamed(rows: DataFrame, moved: DataFrame) -> DataFrame:
    taken = moved.select(F.col("fallback_id").alias("canonical_id"), F.col("canonical_id").alias("taken_by"))
    out = rows.join(taken, "canonical_id", "left").withColumn("canonical_id", F.coalesce("taken_by", "canonical_id"))
    return out.select(rows.columns)


def apply_run(history: History, members: DataFrame, answered: list[str], at, initialize: bool = False) -> Step:
    """The step of one poll.

    members: the poll's observations with their entity ids (as of `resolve.attach_wrappers`), of sources that answered;
    answered: these sources (if none is named, those with observations); at: the poll's time. A baseline (`initialize`,
    the first poll, or another scope than the stored one) alerts of nothing; nor does a source in its first poll.
    """
    spark, now = members.sparkSession, F.lit(at)
    answered = answered or [r[0] for r in members.select("source_id").distinct().collect()]
    baseline = initialize or not history.initialized or history.scope != V.SCOPE_VERSION
    found = resolve.resolved(members).withColumn("url_aliases", F.split("url_aliases", " "))
    found = cut(found.select("canonical_id", *((F.col(c) if c in found.columns else F.lit(None)).cast("string").alias(c) for c in VALUES), "direct", "url_aliases"))
    moved = cut(promotions(history.entities, found))
    entities, stored = _renamed(history.entities, moved), _renamed(history.memberships, moved)

    seen = resolve.per_source(members)
    seen = seen.select("canonical_id", "source_id", lifecycle.meaning(seen).alias("meaning"))
    before = stored.select("canonical_id", "source_id", F.struct("last_seen", "active").alias("was"))
    memberships = cut(lifecycle.fold(stored, seen, at, answered))
    told = memberships.join(before, ["canonical_id", "source_id"], "left").groupBy("canonical_id").agg(
        F.bool_or("active").alias("any_active"),
        F.bool_or(F.coalesce(F.col("active"), F.lit(False)) & (F.col("was").isNull() | ~F.col("last_seen").eqNullSafe(F.col("was.last_seen")))).alias("source_moved"),
    )

    both = entities.alias("o").join(found.alias("n"), F.col("o.canonical_id") == F.col("n.canonical_id"), "full_outer")
    both = both.select(F.coalesce("o.canonical_id", "n.canonical_id").alias("canonical_id"), F.when(F.col("o.canonical_id").isNotNull(), F.struct("o.*")).alias("o"), F.when(F.col("n.canonical_id").isNotNull(), F.struct("n.*")).alias("n"))
    both = both.join(told, "canonical_id", "left")
    is_new, is_seen, was_active = F.col("o").isNull(), F.col("n").isNotNull(), F.coalesce("o.active", F.lit(False))
    values = {c: F.when(is_new, F.col(f"n.{c}")).when(is_seen, v).otherwise(F.col(f"o.{c}")) for c, v in merged("o", "n").items()}
    out = both.withColumns({f"m_{c}": v for c, v in values.items()})
    aliases = F.array_sort(F.array_union(F.coalesce("o.url_aliases", F.array().cast("array<string>")), F.coalesce("n.url_aliases", F.array().cast("array<string>"))))
    differs = ~F.struct(*(f"m_{c}" for c in VALUES)).eqNullSafe(F.struct(*(F.col(f"o.{c}").alias(f"m_{c}") for c in VALUES))) | (F.size(F.array_except("n.url_aliases", "o.url_aliases")) > 0)
    active = F.coalesce("any_active", F.lit(False))
    moves = is_seen & (differs | F.col("source_moved") | ~was_active)
    out = out.select(
        "canonical_id",
        *(F.col(f"m_{c}").alias(c) for c in VALUES),
        (F.coalesce("o.direct", F.lit(False)) | F.coalesce("n.direct", F.lit(False))).alias("direct"),
        aliases.alias("url_aliases"),
        active.alias("active"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(is_new | F.coalesce(moves, F.lit(False)), now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(active, F.lit(None)).when(was_active, now).otherwise(F.col("o.inactive_at")).alias("inactive_at"),
        is_new.alias("is_new"),
        was_active.alias("was_active"),
    )
    out = cut(out)
    ready = history.sources.select("source_id").distinct()
    alerting = seen.join(ready, "source_id", "left_semi").select("canonical_id").distinct()
    new = out.where(F.col("is_new") & F.lit(not baseline)).join(alerting, "canonical_id", "left_semi").select("canonical_id", "application_url")
    batch = new.groupBy().agg(F.array_sort(F.collect_list("canonical_id")).alias("job_ids"), F.array_sort(F.collect_list("application_url")).alias("job_urls")).where(F.size("job_ids") > 0)
    batch = batch.select(F.sha2(F.array_join("job_ids", "\n"), 256).alias("batch_id"), now.alias("created_at"), F.lit(None).cast("int").alias("issue_number"), "job_ids", "job_urls", F.lit("pending").alias("status"), F.lit(True).alias("scan_eligible"))
    batches = outbox.append(outbox.promoted_ids(history.batches, moved).select(history.batches.columns), batch)
    counts = out.agg(
        F.count_if(F.col("is_new")).alias("added"),
        F.count_if(~F.col("is_new") & F.col("was_active") & ~F.col("active")).alias("inactive"),
        F.count_if(~F.col("is_new") & ~F.col("was_active") & F.col("active")).alias("reactivated"),
    )
    named = spark.createDataFrame([(x,) for x in answered], "source_id string")
    following = History(out.drop("is_new", "was_active"), memberships, ready.union(named).distinct(), batches, True, V.SCOPE_VERSION)
    return Step(following, new, counts, baseline, [found, moved, memberships, out])


def current(history: History) -> DataFrame:
    """Active entities without their lifecycle, each with what its active sources said last, in order of sources."""
    said = history.memberships.where("active").groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "v"))).alias("sources"))
    return history.entities.where("active").drop("direct", "active", "first_seen", "last_seen", "inactive_at").join(said, "canonical_id", "left")

"""The lifecycle of entities over polls, in closed form and poll by poll.

A failed poll says nothing: a source's memberships change only in runs in which it answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

#: What makes an observation another one; ages pass by themselves, and so do some keys of the metadata.
MEANINGFUL = ["company", "position", "job_type", "location", "salary", "application_url", "category", "season"]
#: What also counts where observations have it, and keys of their metadata that don't.
SOURCED = ["posted", "source_url", "source_job_id", "source_file", "source_label"]
VOLATILE = ["age", "feedUpdatedAt"]


def meaning(observed: DataFrame) -> Column:
    """What is compared of an observation: columns that it lacks count as null, and metadata as sorted pairs."""
    parts = [(F.col(c) if c in observed.columns else F.lit(None)).cast("string").alias(c) for c in MEANINGFUL + SOURCED]
    none = F.lit(None).cast("array<struct<key: string, value: string>>")
    pairs = F.array_sort(F.map_entries(F.map_filter("source_metadata", lambda k, v: ~k.isin(VOLATILE)))) if "source_metadata" in observed.columns else none
    return F.struct(*parts, F.when(F.size(pairs) > 0, pairs).alias("metadata"))


def answered(members: DataFrame, polls: DataFrame) -> DataFrame:
    """Observations of polls that succeeded."""
    return members.join(polls.where("ok").select("run_id", "source_id"), ["run_id", "source_id"], "left_semi")


def changes(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """Observations (one for each run, entity and source) with `changed` and `reactivated` against the one before."""
    w = Window.partitionBy("canonical_id", "source_id").orderBy("run_id")
    observed = observed.withColumn("meaning", meaning(observed))
    differs = ~F.col("meaning").eqNullSafe(F.lag("meaning").over(w))
    out = observed.withColumn("before", F.lag("run_id").over(w)).withColumn("changed", F.col("before").isNull() | differs)
    return _gap(out, polls)


def _gap(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """`reactivated`: the source answered without the entry between this observation and the one before."""
    order = Window.partitionBy("source_id").orderBy("run_id")
    number = polls.where("ok").select("run_id", "source_id", F.row_number().over(order).alias("n"))
    prior = number.select(F.col("run_id").alias("before"), "source_id", F.col("n").alias("n_before"))
    out = observed.join(number, ["run_id", "source_id"]).join(prior, ["before", "source_id"], "left")
    return out.withColumn("reactivated", F.coalesce(F.col("n") - F.col("n_before") > 1, F.lit(False))).drop("n", "n_before")


def memberships(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """`(canonical_id, source_id, first_seen, last_seen, inactive_at, active)` after the last run."""
    pairs = changes(observed, polls).groupBy("canonical_id", "source_id").agg(
        F.min("run_id").alias("first_seen"),
        F.max(F.when(F.col("changed") | F.col("reactivated"), F.col("run_id"))).alias("last_seen"),
        F.max("run_id").alias("last_observed"),
    )
    order = Window.partitionBy("source_id").orderBy("run_id")
    after = polls.where("ok").select("source_id", F.col("run_id").alias("last_observed"), F.lead("run_id").over(order).alias("inactive_at"))
    out = pairs.join(after, ["source_id", "last_observed"], "left")  # the next answer after the last one that had it
    return out.select("canonical_id", "source_id", "first_seen", "last_seen", "inactive_at", F.col("inactive_at").isNull().alias("active"))


def entities(members: DataFrame) -> DataFrame:
    """An entity is active while a membership is, and ends with its last one."""
    active = F.bool_or("active")
    return members.groupBy("canonical_id").agg(active.alias("active"), F.min("first_seen").alias("first_seen"), F.when(~active, F.max("inactive_at")).alias("inactive_at"), F.count("*").alias("sources"))


def links(members: DataFrame) -> DataFrame:
    """`(canonical_id, application_url, since)`: each link of an entity, and the run that had it first; none is ever lost."""
    return members.where("application_url is not null").groupBy("canonical_id", "application_url").agg(F.min("run_id").alias("since"))


def aliases(members: DataFrame) -> DataFrame:
    """`(canonical_id, url_aliases)`: an entity's links over all runs, sorted."""
    return links(members).groupBy("canonical_id").agg(F.array_sort(F.collect_list("application_url")).alias("url_aliases"))


def link_changes(members: DataFrame) -> DataFrame:
    """`(run_id, canonical_id, adds)`: whether a run has a link of the entity that none before it had."""
    new = links(members).select("canonical_id", F.col("since").alias("run_id"), F.lit(True).alias("adds")).distinct()
    seen = members.select("canonical_id", "run_id").distinct()
    return seen.join(new, ["canonical_id", "run_id"], "left").select("run_id", "canonical_id", F.coalesce("adds", F.lit(False)).alias("adds"))


def activity(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """`(canonical_id, run_id, active)` at each run in which it may change: an observation, or the answer behind the last one.

    Between these, each source's last word holds, over failed polls too, so no row for every pair and run is made.
    """
    order = Window.partitionBy("source_id").orderBy("run_id")
    answers = polls.where("ok").select("source_id", "run_id", F.lead("run_id").over(order).alias("next"))
    seen = observed.select("canonical_id", "source_id", "run_id").join(answers, ["source_id", "run_id"])
    again = F.lead("run_id").over(Window.partitionBy("canonical_id", "source_id").orderBy("run_id"))
    seen = seen.withColumn("gone", F.when(again.isNull() | (F.col("next") < again), F.col("next")))
    came = F.lag("gone").over(Window.partitionBy("canonical_id", "source_id").orderBy("run_id"))
    first = F.row_number().over(Window.partitionBy("canonical_id", "source_id").orderBy("run_id")) == 1
    steps = seen.withColumn("up", (first | came.isNotNull()).cast("int"))
    moves = steps.select("canonical_id", "run_id", F.col("up").alias("step")).union(seen.where("gone is not null").select("canonical_id", F.col("gone").alias("run_id"), F.lit(-1)))
    sums = moves.groupBy("canonical_id", "run_id").agg(F.sum("step").alias("step"))
    active = F.sum("step").over(Window.partitionBy("canonical_id").orderBy("run_id")) > 0
    return sums.select("canonical_id", "run_id", active.alias("active"))


def transitions(active: DataFrame) -> DataFrame:
    """For each run in which any do, how many entities end and how many come back."""
    w = Window.partitionBy("canonical_id").orderBy("run_id")
    moved = active.withColumn("was", F.lag("active").over(w))
    counts = moved.groupBy("run_id").agg(F.count_if(F.col("was") & ~F.col("active")).alias("inactive"), F.count_if(~F.col("was") & F.col("active")).alias("reactivated"))
    return counts.where("inactive + reactivated > 0")


def _step(bar: Column, place: Column) -> Column:
    return F.struct(bar.cast("int").alias("bar"), place.alias("place"))


def _then(a: Column, b: Column) -> Column:
    """Two steps as one. A step keeps a place that is longer than its bar, and else puts its own in its stead, which is no longer
    than the bar; so what two steps do has that form too, and any number of them can be put together in any grouping."""
    left = F.when(F.length(a["place"]) > b["bar"], a["place"]).otherwise(b["place"])
    return F.when(a["bar"] > b["bar"], _step(a["bar"], left)).otherwise(b)


def running_location(rows: DataFrame, runs: int | None = None) -> DataFrame:
    """`rows` (one for each run and entity) with `location` as folded up to their run: the longer stays, of equally long ones the
    later, but a mere count of places gives way to the next place. Null locations say nothing.

    runs: the most rows of an entity, counted where it isn't given; an entity that has more is an error.

    Behind a place the fold always stands at a place: the one before, or this one if that was shorter or had given way to a count
    in between. Such steps are put together by doubling, each round over twice as many rows, so an entity's n runs take n log n
    time and no list of them. Rounds share one shuffle and one order of rows, which may spill.
    """
    if runs is None:
        runs = rows.groupBy("canonical_id").count().agg(F.max("count")).first()[0] or 0
    w = Window.partitionBy("canonical_id").orderBy("run_id")
    counts = text.counts_locations(F.col("location"))
    is_place = F.col("location").isNotNull() & ~counts
    marked = rows.withColumns({"_place": is_place, "_block": F.count_if(is_place).over(w), "_ordinal": F.row_number().over(w)})
    within = Window.partitionBy("canonical_id", "_block").orderBy("run_id")
    longest = F.max_by("location", F.when(counts, F.struct(F.length("location"), F.col("run_id"))))
    found = marked.withColumn("_count", longest.over(within)).withColumn("_before", F.length(F.lag("_count").over(w)))
    own = _step(F.greatest(F.length("location"), F.col("_before")), F.col("location"))
    found = found.withColumn("_steps", F.when(F.col("_place"), own).otherwise(_step(F.lit(-1), F.lit(None).cast("string"))))
    for r in range(max(runs - 1, 0).bit_length()):
        before = F.col("_earlier")
        found = found.withColumn("_earlier", F.lag("_steps", 2**r).over(w))
        found = found.withColumn("_steps", F.when(before.isNull(), F.col("_steps")).otherwise(_then(before, F.col("_steps"))))
    place, count = F.col("_steps.place"), F.col("_count")
    folded = F.when(count.isNotNull() & (place.isNull() | (F.length(count) >= F.length(place))), count).otherwise(place)
    more = F.raise_error(F.concat(F.lit(f"more than {runs} runs of "), F.col("canonical_id"))).cast("string")
    return found.withColumn("location", F.when(F.col("_ordinal") > runs, more).otherwise(folded)).select(rows.columns)


def survivorship(resolved: DataFrame, runs: int | None = None) -> DataFrame:
    """Each entity's values as of each run: what is known is never given up for less. runs: as in `running_location`."""
    w = Window.partitionBy("canonical_id").orderBy("run_id")
    kept = lambda c: F.last(c, ignorenulls=True).over(w)
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.col("run_id"))).over(w)
    sticky = F.first(F.when(F.col("category").isin("FAANG+", "Quant"), F.col("category")), ignorenulls=True).over(w)
    known = kept(F.when(F.col("category") != "Unknown", F.col("category")))
    return running_location(resolved, runs).select(
        "run_id",
        "canonical_id",
        longest("company").alias("company"),
        longest("position").alias("position"),
        "location",
        kept("salary").alias("salary"),
        F.first("age", ignorenulls=True).over(w).alias("age"),
        F.coalesce(sticky, known, F.lit("Unknown")).alias("category"),
        F.coalesce(kept(F.when(F.col("direct"), F.col("application_url"))), "application_url").alias("application_url"),
        "job_type",
    )


def new_entities(observed: DataFrame, polls: DataFrame, baselines: list[int]) -> DataFrame:
    """Entities that alert in their first run: not a baseline run, and seen by a source that had answered before."""
    first = observed.groupBy("canonical_id").agg(F.min("run_id").alias("run_id"))
    since = polls.where("ok").groupBy("source_id").agg(F.min("run_id").alias("since"))
    seen = observed.join(first, ["canonical_id", "run_id"], "left_semi").join(since, "source_id").where("since < run_id")
    return seen.where(~F.col("run_id").isin(baselines)).select("run_id", "canonical_id").distinct()


def batches(new: DataFrame) -> DataFrame:
    """The pending alert of each run; its id depends on its members alone."""
    ids = F.array_sort(F.collect_set("canonical_id"))
    return new.groupBy("run_id").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("batch_id"), F.size(ids).cast("long").alias("entries"), F.lit("pending").alias("status"))


def promotions(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """`(fallback_id, canonical_id, run_id)`: wrapper-only entries that a direct one with the same key takes over."""
    first = resolved.groupBy("canonical_id").agg(F.min("run_id").alias("first_run"), F.min_by(F.struct("company", "position", "job_type", "location", "season"), "run_id").alias("v"))
    key = text.fingerprint(*(F.col(f"v.{c}") for c in ("company", "position", "job_type", "location", "season")))
    direct = first.where(~F.col("canonical_id").startswith("fallback:")).select("canonical_id", F.col("first_run").alias("run_id"), F.concat(F.lit("fallback:"), key).alias("fallback_id"))
    earlier = first.where(F.col("canonical_id").startswith("fallback:")).select(F.col("canonical_id").alias("fallback_id"), F.col("first_run").alias("fallback_run"))
    found = direct.join(earlier, "fallback_id").where("fallback_run < run_id")
    return found.groupBy("fallback_id").agg(F.min_by("canonical_id", F.struct("run_id", "canonical_id")).alias("canonical_id"), F.min("run_id").alias("run_id"))


def fold(state: DataFrame, observed: DataFrame, run, answered_sources: list[str]) -> DataFrame:
    """One poll on stored memberships: the incremental form of `memberships`.

    state: its columns, the last values (`v`); observed: one row for each entity and source of the run.
    """
    new = observed.select("canonical_id", "source_id", (F.col("meaning") if "meaning" in observed.columns else meaning(observed)).alias("now"))
    both = state.join(new, ["canonical_id", "source_id"], "full_outer")
    seen, said = F.col("now").isNotNull(), F.col("source_id").isin(answered_sources)
    moved = F.col("first_seen").isNull() | ~F.coalesce("active", F.lit(False)) | ~F.col("v").eqNullSafe(F.col("now"))
    return both.select(
        "canonical_id",
        "source_id",
        F.coalesce("first_seen", F.lit(run)).alias("first_seen"),
        F.when(seen & moved, F.lit(run)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, F.lit(None)).when(said & F.col("active"), F.lit(run)).otherwise(F.col("inactive_at")).alias("inactive_at"),
        F.when(seen, True).when(said, False).otherwise(F.col("active")).alias("active"),
        F.coalesce("now", "v").alias("v"),
    )

"""Entity resolution: which observations are one entry, and whose values it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, urls

#: Values that an entity takes from its strongest observation that has them.
FIRST = ["salary", "age", "category", "posted", "season"]
#: Values of which it takes the longest.
LONGEST = ["company", "position", "location"]


#: What an observation's identity and fallback key are made of.
NAMING = ["application_url", "company", "position", "job_type", "location", "season"]


def identified(obs: DataFrame, priorities: DataFrame) -> DataFrame:
    """Observations with their link's identity, the fallback key and their strength.

    priorities: `(source_id, priority)`; a source without one comes last. Polls repeat what they list, so identities and keys
    are worked out once for each set of the values that they are made of, in as many tasks as shuffles have.
    """
    known = obs.join(priorities, "source_id", "left").withColumn("priority", F.coalesce("priority", F.lit(1_000_000)))
    named = urls.with_identity(obs.select(NAMING).distinct(), "application_url")
    named = named.withColumn("fingerprint", text.fingerprint(*(F.col(c) for c in ("company", "position", "job_type", "location", "season"))))
    named = named.withColumnsRenamed({c: f"_{c}" for c in NAMING})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in NAMING]  # nulls are values here
    known = known.join(named, same, "left").drop(*(f"_{c}" for c in NAMING))
    return known.withColumn("strength", F.when(F.col("stable"), 0).when(F.col("direct"), 1).otherwise(2))


def attach_wrappers(known: DataFrame) -> DataFrame:
    """Entity ids: the link's own, and for an aggregator's link that of the only direct entry with its fallback key.

    Direct entries of a key agree if the least and the greatest of their ids do, so no distinct count is needed.
    """
    ends = known.where("direct").groupBy("run_id", "fingerprint").agg(F.min("canonical_id").alias("least"), F.max("canonical_id").alias("greatest"))
    only = ends.where("least = greatest").select("run_id", "fingerprint", F.col("least").alias("only_id"))
    wrapped = F.coalesce("only_id", F.concat(F.lit("fallback:"), "fingerprint"))
    out = known.join(only, ["run_id", "fingerprint"], "left")
    return out.withColumn("canonical_id", F.when(F.col("direct"), F.col("canonical_id")).otherwise(wrapped)).drop("only_id")


def _order(*before: Column) -> Column:
    return F.struct(*before, *map(F.col, ("strength", "priority", "application_url", "source_id", "company", "position", "obs_id")))


def _has(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def first_of(name: str) -> Column:
    return F.min_by(name, F.when(_has(name), _order()))


def longest_of(name: str) -> Column:
    return F.min_by(name, F.when(_has(name), _order((-F.length(name)).alias("size"))))


def per_source(members: DataFrame) -> DataFrame:
    """One observation for each entity and source: the strongest."""
    best = members.groupBy("run_id", "canonical_id", "source_id").agg(F.min_by(F.struct(*(c for c in members.columns if c not in ("run_id", "canonical_id", "source_id"))), _order()).alias("o"))
    return best.select("run_id", "canonical_id", "source_id", "o.*")


def resolved(members: DataFrame) -> DataFrame:
    """One row for each run and entity; its aliases are the links and, where observations have them, the source links of the survivors."""
    named = F.array("application_url", "source_url") if "source_url" in members.columns else F.array("application_url")
    own = F.filter(named, lambda u: u != "")
    links = per_source(members).groupBy("run_id", "canonical_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))), " ").alias("url_aliases"))
    taken = [longest_of(c).alias(c) for c in LONGEST] + [first_of(c).alias(c) for c in FIRST if c in members.columns]
    best = members.groupBy("run_id", "canonical_id").agg(
        *taken,
        F.min_by("application_url", _order()).alias("application_url"),
        F.min_by("job_type", _order()).alias("job_type"),
        F.min_by("direct", _order()).alias("direct"),
        F.count("*").alias("observations"),
    )
    best = best.withColumn("category", F.coalesce("category", F.lit("Unknown")))
    return best.join(links, ["run_id", "canonical_id"])


def counts(members: DataFrame) -> DataFrame:
    """`(run_id, observations, entities, duplicates)`: how many observations are entries of a run, and how many repeat one.

    Entities are counted as groups, so no task holds the ids of a run."""
    each = members.groupBy("run_id", "canonical_id").agg(F.count("*").alias("n"))
    found = each.groupBy("run_id").agg(F.sum("n").alias("observations"), F.count("*").alias("entities"))
    return found.withColumn("duplicates", F.col("observations") - F.col("entities"))


def source_labels(members: DataFrame) -> DataFrame:
    """The sorted distinct labels (ids, where sources have none) of each entity's sources and run, joined; `Unknown` if there are none."""
    label = F.coalesce(F.nullif(F.col("source_label"), F.lit("")), F.col("source_id")) if "source_label" in members.columns else F.col("source_id")
    names = F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(label, F.lit("")))), ", "), F.lit("")), F.lit("Unknown"))
    return members.groupBy("run_id", "canonical_id").agg(names.alias("labels"))

"""Feeds that are one JSON object with an array of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions import values as V

FIELDS = ["id", "company", "title", "location", "category", "season", "eligibility", "matchKind", "listingUrl", "url", "posted", "age"]
CATEGORY = "Software Engineering"


def _kind(variant: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({variant})"), F.lit(""))


def _string(variant: str, field: str) -> Column:
    """A field that is a string, trimmed and not empty; numbers and other values are none."""
    at = f"try_variant_get({variant}, '$.{field}', 'variant')"
    return F.when(_kind(at) == "STRING", text.nonempty(F.expr(f"try_variant_get({variant}, '$.{field}', 'string')")))


def rows(documents: DataFrame) -> DataFrame:
    """`(source_id, index, <fields>, updated_at, object, error)`: one row for each job, or one with an error for a broken feed."""
    parsed = documents.select("source_id", F.try_parse_json("body").alias("d"))
    there = _kind("try_variant_get(d, '$.jobs', 'variant')").startswith("ARRAY")
    error = F.when(F.col("d").isNull(), "not valid JSON").when(~there, "no array of jobs")
    told = parsed.select("source_id", _string("d", "updatedAt").alias("updated_at"), error.alias("error"), F.expr("try_variant_get(d, '$.jobs', 'array<variant>')").alias("jobs"))
    jobs = told.select("source_id", "updated_at", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("jobs"))).alias("index", "j"))
    return jobs.select("source_id", "index", *(_string("j", f).alias(f) for f in FIELDS), "updated_at", _kind("j").startswith("OBJECT").alias("object"), "error")


def _observations(jobs: DataFrame, category: Column, season: Column, kept_keys: list[str]) -> DataFrame:
    link = F.coalesce("listingUrl", "url")
    pairs = [F.lit(k) if i == 0 else F.col(k) for k in kept_keys for i in (0, 1)]
    metadata = F.map_filter(F.create_map(*pairs, F.lit("feedUpdatedAt"), F.col("updated_at")), lambda k, v: v.isNotNull())
    out = jobs.select("source_id", "index", "company", F.col("title").alias("position"), "location", link.alias("application_url"), F.col("id").alias("source_job_id"), F.col("url").alias("source_url"), "posted", "age", season.cast("string").alias("season"), category.alias("category"), metadata.alias("source_metadata"), "in_scope", "object", "error")
    whole = F.forall(F.array("company", "position", "location", "application_url"), lambda x: x.isNotNull())
    return out.withColumn("valid", whole)


def software(jobs: DataFrame) -> DataFrame:
    """All jobs as observations, and which of them are in scope."""
    scoped = jobs.withColumn("in_scope", F.col("error").isNull() & (F.lower("category") == CATEGORY.lower()))
    return _observations(scoped, F.lit(CATEGORY), F.col("season"), ["id", "url", "listingUrl", "category", "season", "posted", "age"])


def early(jobs: DataFrame) -> DataFrame:
    scoped = jobs.withColumn("in_scope", F.col("error").isNull() & F.col("eligibility").isin(V.LEVELS) & text.has_any(F.lower("title"), V.TITLE_TOKENS))
    return _observations(scoped, F.lit("Unknown"), F.lit(None), ["id", "url", "listingUrl", "eligibility", "matchKind", "posted", "age"])


def internships(documents: DataFrame) -> DataFrame:
    return _kept(software(rows(documents)))


def new_graduates(documents: DataFrame) -> DataFrame:
    """Early-career rows whose title names software work; the feed has no categories."""
    return _kept(early(rows(documents)))


def _kept(read: DataFrame) -> DataFrame:
    return read.where("in_scope").drop("in_scope", "object", "error")


def _told(read: DataFrame) -> DataFrame:
    feed = read.groupBy("source_id").agg(
        F.count("index").alias("candidates"), F.count_if(F.col("index").isNotNull() & ~F.col("object")).alias("broken"), F.max("error").alias("feed_error"),
        F.count_if(F.col("in_scope") & F.col("valid")).alias("parsed"), F.count_if(F.col("in_scope") & ~F.col("valid")).alias("lacking"),
    )
    error = F.coalesce("feed_error", F.when(F.col("parsed") == 0, "no valid rows"))
    return feed.select("source_id", F.lit(CATEGORY).alias("category"), "candidates", "parsed", (F.col("broken") + F.col("lacking")).alias("skipped"), error.alias("error"))


def diagnose(documents: DataFrame, scope=software) -> DataFrame:
    """`(source_id, category, candidates, parsed, skipped, error)`: one row for each document; a feed without valid rows has an error.

    Candidates are all jobs of the feed; skipped ones aren't objects, or are in scope and lack what is required. Jobs are read once.
    """
    return _told(scope(rows(documents)))


def both(documents: DataFrame, hold, scope=software) -> tuple[DataFrame, DataFrame]:
    """What `diagnose` tells and the observations, of jobs that are read once and held in between."""
    read = hold(scope(rows(documents)))
    return _told(read), _kept(read)

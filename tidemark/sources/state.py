"""Stored histories as JSON: the present layout, and the old one by link."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text, urls
from tidemark.functions import values as V

VERSION = 2
_RECORD = "struct<company: string, position: string, location: string, salary: string, application_url: string, age: string, category: string, job_type: string, source_file: string, active: boolean, first_seen: string, last_seen: string, inactive_at: string, url_aliases: array<string>, sources: map<string, struct<active: boolean, first_seen: string, last_seen: string, inactive_at: string, source_label: string>>>"
_STATE = f"struct<schema_version: int, initialized: boolean, initialized_at: string, location_scope_version: string, initialized_sources: map<string, boolean>, jobs: map<string, {_RECORD}>>"

# Parts of keys that a stored scan must not have.
PROHIBITED = ["answer", "resume", "coverletter", "candidate", "cookie", "csrf", "token", "authorization", "credential", "password", "localstorage"]
STATUSES = ["complete", "partial", "unsupported", "unavailable", "failed"]


_QUESTIONS = "struct<schema_version: int, scans: map<string, string>>"


def _file(spark: SparkSession, path: str, schema: str, versions: list[int], what: str) -> DataFrame:
    """`(state)` of a JSON file; one with all fields null if there is no file, an error if its version isn't known or it isn't JSON."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.range(1).select(F.from_json(F.lit('{"jobs": {}, "scans": {}}'), schema).alias("state"))
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("state"))
    known = F.coalesce(F.col("state.schema_version").isin(versions), F.lit(False))
    return parsed.select(F.when(known, F.col("state")).otherwise(F.raise_error(F.lit(f"not {what} of a known version"))).alias("state"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """`(state)` of a history file."""
    return _file(spark, path, _STATE, [1, VERSION], "a history")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """`(state)` of a file of active entries."""
    return _file(spark, path, _STATE, [1, VERSION], "a current state")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """`(canonical_id, record)` of a file of scans, each record as JSON; a record with a prohibited key, at any depth, is an error."""
    scans = _file(spark, path, _QUESTIONS, [1], "questions").select(F.explode("state.scans").alias("canonical_id", "record"))
    checked = F.when(prohibited(F.col("record")), F.raise_error(F.concat(F.lit("prohibited field in scan "), F.col("canonical_id")))).otherwise(F.col("record"))
    return scans.select("canonical_id", checked.alias("record"))


def entries(state: DataFrame) -> DataFrame:
    """One row for each entity; records of the old layout get their identity and are merged where it is the same."""
    rows = state.select(F.col("state.schema_version").alias("version"), F.explode("state.jobs").alias("key", "job"))
    rows = rows.withColumn("canonical_id", F.when(F.col("version") == VERSION, F.col("key")).otherwise(urls.identity(F.coalesce("job.application_url", "key"))["canonical_id"]))
    aliases = F.array_distinct(F.concat(F.coalesce("job.url_aliases", F.array().cast("array<string>")), F.array(F.coalesce("job.application_url", "key"))))
    first = F.struct(F.col("job.first_seen"), F.col("key"))
    merged = rows.groupBy("canonical_id").agg(F.min_by("job", first).alias("job"), F.bool_or("job.active").alias("active"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(aliases)))).alias("url_aliases"))
    return merged.select("canonical_id", *(f"job.{c}" for c in ("company", "position", "location", "salary", "application_url", "age", "category", "job_type", "first_seen", "last_seen", "inactive_at")), "active", "url_aliases")


def memberships(state: DataFrame) -> DataFrame:
    """`(canonical_id, source_id, active, first_seen, last_seen, inactive_at)` of the present layout."""
    rows = state.where(f"state.schema_version = {VERSION}").select(F.explode("state.jobs").alias("canonical_id", "job"))
    return rows.select("canonical_id", F.explode("job.sources").alias("source_id", "s")).select("canonical_id", "source_id", "s.active", "s.first_seen", "s.last_seen", "s.inactive_at")


def needs_baseline(state: DataFrame) -> DataFrame:
    """Whether the next run is silent: a first run, or another scope than the stored one."""
    return state.select((~F.coalesce("state.initialized", F.lit(False)) | ~F.col("state.location_scope_version").eqNullSafe(F.lit(V.SCOPE_VERSION))).alias("baseline"))


def scan_violations(scans: DataFrame) -> DataFrame:
    """`(canonical_id, violation)` of stored scans (`canonical_id, key, provider, status, attempt_count, issue_number, metadata_keys`).

    Where scans have them, a link has to be there, and metadata to be one JSON object.
    """
    bad_key: Column = F.exists(F.transform("metadata_keys", text.key_name), lambda k: text.has_any(k, PROHIBITED))
    rules = {
        "key": ~F.col("key").eqNullSafe(F.col("canonical_id")),
        "provider": text.nonempty(F.col("provider")).isNull(),
        "status": ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)),
        "attempts": F.coalesce(F.col("attempt_count") < 1, F.lit(True)),
        "issue": F.coalesce(F.col("issue_number") < 1, F.lit(True)),
        "prohibited field": F.coalesce(bad_key, F.lit(False)),
    }
    if "application_url" in scans.columns:
        rules["link"] = text.nonempty(F.col("application_url")).isNull()
    if "metadata" in scans.columns:
        rules["metadata"] = F.col("metadata").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("metadata")).startswith("OBJECT"), F.lit(False))
    broken = F.filter(F.array(*(F.when(test, name) for name, test in rules.items())), lambda x: x.isNotNull())
    return scans.select("canonical_id", F.explode(broken).alias("violation"))


#: What JSON is made of: an escaped character, a quote, or a run of anything else.
_TOKEN = r"""(?s)(\\.|"|[^\\"]+)"""


def keys(record: Column) -> Column:
    """All keys of a JSON text, at any depth, as they are read: a fold over its tokens gives the strings that a colon follows, and
    each is decoded, so an escaped letter is that letter."""

    def step(s: Column, token: Column) -> Column:
        quote, inside = token == '"', s["inside"]
        is_key = ~inside & ~quote & s["last"].isNotNull() & token.rlike(r"^[ \t\r\n]*:")
        return F.struct(
            F.when(quote, ~inside).otherwise(inside).alias("inside"),
            F.when(quote, "").when(inside, F.concat(s["text"], token)).otherwise(s["text"]).alias("text"),
            F.when(quote & inside, s["text"]).when(quote | inside, F.lit(None).cast("string")).otherwise(F.lit(None).cast("string")).alias("last"),
            F.when(is_key, F.array_append(s["keys"], s["last"])).otherwise(s["keys"]).alias("keys"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("text"), F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("keys"))
    written = F.aggregate(F.regexp_extract_all(record, F.lit(_TOKEN), 1), start, step, lambda s: s["keys"])
    return F.transform(written, lambda k: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), k, F.lit('"]')), "array<string>"), F.lit(0)), k))


def key_names(record: Column) -> Column:
    """All keys of a JSON text, at any depth, folded: letters and digits alone, in lower case."""
    return F.transform(keys(record), lambda k: text.key_name(k))


def prohibited(record: Column) -> Column:
    """Whether a JSON text has, at any depth, a key that a stored scan must not have."""
    return F.coalesce(F.exists(key_names(record), lambda k: text.has_any(k, PROHIBITED)), F.lit(False))


@F.pandas_udf(T.StringType())
def pruned(record: pd.Series) -> pd.Series:
    """A JSON text without sensitive keys, at any depth, and with the others sorted; null where it isn't JSON."""

    def kept(value):
        if isinstance(value, dict):
            return {k: kept(v) for k, v in sorted(value.items()) if not any(t in "".join(c for c in k.casefold() if c.isalnum()) for t in V.SENSITIVE)}
        return [kept(v) for v in value] if isinstance(value, list) else value

    def one(text):
        try:
            return None if text is None else json.dumps(kept(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    return record.map(one)

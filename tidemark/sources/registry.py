"""Feeds by format: parsers that give observations, and diagnoses that tell whether a poll answered."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

from . import html_table, json_feed, markdown

PARSERS = {"markdown": markdown.parse, "json_internships": json_feed.internships, "json_new_graduates": json_feed.new_graduates, "html_table": html_table.parse}
DIAGNOSES = {"markdown": markdown.diagnose, "json_internships": json_feed.diagnose, "json_new_graduates": partial(json_feed.diagnose, scope=json_feed.early), "html_table": html_table.diagnose}
#: Both at once, of feeds that are read once.
READERS = {"markdown": markdown.both, "json_internships": json_feed.both, "json_new_graduates": partial(json_feed.both, scope=json_feed.early), "html_table": html_table.both}
#: What an observation holds, and the type; a parser gives what its feed has.
COLUMNS = {
    "source_id": "string", "company": "string", "position": "string", "location": "string", "salary": "string", "application_url": "string", "age": "string", "category": "string",
    "source_job_id": "string", "source_url": "string", "posted": "string", "season": "string", "source_metadata": "map<string,string>", "valid": "boolean",
}
#: What is known of a source itself.
PROVENANCE = ["source_label", "source_file", "job_type"]


def _by_format(documents: DataFrame, functions: dict) -> list[DataFrame]:
    return [f(documents.where((documents["format"] == name) & F.col("body").isNotNull()).select("source_id", "body")) for name, f in functions.items()]


def parse(documents: DataFrame) -> DataFrame:
    """Observations of `(source_id, format, body)`, and of the source's `PROVENANCE` where documents have it; an unknown format is an error."""
    unknown = {r["format"] for r in documents.select("format").distinct().collect()} - set(PARSERS)
    if unknown:
        raise ValueError(f"unknown feed formats: {sorted(unknown)}")
    return _shown(_by_format(documents, PARSERS), documents)


def _shown(parsed: list[DataFrame], documents: DataFrame) -> DataFrame:
    known = [c for c in PROVENANCE if c in documents.columns]
    shown = lambda d: d.select(*((F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))
    rows = reduce(DataFrame.unionByName, map(shown, parsed))
    return rows.join(documents.select("source_id", *known), "source_id") if known else rows


def diagnose(documents: DataFrame) -> DataFrame:
    """`(source_id, category, candidates, parsed, skipped, error)` of every expected category of every document with a body."""
    return reduce(DataFrame.unionByName, _by_format(documents, DIAGNOSES))


def outcomes(documents: DataFrame) -> DataFrame:
    """`(source_id, ok, parsed, error)` of each document: what its poll came to.

    A document that wasn't fetched, whose format isn't known, or one of whose categories is broken says nothing of its
    source: the poll isn't ok, and what the source listed before stays as it is.
    """
    return _outcomes(documents, diagnose(documents))


def _outcomes(documents: DataFrame, diagnosed: DataFrame) -> DataFrame:
    told = diagnosed.groupBy("source_id").agg(F.sum("parsed").alias("parsed"), F.min(F.when(F.col("error").isNotNull(), F.struct("category", "error"))).alias("first"))
    known = documents.join(told, "source_id", "left")
    given = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    missing = F.when(F.col("body").isNull(), F.coalesce(given, F.lit("not fetched"))).when(~F.coalesce(F.col("format").isin(list(PARSERS)), F.lit(False)), "no parser for this format")
    error = F.coalesce(missing, F.when(F.col("first").isNotNull(), F.concat_ws(": ", "first.category", "first.error")))
    return known.select("source_id", error.isNull().alias("ok"), F.coalesce("parsed", F.lit(0)).alias("parsed"), error.alias("error"))


def healthy(documents: DataFrame) -> DataFrame:
    """Valid observations of the documents that answered; each is read once."""
    told, parsed = zip(*_by_format(documents, {name: partial(f, hold=cut) for name, f in READERS.items()}))
    polls = _outcomes(documents, reduce(DataFrame.unionByName, told))
    return _shown(parsed, documents).where("valid").join(polls.where("ok").select("source_id"), "source_id", "left_semi").drop("valid")


def inferred(source_file: Column, job_type: Column) -> Column:
    """`struct(source_id, source_label)` of records that were written before sources had names."""
    # What the first two feeds were called.
    named = F.when((source_file == "README.md") & (job_type == "Internship"), "speedyapply_internships").when((source_file == "NEW_GRAD_USA.md") & (job_type == "New Grad"), "speedyapply_new_grad")
    return F.struct(F.coalesce(named, F.lit("legacy_speedyapply")).alias("source_id"), F.lit("SpeedyApply").alias("source_label"))


def with_provenance(records: DataFrame) -> DataFrame:
    """`records` with `source_id` and `source_label` inferred where they are missing or empty."""
    guess = inferred(F.col("source_file"), F.col("job_type"))
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if c in records.columns else F.lit(None).cast("string"), guess[c]) for c in ("source_id", "source_label")}
    return records.withColumns(filled)

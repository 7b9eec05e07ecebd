"""Feeds of Markdown tables between markers, parsed with native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions import values as V

#: Column names by field, in order of preference.
COLUMNS = {
    "company": ["company"], "position": ["position", "role", "job title"], "location": ["location"], "posting": ["posting", "application", "apply"],
    "salary": ["salary", "compensation", "pay"], "age": ["age", "posted", "posting age"],
}
#: An escaped character, a tag with quoted values, and code, each up to the row's end if it isn't closed; then a cell, with its
#: separator. What may repeat never gives back what it took, so a row of any length is read once.
_ESCAPED = r"\\(?:.|\z)"
_QUOTED = "|".join(rf"{q}(?:{_ESCAPED}|[^\\{q}]++)*+(?:{q}|\z)" for q in "\"'")
_TAG = rf"<(?:{_ESCAPED}|{_QUOTED}|[^\\\"'>]++)*+(?:>|\z)"
_CODE = rf"`(?:{_ESCAPED}|{_TAG}|[^\\<`]++)*+(?:`|\z)"
_CELL = rf"(?s)((?:{_ESCAPED}|{_TAG}|{_CODE}|[^\\<`|]++)*+)(?:\||\z)"
#: A category is rejected if it skips so many rows, and more than it parses.
MANY_SKIPPED = 5


def cells(line: Column) -> Column:
    """The cells of a row; pipes after a backslash, in tags and in code don't separate. Null if it has no first pipe.

    What a tag, a quoted value in it or code opens stays open until it is closed, or the row ends. One pattern reads the row; it
    also finds an empty cell behind the end.
    """
    found = lambda row: F.regexp_extract_all(F.substr(row, F.lit(2)), F.lit(_CELL), 1)
    split = lambda row: text.let(found(row), lambda all_: F.transform(F.slice(all_, F.lit(1), F.size(all_) - 1), text.strip))
    return text.let(text.strip(line), lambda row: F.when(row.startswith("|"), split(row)))


def apply_link(cell: Column) -> Column:
    """The link of the anchor that says apply (by its image or its text), else of a Markdown link that does."""
    anchors = F.regexp_extract_all(cell, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)
    says = lambda a: a.rlike(r"(?is)<img[^>]*\salt\s*=\s*[\"']\s*apply\s*[\"']") | (F.lower(F.trim(F.regexp_replace(a, "<[^>]*>", ""))) == "apply")
    anchor = F.try_element_at(F.filter(anchors, says), F.lit(1))
    href = F.nullif(F.regexp_extract(anchor, r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    markdown = F.nullif(F.regexp_extract(cell, r"(?i)\[\s*apply(?:\s+now)?\s*\]\(\s*<?([^\s>)]+)>?(?:\s+[^)]*)?\)", 1), F.lit(""))
    return text.unescape(F.coalesce(href, markdown))


def sections(documents: DataFrame) -> DataFrame:
    """`(source_id, category, section)`; null where a category hasn't exactly one pair of markers."""
    times = lambda m: (F.length("body") - F.length(F.replace(F.col("body"), F.lit(m), F.lit("")))) / len(m)
    each = []
    for category, (start, end) in V.TABLE_MARKERS.items():
        found = F.regexp_extract("body", f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)
        in_order = F.instr("body", start) < F.instr("body", end)
        each.append(F.struct(F.lit(category).alias("category"), F.when((times(start) == 1) & (times(end) == 1) & in_order, found).alias("section")))
    return documents.select("source_id", F.explode(F.array(*each)).alias("s")).select("source_id", "s.*")


#: Of lines as `table_lines` has them: those that are rows.
_IS_ROW = "separated and not stray and cells is not null and line > header.line + 1"


def _lines(documents: DataFrame) -> DataFrame:
    """`table_lines`, and one line without a row, which isn't `marked`, for each section that is null."""
    lines = sections(documents).select("source_id", "category", F.col("section").isNotNull().alias("marked"), F.posexplode_outer(F.split("section", r"\r?\n")).alias("line", "row"))
    parsed = lines.withColumn("row", text.strip(F.col("row"))).withColumn("cells", cells(F.col("row")))
    parsed = parsed.withColumn("plain", F.transform("cells", text.clean_cell))
    names = F.transform("plain", F.lower)
    is_header = F.forall(F.array(*map(F.lit, ("company", "position", "location"))), lambda n: F.array_contains(names, n)) & F.arrays_overlap(names, F.array(*map(F.lit, COLUMNS["posting"])))
    w = Window.partitionBy("source_id", "category")
    known = parsed.withColumn("header", F.min(F.when(is_header, F.struct("line", names.alias("names")))).over(w))
    is_separator = (F.size("cells") == F.size("header.names")) & F.forall("cells", lambda c: c.rlike("^:?-{3,}:?$"))
    behind = F.col("line") - F.col("header.line")
    flags = {"separated": F.max((behind == 1) & is_separator).over(w), "stray": F.max((behind > 1) & (F.col("row") != "") & F.col("cells").isNull()).over(w)}
    return known.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def table_lines(documents: DataFrame) -> DataFrame:
    """`(source_id, category, line, row, cells, plain, header, separated, stray)` of every line of each section.

    header: the place and names of the first line with all required names, null if there is none; separated: whether
    the line behind it is a separator; stray: whether something that isn't a row is behind both.
    """
    return _lines(documents).where("marked").drop("marked")


def _valued(rows: DataFrame, *kept: str) -> DataFrame:
    """Lines with the values that they have as rows, and whether these are all there."""
    # 1 + the place of the first name that the header has
    at = lambda field: F.coalesce(*(F.nullif(F.array_position("header.names", F.lit(n)), F.lit(0).cast("long")) for n in COLUMNS[field])).cast("int")
    cell = lambda field: F.try_element_at(F.col("cells"), at(field))
    plain = lambda field: text.nonempty(F.try_element_at(F.col("plain"), at(field)))
    fits = F.size("cells") == F.size("header.names")
    out = rows.select("source_id", "category", "line", *kept, fits.alias("fits"), *(plain(f).alias(f) for f in ("company", "position", "location", "salary", "age")), text.nonempty(apply_link(cell("posting"))).alias("application_url"))
    whole = F.col("fits") & F.forall(F.array("company", "position", "location", "application_url"), lambda x: x.isNotNull())
    return out.withColumns({"source_url": F.col("application_url"), "valid": whole}).drop("fits")


def parse(documents: DataFrame) -> DataFrame:
    """`(source_id, category, line, company, position, location, salary, age, application_url, source_url, valid)` of every row."""
    return _valued(table_lines(documents).where(_IS_ROW))


def diagnose(documents: DataFrame) -> DataFrame:
    """`(source_id, category, candidates, parsed, skipped, error)`: one row for every expected category of every document.

    Lines are read once: rows are counted among all of them."""
    return _told(_read(documents))


def _read(documents: DataFrame) -> DataFrame:
    """All lines with the values that they have as rows, and what is known of their tables."""
    lines = _lines(documents).withColumns({"headed": F.col("header").isNotNull(), "is_row": F.expr(_IS_ROW)})
    return _valued(lines, "marked", "headed", "separated", "stray", "is_row")


def both(documents: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What `diagnose` tells and what `parse` gives, of lines that are read once and held in between."""
    read = hold(_read(documents))
    return _told(read), read.where("marked and is_row").drop("marked", "headed", "separated", "stray", "is_row")


def _told(rows: DataFrame) -> DataFrame:
    known = rows.groupBy("source_id", "category").agg(*(F.bool_or(c).alias(c) for c in ("marked", "headed", "separated", "stray")), F.count_if("is_row").alias("candidates"), F.count_if(F.col("is_row") & F.col("valid")).alias("parsed"))
    known = known.withColumn("skipped", F.col("candidates") - F.col("parsed"))
    error = (
        F.when(~F.col("marked"), "not exactly one pair of markers in order")
        .when(~F.col("headed"), "no compatible table")
        .when(~F.col("separated"), "no separator behind the header")
        .when(F.col("stray"), "something else than rows behind the header")
        .when((F.col("candidates") > 0) & (F.col("parsed") == 0), "none of the rows could be parsed")
        .when((F.col("skipped") >= MANY_SKIPPED) & (F.col("skipped") > F.col("parsed")), "more rows malformed than parsed")
    )
    return known.select("source_id", "category", "candidates", "parsed", "skipped", error.alias("error"))


def health(rows: DataFrame) -> DataFrame:
    """Counts by category of rows that there are, and whether these may change the history; `diagnose` also knows of tables without rows."""
    found = rows.groupBy("source_id", "category").agg(F.count("*").alias("candidates"), F.count_if("valid").alias("parsed"))
    skipped = F.col("candidates") - F.col("parsed")
    return found.select("*", skipped.alias("skipped"), ((F.col("parsed") > 0) & ~((skipped >= MANY_SKIPPED) & (skipped > F.col("parsed")))).alias("healthy"))

"""Deterministic texts: dashboard, alert bodies, question blocks.

The dashboard is a table of lines in order, however many; a body or block is one text for the few entries of a batch
or the questions of a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

# Headings, placeholders and notes.
COLUMNS = ["Company", "Position", "Type", "Category", "Location", "Sources", "Salary", "First Seen", "Last Seen", "Active", "Application"]
SECTIONS = [(True, "Active Jobs", "_No active matching jobs_"), (False, "Historical / Closed or Removed Jobs", "_No historical matching jobs_")]
GENERATED = "<!-- This file is generated automatically. Do not edit manually. -->"
NO_BASELINE = "No baseline has been established yet. The first successful run records current matches without creating an alert."
ORDER = {
    "job_specific": "Custom screening questions", "work_authorization": "Work authorization", "education": "Education", "experience": "Experience",
    "location_logistics": "Location and logistics", "other": "Other visible questions",
}
READ_ONLY = "> Application scanning is read-only. No application was submitted, no answers were entered, and no files were uploaded."
PARTIAL = "> This scan is partial: conditional, multi-step, or authentication-gated fields may not be visible."
_UNSAFE = [" ", "<", ">", '"', "(", ")", "[", "]", "{", "}", "|", "\\", "^", "`", "'", ",", ";", "!", "*", "$", "@"]


def row_line(first_seen: str = "first_seen", last_seen: str = "last_seen") -> Column:
    """An entity's row of the dashboard."""
    cell = lambda c, default="": text.markdown_cell(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)))
    plain = [cell(c) for c in ("company", "position", "job_type", "category", "location")]
    link = text.markdown_cell(F.concat(F.lit("[Apply](<"), F.col("application_url"), F.lit(">)")))
    parts = [*plain, cell("labels", "Unknown"), cell("salary", "N/A"), cell(first_seen), cell(last_seen), F.when(F.col("active"), "Yes").otherwise("No"), link]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def dashboard(entities: DataFrame, title: str, about: str, initialized: bool = True) -> DataFrame:
    """`(line)`, in order, of entities with their source `labels`: active ones and then the others, each part newest
    first, then by name, position and link, behind a heading with its count."""
    spark = entities.sparkSession
    head = [GENERATED, "", f"# {title}", "", about, ""]
    if not initialized:
        return spark.createDataFrame([(x,) for x in [*head, NO_BASELINE, ""]], "line string")
    table = ["| " + " | ".join(COLUMNS) + " |", "|" + "---|" * len(COLUMNS)]
    rows = entities.select(
        F.when(F.col("active"), 0).otherwise(1).alias("section"), F.lit(1).alias("part"), F.col("first_seen").alias("newest"),
        F.struct(F.lower("company"), F.lower("position"), "application_url").alias("name"), F.lit(0).alias("at"), row_line().alias("line"),
    )
    counts = {r["section"]: r["n"] for r in rows.groupBy("section").agg(F.count("*").alias("n")).collect()}
    fixed = [(0, 0, i, x) for i, x in enumerate(head)]
    for section, (_, heading, none) in enumerate(SECTIONS):
        n = counts.get(section, 0)
        lines = [*([""] if section else []), f"## {heading} ({n})", "", *table, *([] if n else [f"| {none} |" + "  |" * (len(COLUMNS) - 1)])]
        fixed += [(section, 0, len(head) + i, x) for i, x in enumerate(lines)]
    fixed.append((len(SECTIONS), 0, 0, ""))
    around = spark.createDataFrame(fixed, "section int, part int, at int, line string")
    return rows.unionByName(around, allowMissingColumns=True).orderBy("section", "part", F.desc("newest"), "name", "at").select("line")


def alert_bodies(entries: DataFrame, title: str = "New postings", footer: str = "Detected automatically.") -> DataFrame:
    """`(batch_id, title, body)` of a batch's entries in order of name, position and id, with the batch's marker."""
    shown = lambda c, default="": F.coalesce(F.nullif((F.col(c) if c in entries.columns else F.lit(None)).cast("string"), F.lit("")), F.lit(default))
    item = lambda name, c, default="": F.concat(F.lit(f"- **{name}:** "), shown(c, default))
    posted = F.when(shown("posted") != "", item("Posted", "posted"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("## "), shown("company")), F.lit(""), F.concat(F.lit("**"), shown("position"), F.lit("**")), F.lit(""), item("Type", "job_type"), item("Category", "category"), item("Location", "location"),
        item("Sources", "labels", "Unknown"), item("Salary", "salary", "N/A"), item("Age", "age", "N/A"), posted, F.lit(""),
        F.concat(F.lit("### [Apply to "), shown("company"), F.lit(" →](<"), shown("application_url"), F.lit(">)")), F.lit(""), F.lit("---"), F.lit(""),
    )
    key = F.struct(F.lower("company").alias("a"), F.lower("position").alias("b"), F.col("canonical_id").alias("c"), lines.alias("lines"))
    found = entries.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["lines"]), "\n").alias("blocks"))
    marker = F.concat(F.lit("<!-- batch:v1:"), F.col("batch_id"), F.lit(" -->"))
    return found.select("batch_id", text.alert_title(F.col("n")).alias("title"), F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), "blocks", F.lit(footer), F.lit(""), marker, F.lit("")).alias("body"))


def test_body(link: str | None = None) -> str:
    """The body of a test alert, or of one that awaits the questions of a link; it has no batch, so retention leaves it."""
    marks = "<!-- test:scan:v1 -->" if link else "<!-- test:alert:v1 -->"
    said = [f"**Test application:** [Open public application](<{link}>)", "", "Visible public questions are added to it behind this text."] if link else ["It is not an alert: no feed was read and no history changed."]
    return "\n".join(["# Test notification", "", "This is a manually requested test.", "", *said, "", marks, ""])


def _quoted(link: Column) -> Column:
    """A link that can stand between angle brackets."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}")), _UNSAFE, link)


def scan_blocks(scans: DataFrame, questions: DataFrame) -> DataFrame:
    """`(page_id, block)` of `scans(page_id, provider, status, application_url, reason)` and their questions.

    Custom questions come first, then the others by category; profile and compliance questions are collapsed.
    """
    told = F.when(F.col("required"), "Required").when(~F.col("required"), "Optional").otherwise("Requirement not stated")
    options = F.when(F.size("options") > 0, F.concat(F.lit("Options: "), F.array_join(F.transform("options", text.escape_text), " / ")))
    details = F.concat_ws(" — ", told, F.replace("field_type", F.lit("_"), F.lit(" ")), options)
    line = F.concat(F.col("ordinal").cast("string"), F.lit(". **"), text.escape_text(F.col("label")), F.lit("**  \n   "), details)
    names = [*ORDER, "profile", "resume_documents", "compliance_demographic"]
    rank = F.when(F.col("is_custom"), 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("category")), F.lit(0).cast("long")).cast("int"), F.lit(len(names) + 1)))
    key = F.struct(rank.alias("rank"), "ordinal", F.lower("label").alias("low"), F.coalesce("field_name", F.lit("")).alias("name"), line.alias("line"))
    found = questions.groupBy("page_id").agg(F.array_sort(F.collect_list(key)).alias("k"), F.count("*").alias("n"), F.count_if("is_custom").alias("custom"))
    all_of = scans.join(found, "page_id", "left").withColumn("k", F.coalesce("k", F.array().cast(found.schema["k"].dataType)))

    def lines_of(*ranks: int) -> Column:
        each = [F.filter("k", lambda x: x["rank"] == F.lit(r)) for r in ranks]  # called at once, so each has its own rank
        return F.array_join(F.transform(F.flatten(F.array(*each)), lambda x: x["line"]), "\n")

    def part(heading: str, *ranks: int) -> Column:
        lines = lines_of(*ranks)
        return F.when(lines != "", F.concat(F.lit(f"### {heading}\n\n"), lines))

    def folded(summary: str, *ranks: int) -> Column:
        lines = lines_of(*ranks)
        return F.when(lines != "", F.concat(F.lit(f"<details>\n<summary>{summary}</summary>\n\n"), lines, F.lit("\n\n</details>")))

    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    head = F.concat(
        F.lit("**Scan status:** "), F.initcap("status"), F.lit("  \n**Provider:** "), F.initcap("provider"), F.lit("  \n**Questions detected:** "), count("n"),
        F.lit("  \n**Custom / screening questions:** "), count("custom"),
    )
    notes = F.concat_ws("\n", F.lit(READ_ONLY), F.when(F.col("status") == "partial", PARTIAL))
    sections = [part("Custom screening questions", 0), *(part(h, i + 1) for i, h in enumerate(ORDER.values()))]
    collapsed = [folded("Standard application fields", 7, 8), folded("Optional compliance / demographic fields", 9), part("Other", len(names) + 1)]
    block = F.concat_ws("\n\n", F.lit("## Application Questions"), head, F.concat(F.lit("[Open application](<"), _quoted(F.col("application_url")), F.lit(">)")), F.concat(F.lit("> "), F.nullif("reason", F.lit(""))), *sections, *collapsed, notes)
    return all_of.select("page_id", F.concat(block, F.lit("\n")).alias("block"))


def upsert_block(body: Column, target: Column | str, block: Column) -> Column:
    """`body` with the target's block, in either spelling of its marks, replaced where it has one, else behind the rest; the block is literal text."""
    name = F.lit(target) if isinstance(target, str) else target
    mark = lambda kind, gap: F.concat(F.lit(f"<!-- scan:{kind}{gap}"), name, F.lit(" -->"))
    start, end = mark("start", " "), mark("end", " ")
    whole = F.concat(start, F.lit("\n"), block, F.lit("\n"), end)
    gap = F.when((body == "") | body.endswith("\n"), "").otherwise("\n")
    out = F.concat(body, gap, F.lit("\n"), whole, F.lit("\n"))
    for first, last in ((mark("start", ":"), mark("end", ":")), (start, end)):  # the older spelling counts where the present one isn't found
        at = F.position(first, body)
        to = F.position(last, body, at + F.length(first))
        out = F.when((at > 0) & (to > 0), F.concat(F.substring(body, F.lit(1), at - 1), whole, F.substr(body, to + F.length(last)))).otherwise(out)
    return out

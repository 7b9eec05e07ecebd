"""Feeds and pages as texts, and what is to be read from them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import render
from tidemark.sources import forms, html_table, json_feed, markdown, registry

MARKDOWN = """# Feed
<!-- TABLE_FAANG_START -->
| Company | Position | Location | Salary | Posting | Age |
|---|:---|---|---|---|---|
| <a href="https://a.example" title="x|y"><strong>Alpha</strong></a> | Engineer \\| Core | Palo Alto, CA +1 | $50/hr | <a href="https://a.example"><img alt="logo"></a> <a href="https://jobs.lever.co/alpha/1"><img src="b.png" alt="Apply"></a> | 1d |
| Beta | Engineer | Oakland, CA | | <a href="https://b.example/info">Info</a> | 2d |
<!-- TABLE_FAANG_END -->
<!-- TABLE_QUANT_START -->
| Company | Position | Location | Application |
|---|---|---|---|
| Gamma &amp; Co | *Quant* Dev | SF, CA | [Apply now](https://g.example/apply?x=1) |
<!-- TABLE_QUANT_END -->
<!-- TABLE_START -->
| Company | Position | Location | Salary | Posting | Age |
|---|---|---|---|---|---|
| Delta | [Dev](https://d.example) | Remote | $1 | <a class="b" href='https://d.example/j'>Apply</a> | 3d
| too | few |
<!-- TABLE_END -->
"""
INTERNSHIPS = json.dumps({"updatedAt": "2026-01-01", "jobs": [
    {"id": "1", "company": " Acme ", "title": "SWE Intern", "location": "San Jose, CA", "category": "Software Engineering", "listingUrl": "https://x.example/1", "url": "https://y.example/1"},
    {"id": "2", "company": "Acme", "title": "PM", "location": "Reno, NV", "category": "Product", "url": "https://y.example/2"},
    {"id": "3", "company": "", "title": "SWE", "location": "Reno, NV", "category": "software engineering", "url": "https://y.example/3"},
]})
GRADUATES = json.dumps({"jobs": [
    {"company": "Bolt", "title": "Backend Engineer", "location": "Novato, CA", "eligibility": "New Grad", "url": "https://z.example/1"},
    {"company": "Bolt", "title": "Product Manager", "location": "Novato, CA", "eligibility": "New Grad", "url": "https://z.example/2"},
    {"company": "Bolt", "title": "Answer Analyst", "location": "Novato, CA", "eligibility": "Senior", "url": "https://z.example/3"},
]})
TABLE = """## Other
## 💻 Software Engineering Internship Roles
<table><tr><th>Company</th><th>Role</th><th>Location</th><th>Application</th><th>Age</th></tr>
<tr><td>🔥 <b>Orbit</b></td><td>SWE Intern 🎓</td><td>San Mateo, CA<br/>Austin, TX</td><td><a href="https://simplify.jobs/p/abc"><img alt="Simplify"></a><a href="https://orbit.example/j/1"><img alt="Apply"></a></td><td>1d</td></tr>
<tr><td>↳</td><td>Data Intern</td><td><details><summary>2 locations</summary>SF, CA<br>NY</details></td><td><a href="https://simplify.jobs/p/def">Apply</a></td><td>2d</td></tr>
<tr><td>Nova</td><td>SWE</td><td>SF</td></tr></table>
## Archived Software Engineering Internship Roles (old)
<table><tr><td>Old</td></tr></table>
"""
FORM = """<header><input name="q" placeholder="Search"></header><form>
<label for="n">Full name *</label><input id="n" name="full_name" required>
<label>Email <input type="email" name="email" aria-required="false"></label>
<span id="t">Phone number</span><input type="tel" aria-labelledby="t">
<textarea name="cover_letter"></textarea><input type="hidden" name="z"><input type="submit">
<label for="c">Country</label><select id="c" name="country"><option>Select</option><option>US</option><option>us</option><option>FR</option></select>
<fieldset><legend>Do you need visa sponsorship?</legend><label><input type="radio" name="v" value="y" required> Yes</label><label><input type="radio" name="v" value="n"> No</label></fieldset>
<fieldset><legend>Skills</legend><label><input type="checkbox" name="s"> SQL</label><label><input type="checkbox" name="s"> Java</label></fieldset>
<div style="display: none"><input name="trap"></div></form>"""
SCHEMA = json.dumps({"questions": [
    {"label": "First Name", "required": True, "fields": [{"name": "first_name", "type": "input_text", "values": []}]},
    {"label": "Geo", "required": False, "fields": [{"name": "lat", "type": "input_hidden"}]},
    {"label": "Why us?", "required": "no", "fields": [{"name": "q1", "type": "textarea", "values": []}]},
    {"label": "Office", "fields": [{"name": "q2", "type": "multi_value_single_select", "values": [{"label": "SF", "value": 1}, {"label": "sf", "value": 2}, "NY"]}]},
], "compliance": [{"label": "Consent", "required": True, "fields": [{"name": "c", "type": "checkbox"}]}], "demographic_questions": None})


def _documents(spark: SparkSession, **bodies: str) -> DataFrame:
    return spark.createDataFrame([*bodies.items()], "source_id string, body string")


def markdown_table_scan(spark, sf_dir):
    return markdown.parse(_documents(spark, feed=MARKDOWN)).select("category", "company", "position", "location", "salary", "age", "application_url", "valid")


def markdown_health(spark, sf_dir):
    return markdown.health(markdown.parse(_documents(spark, feed=MARKDOWN))).drop("source_id")


def json_feed_scan(spark, sf_dir):
    one = json_feed.internships(_documents(spark, internships=INTERNSHIPS, broken="{"))
    two = json_feed.new_graduates(_documents(spark, graduates=GRADUATES))
    metadata = F.array_join(F.transform(F.array_sort(F.map_entries("source_metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return one.union(two).select("source_id", "company", "position", "application_url", "category", metadata.alias("metadata"), "valid")


def html_table_scan(spark, sf_dir):
    return html_table.parse(_documents(spark, feed=TABLE)).select("row", "company", "position", "location", "application_url", "source_url", "source_job_id", "age", "category", "valid")


def feed_dispatch(spark, sf_dir):
    rows = [("m", "markdown", MARKDOWN), ("i", "json_internships", INTERNSHIPS), ("g", "json_new_graduates", GRADUATES), ("h", "html_table", TABLE)]
    found = registry.parse(spark.createDataFrame(rows, "source_id string, format string, body string"))
    return found.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if("valid").alias("parsed"))


def _broken(spark: SparkSession) -> DataFrame:
    """Feeds that are whole, broken in one way each, or weren't fetched."""
    lines = MARKDOWN.splitlines()
    malformed = "\n".join(x.replace("Apply now", "More").replace('alt="Apply"', 'alt="More"') for x in lines)
    rows = [
        ("whole", "markdown", MARKDOWN, None),
        ("no_marker", "markdown", MARKDOWN.replace("<!-- TABLE_QUANT_END -->", ""), None),
        ("no_header", "markdown", MARKDOWN.replace("| Company | Position | Location | Application |", "| Company | Position | Application |"), None),
        ("no_separator", "markdown", MARKDOWN.replace("\n|---|---|---|---|\n", "\n"), None),
        ("stray", "markdown", MARKDOWN.replace("| Beta |", "Note.\n| Beta |"), None),
        ("malformed", "markdown", malformed, None),
        ("no_json", "json_internships", "{", None),
        ("no_array", "json_internships", '{"jobs": {}}', None),
        ("no_rows", "json_new_graduates", '{"jobs": [5, {"title": "SWE", "eligibility": "New Grad"}]}', None),
        ("typed", "json_internships", INTERNSHIPS.replace('" Acme "', "5"), None),
        ("no_section", "html_table", TABLE.replace("Engineering Internship", "Engineering"), None),
        ("no_columns", "html_table", TABLE.replace("<th>Age</th>", ""), None),
        ("table", "html_table", TABLE, None),
        ("away", "markdown", None, "HTTP 500"),
        ("other", "csv", "a,b", None),
    ]
    return spark.createDataFrame(rows, "source_id string, format string, body string, error string")


def _diagnosed(spark, *sources: str) -> DataFrame:
    return registry.diagnose(_broken(spark).where(F.col("source_id").isin(*sources))).select("source_id", "category", "candidates", "parsed", "error")


def feed_missing_marker(spark, sf_dir):
    return _diagnosed(spark, "no_marker")


def feed_missing_header(spark, sf_dir):
    return _diagnosed(spark, "no_header", "no_separator", "stray")


def feed_all_malformed(spark, sf_dir):
    return _diagnosed(spark, "malformed", "typed")


def poll_outcomes(spark, sf_dir):
    """Which polls answered, and why others didn't; a broken feed is never an empty one."""
    return registry.outcomes(_broken(spark))


def healthy_observations(spark, sf_dir):
    """Observations with all that their feeds tell; none of a source whose poll didn't answer."""
    metadata = F.array_join(F.transform(F.array_sort(F.map_entries("source_metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return registry.healthy(_broken(spark)).select("source_id", "company", "position", "salary", "age", "season", "source_job_id", metadata.alias("metadata"))


def provenance_infer(spark, sf_dir):
    """Names of the sources of records that carry a file and a type only."""
    rows = [(1, "README.md", "Internship", None, None), (2, "NEW_GRAD_USA.md", "New Grad", "", None), (3, "README.md", "New Grad", None, ""), (4, "README.md", "Internship", "own", "Own")]
    return registry.with_provenance(spark.createDataFrame(rows, "id int, source_file string, job_type string, source_id string, source_label string")).select("id", "source_id", "source_label")


def _shown(questions: DataFrame) -> DataFrame:
    return questions.select("ordinal", "label", "field_type", "required", F.array_join("options", "|").alias("options"), "category", "section", "is_custom", "field_name")


def html_form_extract(spark, sf_dir):
    return _shown(forms.questions(spark.createDataFrame([(1, FORM)], "page_id int, html string")))


def ats_schema_extract(spark, sf_dir):
    return _shown(forms.schema_questions(spark.createDataFrame([(1, SCHEMA)], "page_id int, payload string")))


def scan_block_render(spark, sf_dir):
    found = forms.questions(spark.createDataFrame([(1, FORM)], "page_id int, html string"))
    scans = spark.createDataFrame([(1, "generic", "partial", "https://x.example/a b?c=(1)", "Only a part.")], "page_id int, provider string, status string, application_url string, reason string")
    return render.scan_blocks(scans, found)


def schema_nested(spark, sf_dir):
    """Questions below the top of a group, of other spellings; a group that is a bare value makes a schema invalid."""
    nested = {"questions": {"page": [{"question": "Why?", "type": "textarea", "name": "w"}, {"label": "No shape"}]}, "compliance": [{"questions": [{"label": "Sex", "required": "yes", "type": "select", "options": ["A", {"name": "B"}]}]}], "demographics": None}
    rows = [(1, json.dumps(nested)), (2, '{"questions": [], "compliance": 5}'), (3, "{}")]
    payloads = spark.createDataFrame(rows, "page_id int, payload string")
    found = forms.schema_questions(payloads).select("page_id", "ordinal", "label", "field_type", "required", F.array_join("options", "|").alias("options"), "section")
    return found.unionByName(forms.invalid_groups(payloads).select("page_id", "section"), allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (markdown_table_scan, markdown_health, json_feed_scan, html_table_scan, feed_dispatch, html_form_extract, ats_schema_extract, scan_block_render, schema_nested, feed_missing_marker, feed_missing_header, feed_all_malformed, poll_outcomes, healthy_observations, provenance_infer)}


def _golden(columns: str, *rows: tuple) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") as t({columns})"


def _diagnoses(*rows: tuple) -> str:
    return "select source_id, category, candidates::bigint as candidates, parsed::bigint as parsed, error from (" + _golden("source_id, category, candidates, parsed, error", *rows) + ")"


BLOCK = """## Application Questions

**Scan status:** Partial␠
**Provider:** Generic␠
**Questions detected:** 7␠
**Custom / screening questions:** 0

[Open application](<https://x.example/a%20b?c=%281%29>)

> Only a part.

### Work authorization

6. **Do you need visa sponsorship?**␠
   Required — radio — Options: Yes / No

### Other visible questions

8. **Skills**␠
   Requirement not stated — multi select — Options: SQL / Java

<details>
<summary>Standard application fields</summary>

1. **Full name**␠
   Required — text
2. **Email**␠
   Optional — email
3. **Phone number**␠
   Requirement not stated — phone
5. **Country**␠
   Requirement not stated — single select — Options: US / FR
4. **Cover letter**␠
   Requirement not stated — long text

</details>

> Application scanning is read-only. No application was submitted, no answers were entered, and no files were uploaded.
> This scan is partial: conditional, multi-step, or authentication-gated fields may not be visible.
""".replace("␠", "  ")

ORACLE_SQL = {
    "markdown_table_scan": _golden(
        "category, company, position, location, salary, age, application_url, valid",
        ("FAANG+", "Alpha", "Engineer \\| Core", "Palo Alto, CA +1", "$50/hr", "1d", "https://jobs.lever.co/alpha/1", True),
        ("FAANG+", "Beta", "Engineer", "Oakland, CA", None, "2d", None, False),
        ("Quant", "Gamma & Co", "Quant Dev", "SF, CA", None, None, "https://g.example/apply?x=1", True),
        ("Other", "Delta", "Dev", "Remote", "$1", "3d", "https://d.example/j", True),
        ("Other", "too", "few", None, None, None, None, False),
    ),
    "markdown_health": "select category, candidates::bigint as candidates, parsed::bigint as parsed, skipped::bigint as skipped, healthy from (values ('FAANG+', 2, 1, 1, true), ('Quant', 1, 1, 0, true), ('Other', 2, 1, 1, true)) as t(category, candidates, parsed, skipped, healthy)",
    "json_feed_scan": _golden(
        "source_id, company, position, application_url, category, metadata, valid",
        ("internships", "Acme", "SWE Intern", "https://x.example/1", "Software Engineering", "category=Software Engineering;feedUpdatedAt=2026-01-01;id=1;listingUrl=https://x.example/1;url=https://y.example/1", True),
        ("internships", None, "SWE", "https://y.example/3", "Software Engineering", "category=software engineering;feedUpdatedAt=2026-01-01;id=3;url=https://y.example/3", False),
        ("graduates", "Bolt", "Backend Engineer", "https://z.example/1", "Unknown", "eligibility=New Grad;url=https://z.example/1", True),
    ),
    "html_table_scan": _golden(
        "row, company, position, location, application_url, source_url, source_job_id, age, category, valid",
        (1, "Orbit", "SWE Intern 🎓", "San Mateo, CA | Austin, TX", "https://orbit.example/j/1", "https://simplify.jobs/p/abc", "abc", "1d", "FAANG+", True),
        (2, "Orbit", "Data Intern", "SF, CA | NY", "https://simplify.jobs/p/def", "https://simplify.jobs/p/def", "def", "2d", "Unknown", True),
        (3, None, "SWE", "SF", None, None, None, None, "Unknown", False),
    ),
    "feed_dispatch": "select source_id, candidates::bigint as candidates, parsed::bigint as parsed from (values ('m', 5, 3), ('i', 2, 1), ('g', 1, 1), ('h', 3, 2)) as t(source_id, candidates, parsed)",
    "html_form_extract": _golden(
        "ordinal, label, field_type, required, options, category, section, is_custom, field_name",
        (1, "Full name", "text", True, "", "profile", None, False, "full_name"),
        (2, "Email", "email", False, "", "profile", None, False, "email"),
        (3, "Phone number", "phone", None, "", "profile", None, False, None),
        (4, "Cover letter", "long_text", None, "", "resume_documents", None, False, "cover_letter"),
        (5, "Country", "single_select", None, "US|FR", "profile", None, False, "country"),
        (6, "Do you need visa sponsorship?", "radio", True, "Yes|No", "work_authorization", "Do you need visa sponsorship?", False, "v"),
        (8, "Skills", "multi_select", None, "SQL|Java", "other", "Skills", False, "s"),
    ),
    "ats_schema_extract": _golden(
        "ordinal, label, field_type, required, options, category, section, is_custom, field_name",
        (1, "First Name", "text", True, "", "profile", "questions", False, "first_name"),
        (2, "Why us?", "long_text", False, "", "job_specific", "questions", True, "q1"),
        (3, "Office", "single_select", None, "SF|NY", "other", "questions", False, "q2"),
        (4, "Consent", "checkbox", True, "", "compliance_demographic", "compliance", False, "c"),
    ),
    "feed_missing_marker": _diagnoses(("no_marker", "FAANG+", 2, 1, None), ("no_marker", "Quant", 0, 0, "not exactly one pair of markers in order"), ("no_marker", "Other", 2, 1, None)),
    "feed_missing_header": _diagnoses(
        ("no_header", "FAANG+", 2, 1, None), ("no_header", "Quant", 0, 0, "no compatible table"), ("no_header", "Other", 2, 1, None),
        ("no_separator", "FAANG+", 2, 1, None), ("no_separator", "Quant", 0, 0, "no separator behind the header"), ("no_separator", "Other", 2, 1, None),
        ("stray", "FAANG+", 0, 0, "something else than rows behind the header"), ("stray", "Quant", 1, 1, None), ("stray", "Other", 2, 1, None),
    ),
    "feed_all_malformed": _diagnoses(
        ("malformed", "FAANG+", 2, 0, "none of the rows could be parsed"), ("malformed", "Quant", 1, 0, "none of the rows could be parsed"), ("malformed", "Other", 2, 1, None),
        ("typed", "Software Engineering", 3, 0, "no valid rows"),
    ),
    "poll_outcomes": "select source_id, ok, parsed::bigint as parsed, error from (" + _golden(
        "source_id, ok, parsed, error",
        ("whole", True, 3, None), ("no_marker", False, 2, "Quant: not exactly one pair of markers in order"), ("no_header", False, 2, "Quant: no compatible table"),
        ("no_separator", False, 2, "Quant: no separator behind the header"), ("stray", False, 2, "FAANG+: something else than rows behind the header"), ("malformed", False, 1, "FAANG+: none of the rows could be parsed"),
        ("no_json", False, 0, "Software Engineering: not valid JSON"), ("no_array", False, 0, "Software Engineering: no array of jobs"), ("no_rows", False, 0, "Software Engineering: no valid rows"),
        ("typed", False, 0, "Software Engineering: no valid rows"), ("no_section", False, 0, "Software Engineering: no section of the expected name"), ("no_columns", False, 0, "Software Engineering: unexpected header"),
        ("table", True, 2, None), ("away", False, 0, "HTTP 500"), ("other", False, 0, "no parser for this format"),
    ) + ")",
    "healthy_observations": _golden(
        "source_id, company, position, salary, age, season, source_job_id, metadata",
        ("whole", "Alpha", "Engineer \\| Core", "$50/hr", "1d", None, None, None), ("whole", "Gamma & Co", "Quant Dev", None, None, None, None, None), ("whole", "Delta", "Dev", "$1", "3d", None, None, None),
        ("table", "Orbit", "SWE Intern 🎓", None, "1d", "Summer 2027", "abc", "simplify_url=https://simplify.jobs/p/abc"), ("table", "Orbit", "Data Intern", None, "2d", "Summer 2027", "def", "simplify_url=https://simplify.jobs/p/def"),
    ),
    "provenance_infer": _golden("id, source_id, source_label", (1, "speedyapply_internships", "SpeedyApply"), (2, "speedyapply_new_grad", "SpeedyApply"), (3, "legacy_speedyapply", "SpeedyApply"), (4, "own", "Own")),
    "schema_nested": _golden(
        "page_id, ordinal, label, field_type, required, options, section",
        (1, 1, "Why?", "long_text", None, "", "questions"), (1, 2, "Sex", "single_select", True, "A|B", "compliance"), (2, None, None, None, None, None, "compliance"),
    ),
    "scan_block_render": _golden("page_id, block", (1, BLOCK)),
}

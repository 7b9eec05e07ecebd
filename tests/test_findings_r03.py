"""What the third review found, on small inputs."""

import json

from pyspark.sql import functions as F

from tidemark.operators import resolve
from tidemark.plans import feed_queries
from tidemark.sources import forms, html_table, json_feed, markdown, registry
from tidemark.streaming import memberships

DATA = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, '<form><input name="a"><input type="radio" name="b"></form>')], "page_id int, html string")
    assert planned(forms.questions(pages)).count("form_controls(") == 1


def test_controls_without_a_group_stay_apart(spark):
    html = '<form><label>A <input name="x"></label><label>B <input name="x"></label><label>C <input type="radio"></label><label>D <input type="radio"></label><label>E <select name="y" multiple><option>1</option></select></label></form>'
    found = forms.questions(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("ordinal")
    assert [(r["label"], r["field_type"], r["options"]) for r in found.collect()] == [("A", "text", []), ("B", "text", []), ("C", "radio", []), ("D", "radio", []), ("E", "multi_select", ["1"])]


def test_forms_are_dealt_over_tasks(spark):
    assert "RepartitionByExpression" in planned(feed_queries.html_form_extract(spark, DATA))


def test_blocks_hold_questions_of_all_kinds(spark):
    blocks = [r["block"] for r in feed_queries.scan_block_render(spark, DATA).collect()]
    assert all("**Questions detected:** 7" in b and "### Work authorization" in b and "<summary>Standard application fields</summary>" in b for b in blocks)
    assert any("### Custom screening questions" in b for b in blocks) and any("### Other visible questions" in b for b in blocks)


def test_sections_are_read_once(spark):
    feeds = spark.createDataFrame([("a", "<!-- TABLE_START -->\nx\n<!-- TABLE_END -->")], "source_id string, body string")
    assert "Join" not in planned(markdown.diagnose(feeds))
    found = {r["category"]: r["error"] for r in markdown.diagnose(feeds).collect()}
    assert found == {"FAANG+": "not exactly one pair of markers in order", "Quant": "not exactly one pair of markers in order", "Other": "no compatible table"}


def test_html_tables_are_read_once(spark):
    head = "## Software Engineering Internship Roles\n<table><tr><th>Company</th><th>Role</th></tr><tr><td>A</td><td>B</td></tr></table>\n"
    feeds = spark.createDataFrame([("a", head), ("b", "## Other\n")], "source_id string, body string")
    assert planned(html_table.parse(feeds)).count("table_cells(") == 1 and planned(html_table.diagnose(feeds)).count("table_cells(") == 1
    assert {r["source_id"]: (r["candidates"], r["error"]) for r in html_table.diagnose(feeds).collect()} == {"a": (0, "unexpected header"), "b": (0, "no section of the expected name")}


def test_state_of_the_stream_is_folded_without_python(spark):
    state = spark.createDataFrame([("a", "s", 0, 1, 2, "x"), ("gone", "s", 0, 0, 0, "x")], memberships._STATE)
    rows = spark.createDataFrame([(1, "a", "s", 0, "late"), (2, "a", "s", 1, "again"), (4, "a", "s", 2, "x"), (4, "b", "s", 2, "y"), (6, "b", "s", 5, "y"), (7, "b", "s", 6, "y")], memberships.ROW)
    found = memberships.fold(state, rows)
    assert {tuple(r) for r in found.collect()} == {("a", "s", 0, 1, 4, "x"), ("gone", "s", 0, 0, 0, "x"), ("b", "s", 4, 6, 7, "y")}
    assert "ython" not in planned(found) and "andas" not in planned(found)


def test_identities_are_worked_out_once(spark):
    row = ("https://jobs.lever.co/Acme/1/apply", "Acmé", "Eng", "Internship", "Oakland, CA")
    obs = spark.createDataFrame([(i, "s", *row, None) for i in range(3)] + [(3, "s", None, None, "Eng", None, None, None)], "obs_id int, source_id string, " + ", ".join(f"{c} string" for c in resolve.NAMING))
    found = resolve.identified(obs, spark.createDataFrame([("s", 1)], "source_id string, priority int"))
    rows = {r["obs_id"]: r for r in found.collect()}
    assert len(rows) == 4 and {rows[i]["canonical_id"] for i in range(3)} == {"lever:acme:1"} and len({rows[i]["fingerprint"] for i in range(4)}) == 2
    plan = planned(found)
    assert plan.count("sha2(") == 1 and "Aggregate" in plan[plan.index("sha2(") :]


def test_cells_are_split_by_one_pattern(spark):
    rows = [r"|a \| b|<a title='x|y' href=\">|\">`|`</a>| `c|<b|`>|d` |", "||", "|", "no | row", "|open `|", "|a|<b | c"]
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", markdown.cells(F.col("r")).alias("c"))
    assert [r["c"] for r in found.orderBy("i").collect()] == [[r"a \| b", r"<a title='x|y' href=\">", r"\">`|`</a>", "`c|<b|`>|d`"], [""], [], None, ["open `|"], ["a", "<b | c"]]
    assert "aggregate(" not in planned(found)


def test_feeds_are_read_once(spark):
    jobs = '{"jobs": [{"company": "A", "title": "B", "location": "C", "url": "u", "category": "software engineering"}, {"category": "Software Engineering"}, 5]}'
    feeds = spark.createDataFrame([("a", "json_internships", jobs), ("b", "json_internships", "{}")], "source_id string, format string, body string")
    found = json_feed.diagnose(feeds)
    assert planned(found).count(" AS d#") == 1  # the body as JSON
    assert {tuple(r) for r in found.collect()} == {("a", json_feed.CATEGORY, 3, 1, 2, None), ("b", json_feed.CATEGORY, 0, 0, 0, "no array of jobs")}
    rows = registry.healthy(feeds)
    assert " AS d#" not in planned(rows) and [(r["source_id"], r["company"]) for r in rows.collect()] == [("a", "A")]


def test_schemas_are_walked_once(spark):
    """Rounds for each level kept their results; now one pass does, on the tasks of a shuffle."""
    plan = planned(feed_queries.schema_nested(spark, DATA))
    assert plan.count("MapInArrow") == 1 and "LogicalRDD" not in plan and "Join Left" not in plan and "RepartitionByExpression" in plan


def test_schemas_of_odd_texts(spark):
    q = lambda label, **more: {"label": label, "type": "text"} | more
    deep = q("Deep?")
    for i in range(400):
        deep = [1, {"k": deep}] if i % 2 else {"label": i, "z": ["s", deep]}
    rows = {
        1: json.dumps({"questions": [q("Out", fields=[], x=[q("In")])], "compliance": None, "other": 5}),
        2: json.dumps({"questions": [q("Out")], "demographics": "text"}),
        3: '{"questions": [{"label": "A", "type": "x"}, {"label": "A", "label": "B", "type": "x"}]}',
        4: '{"quest\\u0069ons" :\n[ {"label" : "\\u0041 \\"b\\": {[" , "typ\\u0065":null}, {"label": [ ], "question": "Q", "required": 0}, {"label": [0], "question": "No", "required": 0}, {"label": -0.0e5, "question": "Z", "fields": []} ] }',
        5: json.dumps([{"questions": [q("No")]}]),
        6: json.dumps({"compliance": deep, "questions": q("Whole")}),
        7: '{"questions": [{"label": "A", "type": "x"}',
        8: json.dumps({"label": "Top", "type": "x", "questions": {"": [q("", question="E")]}}),
    }
    found = forms.schema_questions(spark.createDataFrame(list(rows.items()), "page_id int, payload string"))
    told = {k: [] for k in rows}
    for r in found.orderBy("page_id", "ordinal").collect():
        told[r["page_id"]].append(r["label"])
    assert told == {1: ["Out"], 2: [], 3: [], 4: ['A "b": {['] + ["Q", "Z"], 5: [], 6: ["Whole", "Deep?"], 7: [], 8: ["E"]}

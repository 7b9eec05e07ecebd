"""What has no bound any more: just past each old one, and against plain versions."""

import html
import json
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import inspection
from tidemark.sources import forms, markdown, state


def both(spark, values, expression, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}").select("i", expression(F.col("v")).alias("x"))
    found = {r["i"]: r["x"] for r in rows.collect()}
    return [found[i] for i in range(len(values))]


def plain_cells(line):
    """One character after the other."""
    row = line.strip()
    if not row.startswith("|"):
        return None
    out, cell, escaped, quote, tag, code = [], "", False, "", False, False
    for c in row[1:]:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif tag:
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                tag = c != ">"
        elif c == "<":
            tag = True
        elif c == "`":
            code = not code
        elif c == "|" and not code:
            out.append(cell.strip())
            cell = ""
            continue
        cell += c
    return out + ([cell.strip()] if cell.strip() or not row.endswith("|") else [])


def test_cells(spark):
    rng = random.Random(2)
    lines = ["|" * (rng.random() < 0.9) + "".join(rng.choice("ab01 |<>\"'`\\\t ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    lines += ["|0x0|1st 1|2nd St 2|3|44|5d5|", "| --- | :---: |", "|" + "<" * 2500 + "|", "|" + "`|" * 3000, "|", "||", "| a \\", "|" + "a" * 1_000_050 + "|b|", ""]
    assert both(spark, lines, markdown.cells) == [plain_cells(x) for x in lines]


BOARD = "<!-- TABLE_START -->\n{head}\n{line}\n{rows}\n<!-- TABLE_END -->\n<!-- TABLE_FAANG_START -->\n{head}\n{line}\n<!-- TABLE_FAANG_END -->\n<!-- TABLE_QUANT_START -->\n{head}\n{line}\n<!-- TABLE_QUANT_END -->"


def test_digits_and_spaced_separators(spark):
    lines = ["|---|---|---|---|---|---|", "| --- | :--- | ---: | :---: | :---: | --- |", "|  ----- | --- | --- | --- | --- | ---  |"]
    head = "| Company | Position | Location | Salary | Posting | Age |"
    rows = "\n".join(f"|{i}Beta{i}|1{i}st Engineer {i}|{i} 2nd St, Oakland, CA {i}|{i}$3{i}|[Apply](https://x.example/{i})|{i}5d{i}|" for i in range(10))
    documents = spark.createDataFrame([(x, BOARD.format(head=head, line=x, rows=rows)) for x in lines], "source_id string, body string")
    found = sorted(tuple(r) for r in markdown.parse(documents).where("valid").select("source_id", "company", "position", "location", "salary", "age").collect())
    assert found == sorted((x, f"{i}Beta{i}", f"1{i}st Engineer {i}", f"{i} 2nd St, Oakland, CA {i}", f"{i}$3{i}", f"{i}5d{i}") for i in range(10) for x in lines)
    assert markdown.diagnose(documents).where("error is not null").count() == 0


def test_character_references(spark):
    rng = random.Random(3)
    names = list(html.entities.html5)
    some = ["&" + rng.choice(names) for _ in range(800)] + ["&" + rng.choice(names)[:-1] + rng.choice(["", "x", ";", "=", "&"]) for _ in range(800)]
    some += [f"&#{n}{e}" for n in (0, 1, 13, 65, 127, 128, 129, 150, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFE, 0x10FFFF, 0x110000, 10**12, 8217, "00065") for e in ("", ";", "a")]
    some += [f"&#{x}{n}{e}" for x in "xX" for n in ("0", "2F", "2f", "1F600", "D800", "80", "9f", "000041", "fffffffff") for e in ("", ";", "g")]
    some += ["&amp;lt;", "&", "& a", "&;", "&&amp", "no", "", "&#;", "&#x;", "&notit;", "caf&eacute;&ndash;&#x2F;&#8217;"]
    some += ["".join(rng.choice(some) + rng.choice(["", " ", "z"]) for _ in range(5)) for _ in range(300)]
    assert both(spark, some, text.unescape) == [html.unescape(x) for x in some]


def test_links_of_any_depth(spark):
    bases = ["https://a.example/1/2/3/4/5/6/7/8/page.html?q=1#f", "https://a.example", "https://a.example/", "https://a.example/x/"]
    links = ["../" * k + "z" for k in range(12)] + ["a/../b/./c", "..", ".", "./", "../", "/x/../../y", "/a//b/../c", "?k=v", "#top", "", "//b.example/z", "https://c.example/../k", "mailto:x@y.example", "a/b/?x=../y", "x y", "..a/..", "a/.."]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    found = {(r["b"], r["x"]): r["u"] for r in rows.select("b", "x", inspection.absolute(F.col("x"), F.col("b")).alias("u")).collect()}
    slash = lambda u: u.replace("a.example?", "a.example/?")  # noqa: E731  an empty path may be written either way
    wrong = {k: (v, urljoin(*k)) for k, v in found.items() if slash(v) != slash(urljoin(*k))}
    assert not wrong


def test_anchors_in_something_hidden(spark):
    base = "https://jobs.example.com/a/b"
    cases = {
        "<div hidden><p><a href='/x'>Apply</a></p></div><a href='/y'>Apply</a>": "https://jobs.example.com/y",
        "<div aria-hidden=true><a href='/x'>Apply</a></div>": None,
        "<section style='Display : None'><a href='/x'>Apply</a></section><a href=/u>Apply now</a>": "https://jobs.example.com/u",
        "<div hidden><br><img></div><a href='../../../../../../q'><b>Application</b> form</a>": "https://jobs.example.com/q",
        "<a href='&#x2F;e&amp;f'>apply</a>": "https://jobs.example.com/e&f",
        "<a>Apply</a><a href=''>Apply</a>": None,
        "": None,
    }
    assert both(spark, list(cases), lambda c: inspection.apply_link(c, F.lit(base))) == list(cases.values())


def nested(depth, as_list):
    value = [{"label": "Before", "type": "text"}, {"label": "Deep?", "required": True, "type": "textarea"}, {"label": "After", "type": "text"}]
    for i in range(depth):
        value = [{"label": f"No shape {i}"}, value] if as_list else {"z": value, "a": {"x": 1, "label": 5}}
    return value


def test_questions_of_any_depth(spark):
    last = [{"label": "Last", "type": "text"}]
    cases = [(d, as_list) for d in (1, 5, 12) for as_list in (True, False)]
    rows = [(i, json.dumps({"questions": nested(*c), "compliance": last})) for i, c in enumerate(cases)] + [(90, "{}"), (91, "not json"), (92, None)]
    found = forms.schema_questions(spark.createDataFrame(rows, "page_id int, payload string")).orderBy("page_id", "ordinal").collect()
    told = [(1, "Before", "questions"), (2, "Deep?", "questions"), (3, "After", "questions"), (4, "Last", "compliance")]
    assert [tuple(r[c] for c in ("page_id", "ordinal", "label", "section")) for r in found] == [(i, *t) for i in range(len(cases)) for t in told]


def test_questions_in_the_order_they_are_written(spark):
    payload = '{"questions": {"z": {"label": "First", "type": "text"}, "a": [{"label": "", "question": "Second", "type": "text"}, {"label": 5, "type": "text", "question": "None"}], "m": {"label": null, "question": "Third", "required": false}, "t": "[1]", "b": {"label": 0, "question": "Fourth", "type": "x"}}}'
    found = forms.schema_questions(spark.createDataFrame([(1, payload)], "page_id int, payload string"))
    assert [r["label"] for r in found.orderBy("ordinal").collect()] == ["First", "Second", "Third", "Fourth"]


def test_guard_reads_keys_as_they_are_decoded(spark):
    bad = ['{"to\\u006ben": 1}', '{"a": {"Set-C\\u006fokie": "x"}}', '[{"x": [{"pass\\u0077ord" : 1}]}]', '{"a": "\\\\", "csrf": 1}', '{"answer":1}']
    good = ['{"a": "token"}', '{"a": "x\\": \\"token\\": 1"}', '{"a": ["token", "x"]}', '{"note": "' + "\\\\n" * 5000 + '"}', "{}", "not json", "", '{"a":"token","b":{"c":"cookie"}}']
    assert both(spark, bad, state.prohibited) == [True] * len(bad)
    assert both(spark, good, state.prohibited) == [False] * len(good)
    record = json.dumps({'k"ey': {"ü\n": [{"z:": 1}]}, "é": "a:b"})
    assert both(spark, [record], state.keys)[0] == ['k"ey', "ü\n", "z:", "é"]

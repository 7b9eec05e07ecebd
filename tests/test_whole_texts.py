"""Registered queries take whole texts and all links of a page."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import render
from tidemark.plans import registry

LONG = "word " * 200


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_escaping_reaches_the_end(spark, tmp_path):
    rows = [(2, LONG + "a|b*c\\", "en", "s"), (3, LONG + "a|b[c", "en", "s")]
    found = registry.QUERIES["markdown_escape"](spark, _documents(spark, tmp_path, rows)).orderBy("doc_id").collect()
    whole = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, t string")
    wanted = whole.select("doc_id", F.sha2(text.markdown_cell(F.col("t")), 256), F.sha2(text.escape_text(F.col("t")), 256)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in wanted]


def test_bodies_are_whole(spark, tmp_path):
    rows = [(1, LONG, "en", "s"), (2, LONG + "end\n", "en", "s")]
    found = registry.QUERIES["block_upsert"](spark, _documents(spark, tmp_path, rows)).orderBy("doc_id").collect()
    block = "<!-- scan:start 7 -->\nnew \\1 $2\n<!-- scan:end 7 -->"
    wanted = spark.createDataFrame([(f"{LONG}\n\n{block}\n",), (f"{LONG}end\n{block}{LONG}end\n",)], "b string").select(F.sha2("b", 256)).collect()
    assert [r["body_sha256"] for r in found] == [w[0] for w in wanted]


@pytest.mark.parametrize("at", [0, 100])
def test_markers_behind_the_start_are_found(spark, tmp_path, at):
    rows = [(7, "x" * at + "<!-- batch:v1:4 -->", "en", "s")]
    assert sorted(tuple(r) for r in registry.QUERIES["marker_lookup"](spark, _documents(spark, tmp_path, rows)).collect()) == [("4", 7), ("7", 7)]


def test_redaction_sees_the_whole_text(spark, tmp_path):
    rows = [(1, "https://x.example/" + "y" * 700 + " the end", "en", "s")]
    found = registry.QUERIES["redact_message"](spark, _documents(spark, tmp_path, rows)).collect()[0]["message"]
    assert found == "see <url> auth_token=<redacted>; <url> the end"


def test_all_links_of_a_page_count(spark, tmp_path):
    html = "".join(f'<a href="https://x.example/{i}">{i}</a>' for i in range(120))
    spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in registry.QUERIES["anchor_extract"](spark, str(tmp_path)).collect()] == [(1, 120, "https://x.example/0")]

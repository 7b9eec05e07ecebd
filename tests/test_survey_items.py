"""Alias links (A5, J7), either spelling of a block's marks (K8) and public pages (S9)."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outbox, render, resolve
from tests import golden_feeds as feed_queries
from tidemark.sources import connectors, registry


def test_source_links_are_aliases(spark):
    columns = "run_id int, canonical_id string, source_id string, obs_id int, company string, position string, location string, salary string, age string, category string, season string, job_type string, application_url string, source_url string, direct boolean, strength int, priority int"
    rows = [
        (1, "i", "a", 1, "C", "P", "L", None, None, None, None, "J", "https://c.example/1", "https://simplify.jobs/p/1", True, 1, 0),
        (1, "i", "a", 2, "C", "P", "L", None, None, None, None, "J", "https://c.example/2", "https://simplify.jobs/p/2", True, 2, 0),
        (1, "i", "b", 3, "C", "P", "L", None, None, None, None, "J", "https://c.example/1", None, True, 1, 1),
        (1, "i", "c", 4, "C", "P", "L", None, None, None, None, "J", "https://c.example/1", "", True, 1, 1),
    ]
    history = resolve.resolved(spark.createDataFrame(rows, columns))
    assert history.first()["url_aliases"] == "https://c.example/1 https://simplify.jobs/p/1"
    batches = spark.createDataFrame([("b", ["https://simplify.jobs/p/1"])], "batch_id string, job_urls array<string>")
    assert outbox.deliverable(outbox.entries_by_url(batches, history.withColumn("url_aliases", F.split("url_aliases", " ")))).count() == 1


def test_feeds_carry_source_links(spark):
    rows = [("m", "markdown", feed_queries.MARKDOWN), ("h", "html_table", feed_queries.TABLE), ("i", "json_internships", feed_queries.INTERNSHIPS)]
    found = registry.parse(spark.createDataFrame(rows, "source_id string, format string, body string")).where("valid").collect()
    links = {(r["source_id"], r["application_url"]): r["source_url"] for r in found}
    assert links["h", "https://orbit.example/j/1"] == "https://simplify.jobs/p/abc"
    assert links["i", "https://x.example/1"] == "https://y.example/1"
    assert all(a == s for (source, a), s in links.items() if source == "m")


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("a<!-- scan:start:7 -->old<!-- scan:end:7 -->z", "a{}z"),
        ("a<!-- scan:start 7 -->old<!-- scan:end 7 -->z", "a{}z"),
        ("<!-- scan:start:7 -->x<!-- scan:end:7 --><!-- scan:start 7 -->y<!-- scan:end 7 -->", "<!-- scan:start:7 -->x<!-- scan:end:7 -->{}"),
        ("<!-- scan:end 7 --><!-- scan:start 7 -->y<!-- scan:end 7 -->", "<!-- scan:end 7 -->{}"),
        ("<!-- scan:start:8 -->x<!-- scan:end:8 -->", "<!-- scan:start:8 -->x<!-- scan:end:8 -->\n\n{}\n"),
        ("<!-- scan:start 7 -->x", "<!-- scan:start 7 -->x\n\n{}\n"),
    ],
)
def test_a_block_of_either_spelling_is_replaced(spark, body, wanted):
    block = "<!-- scan:start 7 -->\nnew \\1 $2\n<!-- scan:end 7 -->"
    found = spark.createDataFrame([(body,)], "b string").select(render.upsert_block(F.col("b"), "7", F.lit("new \\1 $2")).alias("b")).first()["b"]
    assert found == wanted.format(block)


def test_public_pages(spark):
    base = "https://c.example/"
    links = spark.createDataFrame([(u,) for u in (base + "a", base + "gone", base + "slow", "http://localhost/x", None)], "url string")
    found = {r["url"]: tuple(r)[1:] for r in connectors.public_pages(links, "tests.page_feeds:page").collect()}
    assert found == {
        base + "a": (200, base + "a/final", "<p>page</p>", None), base + "gone": (404, None, None, "HTTP 404"), base + "slow": (None, None, None, "could not fetch: TimeoutError"),
        "http://localhost/x": (None, None, None, "not a safe public link"), None: (None, None, None, "not a safe public link"),
    }


@pytest.mark.parametrize("kind, body, wanted", [("text/html; charset=iso-8859-1", b"caf\xe9", "café"), ("text/html", b"caf\xc3\xa9", "café"), ("text/html", b"caf\xe9", "caf�")])
def test_pages_are_decoded_as_declared(kind, body, wanted):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.handle_request, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert connectors.page_get(url) == (200, url, wanted)
    server.server_close()

from pyspark.sql import functions as F

from tidemark.operators import inspection as I

PAGE = "canonical_id string, http_status int, final_url string, html string, n_questions int, error string"


def test_ladder(spark):
    url = "https://jobs.example.com/1"
    targets = spark.createDataFrame([(k, u) for k, u in {
        "unsafe": "http://localhost/x", "schema": "https://boards.greenhouse.io/a/jobs/1", "gone": "https://boards.greenhouse.io/a/jobs/2", "denied": url, "broken": url, "redirected": url,
        "captcha": url, "fields": url, "dynamic": "https://jobs.lever.co/a/1", "kept": "https://jobs.lever.co/a/2", "linked": url, "nothing": url,
    }.items()], "canonical_id string, application_url string")
    schemas = spark.createDataFrame([("schema", 200, 4, None), ("gone", 404, 0, "x")], "canonical_id string, http_status int, n_questions int, error string")
    static = spark.createDataFrame([
        ("denied", 403, None, None, 0, "x"), ("broken", 500, None, None, 0, "x"), ("redirected", 200, "http://10.0.0.1", "", 0, None), ("captcha", 200, url, "<script src=recaptcha>", 3, None),
        ("fields", 200, url, "x", 3, None), ("dynamic", 200, "https://jobs.lever.co/a/1", "x", 2, None), ("kept", 200, "https://jobs.lever.co/a/2", "x", 2, None), ("linked", 200, url, "x", 0, None), ("nothing", 200, url, "x", 0, None),
    ], PAGE)
    linked = spark.createDataFrame([("linked", 200, url, "x", 5, None)], PAGE)
    rendered = spark.createDataFrame([("dynamic", 200, url, "x", 9, None), ("kept", 200, url, "x", 0, None), ("nothing", 200, url, "x", 0, None)], PAGE)
    found = {r["canonical_id"]: (r["status"], r["rung"], r["questions"]) for r in I.inspect(targets, schemas, static, linked, rendered).collect()}
    assert found == {
        "unsafe": ("unavailable", "none", 0), "schema": ("complete", "schema", 4), "gone": ("unavailable", "schema", 0), "denied": ("unavailable", "static", 0), "broken": ("failed", "static", 0),
        "redirected": ("unavailable", "static", 0), "captcha": ("unavailable", "static", 3), "fields": ("partial", "static", 3), "dynamic": ("partial", "rendered", 9), "kept": ("partial", "static", 2),
        "linked": ("partial", "linked", 5), "nothing": ("unavailable", "rendered", 0),
    }


def test_apply_link(spark):
    base = "https://jobs.lever.co/a/1"
    cases = {
        '<a href="/a/1/apply">Apply for this job</a>': "https://jobs.lever.co/a/1/apply",
        '<a href="/x" hidden>Apply</a><a href="https://b.example/apply">Apply</a>': None,
        '<a href="https://boards.greenhouse.io/z">Application</a>': "https://boards.greenhouse.io/z",
        '<a href="/about">About</a>': None,
    }
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", I.apply_link(F.col("h"), F.lit(base)).alias("l")).collect()
    assert {r["h"]: r["l"] for r in rows} == cases

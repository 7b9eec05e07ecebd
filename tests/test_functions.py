from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text, urls

LOCATIONS = [
    ("San Francisco, CA", True), ("san francisco (hybrid), california", True), ("SF, CA", True), ("S.F., Calif.", True), ("Bay Area, CA", True), ("SF Bay Area", True), ("San Francisco Bay Area", True),
    ("Sán José, CA", True), ("Oakland, CA +2", True), ("Los Altos Hills, CA", True), ("On Site; Novato In Office CA", True), ("San Francisco", False), ("SFO, CA", False), ("SF Bay Area, TX", False),
    ("Newark, NJ", False), ("Fremont, NE", False), ("Richmond, VA", False), ("Sacramento, CA", False), ("Bay Area", False), ("", False), (None, False), ("Dublin, Ireland", False), ("Concord Remote California", True),
]
LINKS = [
    ("https://jobs.ashbyhq.com/Acme/ABC?utm_source=x", "ashby:acme:abc"), ("https://jobs.ashbyhq.com/Acme/embed", "url:https://jobs.ashbyhq.com/Acme/embed"), ("https://boards.greenhouse.io/acme/jobs/12", "greenhouse:acme:12"),
    ("https://notgreenhouse.io/acme/jobs/12", "greenhouse:acme:12"), ("https://jobs.lever.co/Acme/1/apply", "lever:acme:1"), ("https://acme.wd1.myworkdayjobs.com/x/job/City/Role_R12345-2", "workday:acme.wd1.myworkdayjobs.com:role_r12345-2"),
    ("https://acme.wd1.myworkdayjobs.com/x/job", "url:https://acme.wd1.myworkdayjobs.com/x/job"), ("https://ats.rippling.com/acme/jobs/9", "rippling:acme:9"), ("https://lifeattiktok.com/search/123456", "tiktok:lifeattiktok.com:123456"),
    ("https://www.amazon.jobs/en/jobs/77/role", "amazon:77"), ("https://simplify.jobs/p/1", "url:https://simplify.jobs/p/1"), ("https://x.com:443//a//?q=~*%20b&utm_id=1&ref=k#f", "url:https://x.com:443/a?q=~%2A+b&ref=k"),
]


def test_locations(spark):
    rows = spark.createDataFrame([(i, loc) for i, (loc, _) in enumerate(LOCATIONS)], "i int, l string").select("i", text.location_matches(F.col("l")).alias("m")).collect()
    assert {LOCATIONS[r["i"]][0]: r["m"] for r in rows} == dict(LOCATIONS)


def test_link_identity(spark):
    rows = spark.createDataFrame([(u,) for u, _ in LINKS], "u string").select("u", urls.identity(F.col("u")).alias("i")).collect()
    assert {r["u"]: r["i"]["canonical_id"] for r in rows} == dict(LINKS)
    assert {r["u"] for r in rows if not r["i"]["direct"]} == {"https://simplify.jobs/p/1"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", categories=["L", "N", "P", "Z", "M"], max_codepoint=0x24F)), min_size=20, max_size=60))
def test_fold_is_its_definition(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows] == [text.fold_text(r["t"]) for r in rows]


def test_public_links(spark):
    cases = {"https://a.example": True, "ftp://a.example": False, "http://localhost": False, "http://10.0.0.1": False, "http://8.8.8.8/": True, "http://[::1]/": False, "http://[2606:4700::1]/": True, "http://172.16.0.1": False, "x": False}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.safe_public(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["s"] for r in rows} == cases


def test_small_functions(spark):
    r = spark.range(1).select(
        text.label(F.lit("<b>Name</b> * ")).alias("a"), text.label(F.lit("Name*")).alias("b"), text.human_name(F.lit("cover_letter")).alias("c"), text.human_name(F.lit("field")).alias("d"),
        text.safe_message(F.lit("GET https://a.b/c failed; token=abc, x")).alias("e"), text.field_type(F.lit("Multi-Select")).alias("f"), text.alert_title(F.lit(1)).alias("g"),
        urls.board_reference(F.lit("https://boards.greenhouse.io/Acme/jobs/5")).alias("h"), urls.provider(F.lit("https://a.lever.co/x")).alias("i"), text.lenient_boolean(F.lit("Yes")).alias("j"),
    ).first()
    assert r.asDict(True) == {"a": "Name", "b": "Name*", "c": "Cover letter", "d": "", "e": "GET <url> failed; token=<redacted>, x", "f": "multi_select", "g": "1 new entry", "h": {"board": "Acme", "job": "5"}, "i": "lever", "j": True}

"""Facts of a group of controls, and places in large groups."""

from pyspark.sql import functions as F

from tidemark.plans.text_queries import numbered
from tidemark.sources import forms


def test_a_group_is_required_if_one_is_and_unknown_if_none_says(spark):
    rows = spark.createDataFrame([(1, None), (1, True), (1, False), (2, False), (2, None), (3, None)], "g int, required boolean")
    found = rows.groupBy("g").agg(forms.any_required("required").alias("r")).collect()
    assert {x["g"]: x["r"] for x in found} == {1: True, 2: False, 3: None}


def test_options_keep_the_first_spelling_in_order(spark):
    rows = spark.createDataFrame([(["Yes", "no", "YES", "", "No", "Maybe *"],), ([],), (None,)], "options array<string>")
    assert [r[0] for r in rows.select(forms.distinct_options(F.col("options"))).collect()] == [["Yes", "no", "Maybe"], [], None]


def test_places_over_ranges_are_those_of_the_whole(spark):
    """Ranges of ten rows, a group with most rows, a null group and an empty table."""
    rows = spark.range(500).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 37 % 500).alias("at"))
    found = {(r["g"], r["at"]): r["ordinal"] for r in numbered(rows, "g", "at", 10).collect()}
    want = {}
    for g in (None, "a", "b"):
        want |= {(g, at): i + 1 for i, at in enumerate(sorted(r["at"] for r in rows.collect() if r["g"] == g))}
    assert found == want and numbered(rows.limit(0), "g", "at", 10).count() == 0

"""Memberships as keyed state: equal to the closed form, over restarts, repeated and failed polls."""

import random

from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.streaming import memberships

OBS = "run_id int, canonical_id string, source_id string, company string, position string, job_type string, location string, salary string, application_url string, category string, season string"


def observations(spark, seed=5):
    rng = random.Random(seed)
    polls = [(r, s, rng.random() < 0.75) for r in range(8) for s in ("a", "b", "c")]
    ok = {(r, s) for r, s, good in polls if good}
    rows = [(r, f"e{e}", s, rng.choice("xy"), *["p"] * 7) for r, s in sorted(ok) for e in range(12) if rng.random() < 0.6]
    return spark.createDataFrame(rows, OBS), spark.createDataFrame(polls, "run_id int, source_id string, ok boolean")


def told(df):
    return sorted(tuple(r) for r in df.select("canonical_id", "source_id", "first_seen", "last_seen", F.coalesce("inactive_at", F.lit(-1)), "active").collect())


def test_keyed_state_equals_the_closed_form(spark, tmp_path):
    observed, polls = observations(spark)
    expected = told(lifecycle.memberships(observed, polls))
    base = f"file://{tmp_path}/s"
    assert told(memberships.run(observed, polls, base, stops=[2, 3])) == expected
    memberships.rows_of(observed, polls).where("run_id < 5").write.parquet(f"{base}/rows/again")  # repeated rows change nothing
    memberships.advance(spark, f"{base}/rows", f"{base}/state")
    assert told(memberships.read(spark, f"{base}/state", polls)) == expected

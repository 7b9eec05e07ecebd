"""A language or a run isn't one task's."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests import test_lifecycle as T
from tidemark.plans import text_queries
from tidemark.streaming import polls as stream


def test_numbers_of_ranges_are_those_of_the_group(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 100003 as doc_id", "case when id % 10 < 6 then 'en' when id % 10 < 9 then 'de' end as lang")
    found = text_queries.numbered(rows, "lang", "doc_id", range_rows=50)
    wanted = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long"))
    assert found.schema["ordinal"].dataType == wanted.schema["ordinal"].dataType
    key = lambda r: (r["lang"] or "", r["ordinal"])
    assert sorted(found.select("doc_id", "lang", "ordinal").collect(), key=key) == sorted(wanted.select("doc_id", "lang", "ordinal").collect(), key=key)


def test_a_run_keeps_its_partitions(spark, tmp_path, monkeypatch):
    polls_df, seen_df, polls, seen = T._frames(spark, 5)
    monkeypatch.setattr(stream, "_shared", lambda spark: f"file://{tmp_path}/polls")
    found = stream.run_stream(seen_df.repartition(3), polls_df)
    assert {tuple(r) for r in found.collect()} == T._sequential(polls, seen)
    files = [len(list((tmp_path / "polls").glob(f"in-{run}/*.parquet"))) for run in {p[0] for p in polls}]
    assert max(files) > 1


def test_queries_over_all_events(spark, tmp_path):
    rows = [(i, i % 2, "click" if i < 5 else None, datetime(2024, 1, 1)) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz")
    events.write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: sorted(tuple(r) for r in text_queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("retention_expired") == [(i,) for i in range(5)]
    assert run("outbox_order") == [(i, i // 2 + 1) for i in range(6)]

"""Observation and poll views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Feeds in order of priority.
FEEDS = ["feed_a", "feed_b", "feed_c", "feed_d", "feed_e"]
RUNS = 7
#: Polls that failed: run and feed.
FAILED = [(1, "feed_b"), (2, "feed_d"), (3, "feed_b"), (4, "feed_a"), (5, "feed_e"), (5, "feed_c")]

_CASE_FEED = "case cast(o_orderkey % 5 as int) " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(FEEDS)) + " end"
_LOCATIONS = ["San Francisco, CA", "Palo Alto (Hybrid), California", "New York, NY", "SF Bay Area", "5 locations Remote, Austin, TX", "Sán José, CA", "SF Bay Area TX", "San Francisco", "Fremont County CA", "SFO, CA", "Oakland, CA +2", "Remote in USA"]
_CASE_LOCATION = "case cast(b % 12 as int) " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_LOCATIONS)) + " end"
_URLS = [
    "'https://jobs.ashbyhq.com/Acme' || b || '/JOB-' || k || '?utm_source=x&ref=y'",
    "'https://boards.greenhouse.io/acme' || b || '/jobs/' || k || '?gh_src=a'",
    "'https://jobs.lever.co/Acme' || b || '/' || k || '/apply'",
    "'https://acme' || b || '.wd5.myworkdayjobs.com/en-US/site/job/City/Role_R' || (10000 + k) || '-1'",
    "'https://ats.rippling.com/acme' || b || '/jobs/' || k",
    "'https://www.amazon.jobs/en/jobs/' || k || '/role'",
    "'https://lifeattiktok.com/search/' || (7000000 + k)",
    "'HTTPS://Careers.Acme' || b || '.com//openings/' || k || '/?b=2&a=1&utm_medium=z#top'",
    "'https://simplify.jobs/p/' || k",
]
_CASE_URL = "case form " + " ".join(f"when {i} then {x}" for i, x in enumerate(_URLS)) + " end"

OBS = f"""
select obs_id, run_id, source_id, 'Größe & Söhne ' || b as company,
  'Software Engineer ' || b || case when form = 8 or form = 0 or (b % 3 = 0 and form = 1) then '' else ' ' || form end
    || case when priority_text = '1-URGENT' then ' (New Grad)' else '' end as position,
  case when form = 8 or form = 0 or form = 1 then 'Internship' else 'New Grad' end as job_type,
  {_CASE_LOCATION} as location,
  case when obs_id % 3 = 0 then null else '$' || (100 + obs_id % 50) || 'k' end as salary,
  {_CASE_URL} as application_url, (obs_id % 30) || 'd' as age,
  case cast(obs_id % 4 as int) when 0 then 'Unknown' when 1 then 'Other' when 2 then 'FAANG+' else 'Unknown' end as category,
  case when form = 2 then 'Summer 2027' end as season,
  case when obs_id % 4 = 1 then 'https://simplify.jobs/p/' || k when obs_id % 4 = 2 then {_CASE_URL} end as source_url,
  case when obs_id % 6 = 0 then '2026-01-0' || (k % 9) end as posted, 'kind-' || (obs_id % 2) as kind
from (
  select o_orderkey as obs_id, cast(year(o_orderdate) - 1995 as int) as run_id, {_CASE_FEED} as source_id, o_orderpriority as priority_text,
    k, cast(k % 9 as int) as form, cast(floor(k / 9) as bigint) as b
  from (select o_orderkey, o_orderdate, o_orderpriority, cast(floor(o_custkey / 3) as bigint) as k from {{orders}}) o
) x
""".strip()

_VALUES = ", ".join(f"({r}, '{f}', {i}, {'false' if (r, f) in FAILED else 'true'})" for r in range(RUNS) for i, f in enumerate(FEEDS))
POLLS = f"select * from (values {_VALUES}) as t(run_id, source_id, priority, ok)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(OBS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    metadata = F.create_map(F.lit("kind"), F.col("kind"), F.lit("feedUpdatedAt"), F.col("obs_id").cast("string"))  # of which one key passes by itself
    return rows.withColumn("source_metadata", metadata).drop("kind")


def polls(spark: SparkSession) -> DataFrame:
    return spark.sql(POLLS)


def obs_sql() -> str:
    """OBS for DuckDB."""
    return OBS.replace("{orders}", "orders")

"""Queries over observations: identity, resolution, lifecycle, alerts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.functions.lineage import cut
from tidemark.operators import history, lifecycle, outbox, render, resolve
from tidemark.sources import markdown
from tidemark.streaming import memberships as stream
from tidemark.streaming.polls import _shared

from . import oracle as O
from .driver_views import observations, polls

BASELINES = [0]


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identified observations, written once as every query reads them twice or more (and as Catalyst would otherwise push
    filters on the identity below it, with a copy of all that it is made of); nothing stays in memory."""
    priorities = polls(spark).select("source_id", "priority").distinct()
    return cut(resolve.identified(observations(spark, sf_dir), priorities))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.attach_wrappers(known(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.answered(resolve.per_source(members(spark, sf_dir)), polls(spark))


def url_identity_rules(spark, sf_dir):
    return known(spark, sf_dir).select("obs_id", "canonical_id", "canonical_url", "direct", "stable")


def url_provider_detect(spark, sf_dir):
    return observations(spark, sf_dir).select("obs_id", urls.provider(F.col("application_url")).alias("provider"), F.coalesce(urls.aggregator_job_id(F.col("application_url")), F.lit("")).alias("source_job_id"))


def location_filter(spark, sf_dir):
    return observations(spark, sf_dir).where(text.location_matches(F.col("location"))).groupBy("location").agg(F.count("*").alias("n"))


def fingerprint(spark, sf_dir):
    key = text.fingerprint(*(F.col(c) for c in ("company", "position", "job_type", "location", "season")))
    return observations(spark, sf_dir).select("obs_id", key.alias("fingerprint"))


def wrapper_attach(spark, sf_dir):
    return members(spark, sf_dir).where("not direct").select("obs_id", "canonical_id")


def entity_resolution(spark, sf_dir):
    columns = ["run_id", "canonical_id", "company", "position", "location", "salary", "age", "category", "posted", "season", "application_url", "job_type", "url_aliases", "observations"]
    return resolve.resolved(members(spark, sf_dir)).select(columns)


def source_labels(spark, sf_dir):
    return resolve.source_labels(members(spark, sf_dir))


def resolution_counts(spark, sf_dir):
    return resolve.counts(members(spark, sf_dir))


def membership_lifecycle(spark, sf_dir):
    return lifecycle.memberships(observed(spark, sf_dir), polls(spark))


def stream_lifecycle(spark, sf_dir):
    """Keyed state of a stream that ends in the middle of the polls, and of another one that goes on from it."""
    return stream.run(observed(spark, sf_dir), polls(spark), _shared(spark), stops=[3])


def entity_lifecycle(spark, sf_dir):
    return lifecycle.entities(membership_lifecycle(spark, sf_dir))


def current_snapshot(spark, sf_dir):
    """Active entities with their active sources; what is kept of a source here is when it last said something new."""
    found = cut(membership_lifecycle(spark, sf_dir).withColumn("v", F.struct("last_seen")))
    stored = replace(history.empty(spark, "int"), entities=lifecycle.entities(found).drop("sources"), memberships=found)
    of = lambda name: F.transform("sources", lambda s: s[name])
    return history.current(stored).select("canonical_id", F.array_join(of("source_id"), ",").alias("sources"), F.array_max(F.transform(of("v"), lambda v: v["last_seen"])).alias("last_change"))


def running_survivorship(spark, sf_dir):
    found = members(spark, sf_dir)
    return lifecycle.survivorship(resolve.resolved(found), found.select("run_id").distinct().count())


def change_detection(spark, sf_dir):
    return lifecycle.changes(observed(spark, sf_dir), polls(spark)).where("changed or reactivated").select("run_id", "canonical_id", "source_id", "changed", "reactivated")


def inactive_reactivated_counts(spark, sf_dir):
    return lifecycle.transitions(lifecycle.activity(observed(spark, sf_dir), polls(spark)))


def new_entity_alerts(spark, sf_dir):
    return lifecycle.batches(lifecycle.new_entities(observed(spark, sf_dir), polls(spark), BASELINES))


def batch_resolve(spark, sf_dir):
    """Entries of pending batches joined with the history by id; a batch is deliverable if none is missing."""
    new = lifecycle.new_entities(observed(spark, sf_dir), polls(spark), BASELINES)
    batches = new.groupBy(F.col("run_id").alias("batch_id")).agg(F.array_sort(F.collect_list("canonical_id")).alias("job_ids"))
    entries = outbox.entries_by_id(batches, entity_lifecycle(spark, sf_dir).select("canonical_id", "active"))
    whole = outbox.deliverable(entries).withColumn("deliverable", F.lit(True))
    counts = entries.groupBy("batch_id").agg(F.count_if("active").alias("still_active"), F.count("*").alias("entries"))
    return counts.join(whole, "batch_id", "left").select(F.col("batch_id").alias("run_id"), F.coalesce("deliverable", F.lit(False)).alias("deliverable"), "still_active", "entries")


def fallback_promotion(spark, sf_dir):
    return lifecycle.promotions(known(spark, sf_dir), resolve.resolved(members(spark, sf_dir)))


def source_onboarding(spark, sf_dir):
    """The run in which each source is first heard of; it alerts of nothing there."""
    first = observed(spark, sf_dir).groupBy("source_id").agg(F.min("run_id").alias("run_id"))
    return first.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("baselined"))


def alias_union(spark, sf_dir):
    """Links of an entity over all runs; they only grow."""
    found = lifecycle.aliases(members(spark, sf_dir))
    return found.select("canonical_id", F.array_join("url_aliases", " ").alias("url_aliases"), F.size("url_aliases").cast("long").alias("n"))


def alias_subset(spark, sf_dir):
    """Whether a run's links were all known before it."""
    return lifecycle.link_changes(members(spark, sf_dir)).select("canonical_id", "run_id", (~F.col("adds")).alias("is_subset"))


def parse_health(spark, sf_dir):
    """Rows with and without all required fields by feed and category; feeds that lost too many are unhealthy."""
    rows = observations(spark, sf_dir)
    whole = text.nonempty(F.col("company")).isNotNull() & text.nonempty(F.col("position")).isNotNull() & text.nonempty(F.col("salary")).isNotNull() & text.nonempty(F.col("application_url")).isNotNull()
    return markdown.health(rows.withColumn("valid", whole))


def dashboard_rows(spark, sf_dir):
    """Rendered rows, and what the dashboard orders them by: active first, newest first, then by name."""
    found = membership_lifecycle(spark, sf_dir)
    labels = found.groupBy("canonical_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ", ").alias("labels"), F.max("last_seen").alias("last_seen"))
    values = ["company", "position", "job_type", "category", "location", "salary", "application_url"]
    last = resolve.resolved(members(spark, sf_dir)).groupBy("canonical_id").agg(F.max_by(F.struct(*values), "run_id").alias("v"))
    rows = lifecycle.entities(found).join(labels, "canonical_id").join(last, "canonical_id").select("canonical_id", "active", "first_seen", "last_seen", "labels", "v.*")
    sort_key = F.concat_ws("/", F.when(F.col("active"), "0").otherwise("1"), F.lower("company"))
    return rows.select("canonical_id", "active", render.row_line().alias("line"), "first_seen", sort_key.alias("sort_key"))


def _q(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


def _state() -> str:
    return "state as (select canonical_id, bool_or(inactive_at is null) as active, min(first_seen) as first_seen, case when not bool_or(inactive_at is null) then max(inactive_at) end as inactive_at, count(*) as sources from memberships group by canonical_id)"


_NEW = "firsts as (select canonical_id, min(run_id) as run_id from observed group by canonical_id), since as (select source_id, min(run_id) as since from polls where ok group by source_id), fresh as (select distinct o.run_id, o.canonical_id from observed o join firsts f using (canonical_id, run_id) join since s on s.source_id = o.source_id and s.since < o.run_id where o.run_id not in (0))"
_MEMBERSHIPS = "select canonical_id, source_id, first_seen, last_seen, inactive_at, inactive_at is null as active from memberships"
_LONGER = "regexp_matches(lower({}), '^[0-9]+\\s+locations\\b')"
_FOLD_LOCATION = f"list_reduce(list(location) over w, lambda s, x: case when {_LONGER.format('s')} and not {_LONGER.format('x')} then x when length(s) > length(x) then s else x end)"

QUERIES = {
    f.__name__: f
    for f in (
        url_identity_rules, url_provider_detect, location_filter, fingerprint, wrapper_attach, entity_resolution, source_labels, resolution_counts, membership_lifecycle,
        stream_lifecycle, entity_lifecycle, current_snapshot, running_survivorship, change_detection, inactive_reactivated_counts, new_entity_alerts, batch_resolve,
        fallback_promotion, source_onboarding, alias_union, alias_subset, parse_health, dashboard_rows,
    )
}

_place = "(" + "|".join(text.V.PLACES) + ")( (" + "|".join(text.V.QUALIFIERS) + "))? (" + "|".join(text.V.STATE_SPELLINGS) + ")"
_regions = " or ".join(f"(contains(' ' || f || ' ', ' {r} ') and not regexp_matches(f, '(^| ){r} ({'|'.join(text.V.OTHER_STATES)})( |$)'))" for r in text.V.REGIONS)
_esc = lambda c: f"replace(replace(replace(replace({c}, '\\', '\\\\'), '|', '\\|'), chr(13), ''), chr(10), '<br>')"

ORACLE_SQL = {
    "url_identity_rules": _q(O.known_ctes(), "select obs_id, link_id as canonical_id, canonical_url, direct, stable from known"),
    "url_provider_detect": _q(f"obs as ({O.obs_sql()}), {O.links('obs', 'application_url', 'x')}", "select obs_id, case when l_host = 'greenhouse.io' or l_host like '%.greenhouse.io' then 'greenhouse' when l_host = 'ashbyhq.com' or l_host like '%.ashbyhq.com' then 'ashby' when l_host = 'lever.co' or l_host like '%.lever.co' then 'lever' when l_host = 'myworkdayjobs.com' or l_host like '%.myworkdayjobs.com' then 'workday' else 'generic' end as provider, case when l_parts[-2] = 'p' then l_parts[-1] else '' end as source_job_id from x"),
    "location_filter": _q(f"obs as ({O.obs_sql()}), t as (select location, {O.fold('location')} as f from obs)", f"select location, count(*) as n from t where regexp_matches(f, '(^| ){_place}( |$)') or {_regions} group by location"),
    "fingerprint": _q(f"obs as ({O.obs_sql()})", f"select obs_id, {O.fingerprint()} as fingerprint from obs"),
    "wrapper_attach": _q(O.member_ctes(), "select obs_id, canonical_id from members where not direct"),
    "entity_resolution": _q(O.resolved_ctes(), "select run_id, canonical_id, company, position, location, salary, age, category, posted, season, application_url, job_type, url_aliases, observations from resolved"),
    "source_labels": _q(O.member_ctes(), "select run_id, canonical_id, string_agg(distinct source_id, ', ' order by source_id) as labels from members group by all"),
    "resolution_counts": _q(O.member_ctes(), "select run_id, count(*) as observations, count(distinct canonical_id) as entities, count(*) - count(distinct canonical_id) as duplicates from members group by run_id"),
    "membership_lifecycle": _q(O.lifecycle_ctes(), _MEMBERSHIPS),
    "stream_lifecycle": _q(O.lifecycle_ctes(), _MEMBERSHIPS),
    "entity_lifecycle": _q(O.lifecycle_ctes() + ", " + _state(), "select * from state"),
    "current_snapshot": _q(O.lifecycle_ctes(), "select canonical_id, string_agg(source_id, ',' order by source_id) as sources, max(last_seen) as last_change from memberships where inactive_at is null group by canonical_id"),
    "running_survivorship": _q(O.resolved_ctes(), f"""select run_id, canonical_id, arg_max(company, row(length(company), run_id)) over w as company, arg_max(position, row(length(position), run_id)) over w as position, {_FOLD_LOCATION} as location,
  last_value(salary ignore nulls) over w as salary, first_value(age ignore nulls) over w as age,
  coalesce(first_value(case when category in ('FAANG+', 'Quant') then category end ignore nulls) over w, last_value(case when category <> 'Unknown' then category end ignore nulls) over w, 'Unknown') as category,
  coalesce(last_value(case when direct then application_url end ignore nulls) over w, application_url) as application_url, job_type
  from resolved window w as (partition by canonical_id order by run_id)"""),
    "change_detection": _q(O.lifecycle_ctes(), "select run_id, canonical_id, source_id, changed, reactivated from changed where changed or reactivated"),
    "inactive_reactivated_counts": _q(O.lifecycle_ctes(), "select run_id, count(*) filter (where was and not active) as inactive, count(*) filter (where not was and active) as reactivated from (select *, lag(active) over (partition by canonical_id order by run_id) as was from activity) group by run_id having count(*) filter (where was <> active) > 0"),
    "new_entity_alerts": _q(O.member_ctes() + ", " + _NEW, "select run_id, sha256(string_agg(canonical_id, chr(10) order by canonical_id)) as batch_id, count(*) as entries, 'pending' as status from fresh group by run_id"),
    "batch_resolve": _q(O.lifecycle_ctes() + ", " + _state() + ", " + _NEW, "select f.run_id, bool_and(active is not null) as deliverable, count(*) filter (where active) as still_active, count(*) as entries from fresh f left join state s using (canonical_id) group by f.run_id"),
    "fallback_promotion": _q(O.resolved_ctes() + ", f0 as (select *, row_number() over (partition by canonical_id order by run_id) as r from resolved), d as (select canonical_id, run_id, 'fallback:' || " + O.fingerprint() + " as fallback_id from f0 where r = 1 and canonical_id not like 'fallback:%'), b as (select canonical_id as fallback_id, run_id as fallback_run from f0 where r = 1 and canonical_id like 'fallback:%')", "select fallback_id, arg_min(canonical_id, row(run_id, canonical_id)) as canonical_id, min(run_id) as run_id from d join b using (fallback_id) where fallback_run < run_id group by fallback_id"),
    "source_onboarding": _q(O.member_ctes(), "select run_id, string_agg(source_id, ',' order by source_id) as baselined from (select source_id, min(run_id) as run_id from observed group by source_id) group by run_id"),
    "alias_union": _q(O.member_ctes(), "select canonical_id, string_agg(distinct application_url, ' ' order by application_url) as url_aliases, count(distinct application_url) as n from members group by canonical_id"),
    "alias_subset": _q(O.member_ctes(), "select canonical_id, run_id, bool_and(seen < run_id) as is_subset from (select distinct canonical_id, run_id, min(run_id) over (partition by canonical_id, application_url) as seen, application_url from members) group by canonical_id, run_id"),
    "parse_health": _q(f"obs as ({O.obs_sql()})", "select source_id, category, candidates, parsed, candidates - parsed as skipped, parsed > 0 and not (candidates - parsed >= 5 and candidates - parsed > parsed) as healthy from (select source_id, category, count(*) as candidates, count(*) filter (where trim(company) <> '' and trim(position) <> '' and trim(salary) <> '' and trim(application_url) <> '') as parsed from obs group by all)"),
    "dashboard_rows": _q(
        O.resolved_ctes().replace(O.member_ctes(), O.lifecycle_ctes()) + ", " + _state()
        + ", l as (select canonical_id, string_agg(source_id, ', ' order by source_id) as labels, max(last_seen) as last_seen from memberships group by canonical_id), v as (select canonical_id, arg_max(row(company, position, job_type, category, location, salary, application_url), run_id) as v from resolved group by canonical_id)",
        f"select canonical_id, active, '| ' || {_esc('v[1]')} || ' | ' || {_esc('v[2]')} || ' | ' || {_esc('v[3]')} || ' | ' || {_esc('v[4]')} || ' | ' || {_esc('v[5]')} || ' | ' || labels || ' | ' || coalesce(v[6], 'N/A') || ' | ' || first_seen || ' | ' || last_seen || ' | ' || case when active then 'Yes' else 'No' end || ' | [Apply](<' || v[7] || '>) |' as line, first_seen, case when active then '0' else '1' end || '/' || lower(v[1]) as sort_key from state join l using (canonical_id) join v using (canonical_id)",
    ),
}

"""DuckDB SQL fragments for the oracles, kept apart from the Spark expressions they check."""

from __future__ import annotations

from tidemark.functions import values as V

from .driver_views import POLLS, obs_sql


def quoted(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


def fingerprint() -> str:
    return "sha256(" + " || chr(31) || ".join(fold(f"coalesce({c}, '')") for c in ("company", "position", "job_type", "location", "season")) + ")"


def _ends(name: str, hosts: list[str]) -> str:
    return "(" + " or ".join(f"{name} like '%{h}'" for h in hosts) + ")"


def links(source: str, url: str, tail: str) -> str:
    """CTEs over `source`: `{tail}` has its columns and the parts of `url`, plain and cleaned of all tracking."""
    board = _ends("l_host", V.PRESENTATION_HOSTS)
    always = f"starts_with(lower(p.k), 'utm_') or lower(p.k) in ({quoted(V.ALWAYS_TRACKING)}) or ({board} and lower(p.k) in ({quoted(V.PRESENTATION)}))"
    encode = lambda e: f"replace(url_encode({e}), '%20', '+')"
    shown = lambda c: f"array_to_string(list_transform({c}, lambda p: {encode('p.k')} || '=' || {encode('p.v')}), '&')"
    base = "l_scheme || '://' || l_host || l_port || l_path"
    whole = lambda c: f"case when l_abs then {base} || case when len({c}) = 0 then '' else '?' || {shown(c)} end else l_url end"
    return f"""
{tail}_0 as (select *, trim({url}) as l_url from {source}),
{tail}_1 as (select *, regexp_matches(l_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') as l_abs,
  lower(regexp_extract(l_url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as l_scheme,
  regexp_replace(regexp_extract(l_url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', '') as l_auth,
  regexp_replace(regexp_extract(l_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g') as l_way,
  regexp_extract(l_url, '^[^?#]*\\?([^#]*)', 1) as l_query from {tail}_0),
{tail}_2 as (select *, lower(translate(regexp_replace(l_auth, ':[0-9]*$', ''), '[]', '')) as l_host,
  case when regexp_extract(l_auth, ':0*([1-9][0-9]*)$', 1) = '' then '' else ':' || regexp_extract(l_auth, ':0*([1-9][0-9]*)$', 1) end as l_port,
  case when l_way in ('', '/') then '/' else regexp_replace(l_way, '/+$', '') end as l_path,
  list_transform(list_filter(string_split(l_query, '&'), lambda p: p <> ''), lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': case when contains(p, '=') then url_decode(replace(regexp_replace(p, '^[^=]*=', ''), '+', ' ')) else '' end}}) as l_pairs from {tail}_1),
{tail}_3 as (select *, list_sort(list_filter(l_pairs, lambda p: not ({always}))) as l_kept from {tail}_2),
{tail}_4 as (select *, list_filter(l_kept, lambda p: lower(p.k) not in ({quoted([*V.TRACKING, 'embed'])})) as l_bare from {tail}_3),
{tail} as (select *, {whole('l_kept')} as l_plain, {whole('l_bare')} as l_clean,
  case when l_abs then list_filter(string_split(l_path, '/'), lambda p: p <> '') else [] end as l_parts from {tail}_4)
""".strip()


_J = "list_position(l_parts, 'jobs')"
IDENTITY = f"""
case when l_host like '%ashbyhq.com' and len(l_parts) >= 2 and l_parts[2] not in ('application', 'embed') then 'ashby:' || lower(l_parts[1] || ':' || l_parts[2])
 when l_host like '%greenhouse.io' and {_J} > 1 and len(l_parts) > {_J} then 'greenhouse:' || lower(l_parts[{_J} - 1] || ':' || l_parts[{_J} + 1])
 when l_host like '%lever.co' and len(l_parts) >= 2 then 'lever:' || lower(l_parts[1] || ':' || l_parts[2])
 when l_host like '%myworkdayjobs.com%' and list_contains(list_transform(l_parts[1:-2], lambda p: lower(p)), 'job') and lower(l_parts[-1]) <> 'job' and length(l_parts[-1]) >= 5 and regexp_matches(l_parts[-1], '[0-9]') then 'workday:' || lower(l_host || ':' || l_parts[-1])
 when l_host = 'ats.rippling.com' and {_J} > 1 and len(l_parts) > {_J} then 'rippling:' || lower(l_parts[{_J} - 1] || ':' || l_parts[{_J} + 1])
 when {_ends('l_host', ['lifeattiktok.com', 'jobs.bytedance.com'])} and len(list_filter(l_parts, lambda p: regexp_full_match(p, '[0-9]{{5,}}'))) > 0 then 'tiktok:' || l_host || ':' || list_filter(l_parts, lambda p: regexp_full_match(p, '[0-9]{{5,}}'))[-1]
 when l_host like '%amazon.jobs' and {_J} > 0 and len(l_parts) > {_J} then 'amazon:' || lower(l_parts[{_J} + 1]) end
""".strip()
_WRAPPER = "(" + " or ".join(f"l_host = '{d}' or l_host like '%.{d}'" for d in V.AGGREGATORS) + ")"


def known_ctes() -> str:
    """CTEs up to `known`: observations with identity, key, strength and priority."""
    return f"""
polls as ({POLLS}),
obs as ({obs_sql()}),
{links('obs', 'application_url', 'obs_links')},
obs_ids as (select *, {IDENTITY} as stable_id from obs_links),
known as (select i.* exclude (l_bare, l_kept, l_pairs), coalesce(stable_id, 'url:' || l_plain) as link_id, case when stable_id is not null then l_clean else l_plain end as canonical_url,
  stable_id is not null as stable, stable_id is not null or (l_host <> '' and not {_WRAPPER}) as direct, {fingerprint()} as fingerprint,
  case when stable_id is not null then 0 when l_host <> '' and not {_WRAPPER} then 1 else 2 end as strength, coalesce(p.priority, 1000000) as priority
  from obs_ids i left join (select distinct source_id, priority from polls) p on i.source_id = p.source_id)
""".strip()


def member_ctes() -> str:
    """CTEs up to `members` (with entity ids) of polls that answered, one for each run, entity and source in `observed`."""
    return f"""
{known_ctes()},
ends as (select run_id, fingerprint, min(link_id) as only_id from known where direct group by run_id, fingerprint having min(link_id) = max(link_id)),
members as (select k.*, case when direct then link_id else coalesce(only_id, 'fallback:' || fingerprint) end as canonical_id
  from known k left join ends e using (run_id, fingerprint)),
ranked as (select *, row_number() over (partition by run_id, canonical_id, source_id order by strength, priority, application_url, source_id, company, position, obs_id) as place from members),
survivors as (select * from ranked where place = 1),
observed as (select s.* from survivors s semi join (select run_id, source_id from polls where ok) p on s.run_id = p.run_id and s.source_id = p.source_id)
""".strip()


_KEY = "{{strength, priority, application_url, source_id, company, position, obs_id}}"


def resolved_ctes() -> str:
    key = "row(strength, priority, application_url, source_id, company, position, obs_id)"
    longest = lambda c: f"arg_min({c}, row(-length({c}), strength, priority, application_url, source_id, company, position, obs_id)) filter (where {c} <> '') as {c}"
    first = lambda c: f"arg_min({c}, {key}) filter (where {c} <> '') as {c}"
    return f"""
{member_ctes()},
aliases as (select run_id, canonical_id, string_agg(distinct u, ' ' order by u) as url_aliases from (select run_id, canonical_id, unnest([application_url, source_url]) as u from survivors) where u <> '' group by all),
best as (select run_id, canonical_id, {longest('company')}, {longest('position')}, {longest('location')}, {first('salary')}, {first('age')}, {first('category')}, {first('posted')}, {first('season')},
  arg_min(application_url, {key}) as application_url, arg_min(job_type, {key}) as job_type, arg_min(direct, {key}) as direct, count(*) as observations from members group by run_id, canonical_id),
resolved as (select b.* replace (coalesce(category, 'Unknown') as category), a.url_aliases from best b join aliases a using (run_id, canonical_id))
""".strip()


MEANINGFUL = "company, position, job_type, location, salary, application_url, category, season, posted, source_url, kind"


def lifecycle_ctes() -> str:
    return f"""
{member_ctes()},
numbered as (select *, row_number() over (partition by source_id order by run_id) as n from polls where ok),
lagged as (select o.run_id, o.canonical_id, o.source_id, n, lag(n) over w as n_before, lag(o.run_id) over w as before,
  row({MEANINGFUL}) is distinct from lag(row({MEANINGFUL})) over w as differs
  from observed o join numbered p on o.run_id = p.run_id and o.source_id = p.source_id
  window w as (partition by o.canonical_id, o.source_id order by o.run_id)),
changed as (select *, before is null or differs as changed, coalesce(n - n_before > 1, false) as reactivated from lagged),
pairs as (select canonical_id, source_id, min(run_id) as first_seen, max(run_id) filter (where changed or reactivated) as last_seen, max(run_id) as last_observed from changed group by all),
memberships as (select canonical_id, source_id, first_seen, last_seen, (select min(p.run_id) from polls p where p.ok and p.source_id = x.source_id and p.run_id > last_observed) as inactive_at from pairs x),
grid as (select x.canonical_id, x.source_id, p.run_id, p.ok, o.run_id is not null as seen from pairs x join polls p on p.source_id = x.source_id and p.run_id >= x.first_seen
  left join observed o on o.canonical_id = x.canonical_id and o.source_id = x.source_id and o.run_id = p.run_id),
said as (select canonical_id, run_id, last_value(case when ok then seen end ignore nulls) over (partition by canonical_id, source_id order by run_id) as active from grid),
activity as (select canonical_id, run_id, bool_or(active) as active from said group by all)
""".strip()

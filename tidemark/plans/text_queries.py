"""Queries over pages, documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.functions import values as V
from tidemark.functions.lineage import cut
from tidemark.operators import inspection, outbox
from tidemark.sources import forms, json_feed, state

from . import oracle as O

NOW = "2024-02-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_canonicalize(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", urls.normalized(F.col("url")).alias("plain"), urls.normalized(F.col("url"), True).alias("bare"))


def url_dedupe_best(spark, sf_dir):
    """For each bare link: the first page, the longest spelling and all spellings."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", urls.normalized(F.col("url"), True).alias("bare"))
    return pages.groupBy("bare").agg(
        F.min("page_id").alias("first_page"),
        F.min_by("url", F.struct(-F.length("url"), F.col("page_id"))).alias("longest_url"),
        F.array_join(F.array_sort(F.collect_set("url")), " ").alias("aliases"),
        F.count("*").alias("n"),
    )


_TARGETS = ["https://example.com/a", "http://localhost/x", "http://app.localhost", "ftp://example.com", "http://10.1.2.3/", "http://172.31.0.1:80/x", "http://172.32.0.1/", "https://8.8.8.8", "http://169.254.1.1", "http://224.0.0.1", "http://0.0.0.0", "http://192.168.0.9", "https://user:p@127.0.0.1/", "//example.com", "javascript:x", "https://1.2.3.999/"]
_TARGET_VALUES = "select * from (values " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(_TARGETS)) + ") as t(id, url)"


def url_safe_public(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).cast("long").alias("id"), "url")
    rows = spark.sql(_TARGET_VALUES).select(F.col("id").cast("long").alias("id"), "url").union(pages)
    return rows.select("id", urls.safe_public(F.col("url")).alias("is_safe"))


def text_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))


#: Rows that a range holds about, and the most ranges; beyond it, ranges grow.
RANGE_ROWS, MAX_RANGES = 10_000, 1_000


def numbered(rows: DataFrame, group: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` with `ordinal`, the place by `order` in the group, without a whole group in one task.

    Rows are numbered within ranges of `order` and behind the counts of the ranges before. Bounds of ranges are
    approximate, which moves rows between ranges but changes no number.
    """
    n = min(MAX_RANGES, -(-rows.count() // range_rows))
    bounds = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)]).alias("b")).first()["b"] if n > 1 else None
    less = F.array_position(F.sort_array(F.array_append(F.array(*map(F.lit, bounds)), F.col(order))), F.col(order)) if bounds else F.lit(0)  # 1 + the bounds below
    placed = rows.withColumn("_range", F.coalesce(less.cast("int"), F.lit(0)))
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = placed.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)))
    known = own.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return known.withColumn("ordinal", F.col("_before") + F.col("_own")).drop("_range", "_group", "_at", "_before", "_own")


def first_wins_dedupe(spark, sf_dir):
    """The first document of each folded text, numbered in order of ids within its language; texts are folded once."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(text.fold(F.col("text")), 256).alias("key"))
    first = docs.groupBy("key").agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("doc_id"))
    return numbered(cut(first), "lang", "doc_id").select("doc_id", "ordinal")


def carry_forward(spark, sf_dir):
    """A role left out at odd turns is that of the turn before."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("own"))
    return turns.select("conv_id", "turn", F.coalesce(text.carry_forward("own", "conv_id", "turn"), F.lit("")).alias("role"))


def _issues(spark, sf_dir):
    """Events as issues: those of a type are alerts, a purchase stands for a pull request."""
    events = _read(spark, sf_dir, "events")
    body = F.when(F.col("event_type").isNotNull(), F.lit("text <!-- batch:v1:b --> text")).otherwise("text")
    return events.select(F.col("event_id").alias("number"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), body.alias("body"), F.when(F.col("event_type") == "purchase", "pull").alias("pull_request"))


def retention_expired(spark, sf_dir):
    """Alerts created up to the cutoff, that moment included."""
    return outbox.expired(_issues(spark, sf_dir), f"{NOW}Z").select(F.col("number").alias("event_id"))


def outbox_order(spark, sf_dir):
    """Delivery order of each user's events as pending batches: by time, then id."""
    batches = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("created_at"), F.col("event_id").cast("string").alias("batch_id"))
    return outbox.ordered(batches, "user_id").select("event_id", "position")


def retry_eligible(spark, sf_dir):
    """Failed scans below the bound of attempts, with an issue, whose entry is known."""
    events = _read(spark, sf_dir, "events").withColumn("canonical_id", F.col("user_id").cast("string"))
    status = F.when(F.col("event_id") % 4 == 0, "failed").otherwise("partial")
    scans = events.select("event_id", "canonical_id", status.alias("status"), (F.col("event_id") % 3).alias("attempt_count"), (F.col("event_id") % 5).alias("issue_number"))
    history = events.where("event_id % 7 <> 0").select("canonical_id").distinct()
    return outbox.retryable(scans, history).select("event_id")


def overlay_targets(spark, sf_dir):
    """Targets for each user: a backfill covers a delivery, which covers a retry."""
    events = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("canonical_id"), F.col("event_id").alias("issue_number"))
    of = lambda kind: events.where(F.col("event_id") % 3 == kind)
    return outbox.scan_targets(of(0), of(1), of(2)).select(F.col("canonical_id").alias("user_id"), F.col("issue_number").alias("target"), "origin")


def json_props_feed(spark, sf_dir):
    """Each event as a feed of one job, whose id is a value of its JSON column; what isn't a number is null."""
    job = F.create_map(F.lit("id"), F.from_json("props", "k string")["k"])
    feeds = _read(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"))
    return json_feed.rows(feeds).select(F.col("source_id").alias("event_id"), F.expr("try_cast(id as bigint)").alias("k"))


def marker_lookup(spark, sf_dir):
    """The first issue with each batch's mark, which is pulled out of the bodies once and not searched for."""
    body = F.concat("text", F.lit("<!-- batch:v1:"), (F.col("doc_id") % 50).cast("string"), F.lit(" -->"))
    issues = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), body.alias("body"), F.when(F.col("doc_id") % 7 == 3, "pull").alias("pull_request"))
    return outbox.sent_marks(issues).select("batch_id", F.col("issue_number").alias("first_issue"))


def anchor_extract(spark, sf_dir):
    """Links of pages with their text, in order."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(inspection.anchors(F.col("html"))).alias("position", "a"))
    links = pages.select("page_id", "position", inspection.href(F.col("a")).alias("href")).where("href <> ''")
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.min_by("href", "position").alias("first_href"))


_PAGES = ["<form>Please sign in</form>", "<p>This JOB is no longer\n available</p>", "<script src=recaptcha></script>", "Step 1 of 2", "Log in to continue step 2", "nothing", "Multi-step form"]
_PAGE_VALUES = "select * from (values " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PAGES)) + ") as t(id, html)"


def page_signals(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "html")
    rows = spark.sql(_PAGE_VALUES).select(F.col("id").cast("long").alias("id"), "html").union(pages)
    found = rows.select("id", inspection.signals(F.col("html")).alias("s"))
    return found.select("id", "s.*", inspection.page_verdict(F.col("s"), F.col("id") % 2).alias("v")).select("id", "captcha", "login", "closed", "multi_step", "v.status", "v.reason")


_LABELS = ["First name *", "Why do you want to join us?", "Are you authorized to work in the US? *", "Resume/CV **", "Race / Ethnicity", "<b>University</b>:", "Name", "Name*", "Anything else?", "Describe a project", "What is your start date", "Trace capacity statement", "Short", "one two three four five", "Years of experience required *"]
_LABEL_VALUES = "select * from (values " + ", ".join(f"({i}, '{x}', {'null' if i % 3 else repr('compliance')})" for i, x in enumerate(_LABELS)) + ") as t(id, label, section)"


def question_categorize(spark, sf_dir):
    """Labels and whole documents as labels; what is left of them is shown as a digest."""
    docs = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("label"), F.lit(None).cast("string").alias("section"))
    rows = spark.sql(_LABEL_VALUES).select(F.col("id").cast("long").alias("id"), "label", "section").union(docs)
    clean = rows.select("id", text.label(F.col("label")).alias("clean"), "section")  # once, for all that follows from it
    found = clean.withColumn("category", text.category_of(F.col("clean"), F.col("section")))
    return found.select("id", F.sha2("clean", 256).alias("clean_sha256"), "category", text.custom_of(F.col("clean"), F.col("category")).alias("is_custom"))


_TYPES = ["input_text", "Multi Select", "textarea", "checkbox", "select", "date-time", "TEL", "", "datetime", "multi_value_single_select"]


def field_type_map(spark, sf_dir):
    """A type for each part, in one of its spellings."""
    kinds = _read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % len(_TYPES)).cast("int")).alias("kind"))
    return kinds.select("p_partkey", text.field_type(F.col("kind"), F.col("p_partkey") % 2 == 1).alias("field_type"))


def tri_state_required(spark, sf_dir):
    """A group of controls is required if one is, not if one says so, else unknown."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("required"))
    return items.groupBy("l_orderkey").agg(forms.any_required("required").alias("required"))


def redact_message(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see https://x.example/"), F.col("doc_id").cast("string"), F.lit(" auth_token="), F.col("source"), F.lit("; "), "text").alias("m"))
    return docs.select("doc_id", text.safe_message(F.col("m")).alias("message"))


def markdown_escape(spark, sf_dir):
    """Digests of whole texts as escaped."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.markdown_cell(F.col("text")), 256).alias("cell_sha256"), F.sha2(text.escape_text(F.col("text")), 256).alias("escaped_sha256"))


def option_sets(spark, sf_dir):
    """Answer options in order, the first of each kind regardless of case."""
    parts = _read(spark, sf_dir, "part").select("p_size", "p_partkey", "p_type")
    first = parts.groupBy("p_size", "p_type").agg(F.min("p_partkey").alias("at"))  # each spelling once, so a group holds no more
    listed = first.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p_type"))), lambda x: x["p_type"]).alias("options"))
    return listed.select("p_size", F.array_join(forms.distinct_options(F.col("options")), "; ").alias("options"))


def sensitive_keys(spark, sf_dir):
    """Metadata without the keys that mustn't be kept, at any depth, and with the others in order."""
    inner = F.struct(F.lit("p").alias("Pass_word"), F.col("event_id").alias("k"))
    data = F.struct(F.lit("x").alias("Auth_Token"), F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("sessionId"), F.array(inner, inner).alias("n")).alias("deep"), F.lit("y").alias("csrf"))
    events = _read(spark, sf_dir, "events").select("event_id", F.to_json(data, {"ignoreNullFields": "false"}).alias("m"))
    return events.select("event_id", state.pruned(F.col("m")).alias("metadata"))


QUERIES = {
    f.__name__: f
    for f in (
        url_canonicalize, url_dedupe_best, url_safe_public, text_normalize, first_wins_dedupe, carry_forward, retention_expired, outbox_order, retry_eligible, overlay_targets,
        json_props_feed, marker_lookup, anchor_extract, page_signals, question_categorize, field_type_map, tri_state_required, redact_message, markdown_escape, option_sets, sensitive_keys,
    )
}

_any = lambda t, terms: "(" + " or ".join("contains({}, '{}')".format(t, x.replace("'", "''")) for x in terms) + ")"
_label = lambda c: f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(replace(replace(regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')), '(?i)(?:\\s|\\*)+(?:required)?\\s*\\*+\\s*$', '')), ':+$', ''))"
_pub = " or ".join(f"(n >= {urls._address(a)} and n < {urls._address(a) + (1 << (32 - b))})" for a, b in urls._PRIVATE)
_cats = f"""case when {_any("coalesce(lower(section), '') || ' ' || low", V.DEMOGRAPHIC)} then 'compliance_demographic' when {_any('low', V.AUTHORIZATION)} then 'work_authorization' when contains(coalesce(lower(section), ''), 'compliance') then 'compliance_demographic' """ + " ".join(f"when {'low = ' + repr('name') + ' or ' if k == 'profile' else ''}{_any('low', t)} then '{k}'" for k, t in V.LATER_CATEGORIES.items()) + " else 'other' end"
_steps = "(contains(t, 'step 1') or contains(t, 'step 2') or contains(t, 'multi-step') or contains(t, 'multistep') or (contains(t, 'of 2') and contains(t, 'step')))"
_verdict = "case when closed then 'closed' when captcha then 'captcha' when login and id % 2 > 0 then 'login_fields' when login then 'login' when id % 2 > 0 and multi_step then 'steps' when id % 2 > 0 then 'fields' else 'none' end"
_reason = "case k " + " ".join(f"when '{k}' then '{v}'" for k, v in V.REASONS.items()) + " end"
_kinds = "case r " + " ".join(f"when '{k}' then '{v}'" for k, v in V.FIELD_TYPES.items()) + " else 'unknown' end"

ORACLE_SQL = {
    "url_canonicalize": f"with {O.links('pages', 'url', 'x')} select page_id, l_plain as plain, l_clean as bare from x",
    "url_dedupe_best": f"with {O.links('pages', 'url', 'x')} select l_clean as bare, min(page_id) as first_page, arg_min(url, row(-length(url), page_id)) as longest_url, string_agg(distinct url, ' ' order by url) as aliases, count(*) as n from x group by l_clean",
    "url_safe_public": f"with v as ({_TARGET_VALUES}), r as (select id::bigint as id, url from v union all select page_id + 1000, url from pages), {O.links('r', 'url', 'x')}, y as (select id, l_url, l_host as h, regexp_full_match(l_host, '((25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(\\.(?!$)|$)){{4}}') as four from (select * replace (rtrim(l_host, '.') as l_host) from x))".replace("(\\.(?!$)|$)", "\\.?") + f", z as (select *, case when four and len(string_split(h, '.')) = 4 then list_reduce(list_transform(string_split(h, '.'), lambda o: o::bigint), lambda a, b: a * 256 + b) end as n from y) select id, regexp_matches(lower(l_url), '^https?://') and h not in ('', 'localhost') and h not like '%.localhost' and (n is null or not ({_pub})) as is_safe from z",
    "text_normalize": f"select doc_id, sha256({O.fold('text')}) as folded_sha256 from documents",
    "first_wins_dedupe": f"select doc_id, row_number() over (partition by lang order by doc_id) as ordinal from (select arg_min(lang, doc_id) as lang, min(doc_id) as doc_id from documents group by {O.fold('text')})",
    "retention_expired": f"select event_id from events where event_type is not null and event_type <> 'purchase' and date_trunc('second', ts) <= timestamp '{NOW}' - interval {V.ALERT_RETENTION_DAYS} days",
    "outbox_order": "select event_id, row_number() over (partition by user_id order by ts, event_id::varchar) as position from events",
    "carry_forward": "select conv_id, turn, coalesce(last_value(case when turn % 2 = 0 then role end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row), '') as role from conversations",
    "retry_eligible": f"select event_id from events e where event_id % 4 = 0 and event_id % 3 < {V.SCAN_ATTEMPTS} and event_id % 5 >= 1 and exists (select 1 from events k where k.user_id = e.user_id and k.event_id % 7 <> 0)",
    "overlay_targets": "select user_id, arg_min(event_id, row(-(event_id % 3), event_id)) as target, case max(event_id % 3) when 0 then 'retry' when 1 then 'delivery' else 'backfill' end as origin from events group by user_id",
    "json_props_feed": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "marker_lookup": "select (doc_id % 50)::varchar as batch_id, min(doc_id) as first_issue from documents where doc_id % 7 <> 3 group by 1",
    "anchor_extract": "with m as (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'), lambda a: regexp_extract(a, '(?is)^<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']+)', 1)), lambda h: h <> '') as h from pages) select page_id, len(h) as n, replace(h[1], '&amp;', '&') as first_href from m where len(h) > 0",
    "page_signals": f"with v as ({_PAGE_VALUES}), r as (select id::bigint as id, html from v union all select page_id + 1000, html from pages), t as (select id, lower(regexp_replace(html, '\\s+', ' ', 'g')) as t from r), s as (select id, {_any('t', V.CAPTCHA)} as captcha, {_any('t', V.LOGIN)} as login, {_any('t', V.CLOSED)} as closed, {_steps} as multi_step from t), k as (select *, {_verdict} as k from s) select id, captcha, login, closed, multi_step, case when k in ('login_fields', 'steps', 'fields') then 'partial' else 'unavailable' end as status, {_reason} as reason from k",
    "question_categorize": f"with v as ({_LABEL_VALUES}), r as (select id::bigint as id, label, section from v union all select doc_id + 1000, text, null from documents), c as (select id, {_label('label')} as clean, section from r), l as (select *, lower(clean) as low from c), k as (select *, {_cats} as category from l) select id, sha256(clean) as clean_sha256, category, category = 'job_specific' or (category = 'other' and (contains(clean, '?') or len(list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: w <> '')) >= 5)) as is_custom from k",
    "field_type_map": f"with v as (select p_partkey, {_TYPES!r}[p_partkey % {len(_TYPES)} + 1] as kind, p_partkey % 2 = 1 as multiple from part), r as (select *, replace(replace(trim(lower(coalesce(nullif(kind, ''), 'unknown'))), '-', '_'), ' ', '_') as r from v), k as (select *, {_kinds} as t from r) select p_partkey, case when multiple and t in ('single_select', 'checkbox') then 'multi_select' else t end as field_type from k",
    "tri_state_required": "select l_orderkey, bool_or(case l_returnflag when 'R' then true when 'A' then false end) as required from lineitem group by l_orderkey",
    "redact_message": "select doc_id, left(regexp_replace(regexp_replace('see https://x.example/' || doc_id || ' auth_token=' || source || '; ' || text, '(?i)https?://[^\\s''\"<>]+', '<url>', 'g'), '(?i)\\b(cookie|csrf(?:[_ -]?token)?|(?:access|auth|refresh|session|id)?[_ -]?token|authorization)\\s*[=:]\\s*[^\\s,;]+', '\\1=<redacted>', 'g'), 500) as message from documents",
    "markdown_escape": "select doc_id, sha256(replace(replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(13), ''), chr(10), '<br>')) as cell_sha256, sha256(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '*', '\\*'), '[', '\\['), ']', '\\]'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')) as escaped_sha256 from documents",
    "option_sets": "with f as (select p_size, lower(p_type) as key, arg_min(p_type, p_partkey) as option, min(p_partkey) as pk from part group by p_size, lower(p_type)) select p_size, string_agg(option, '; ' order by pk) as options from f group by p_size",
    "sensitive_keys": "select event_id, '{\"deep\": {\"n\": [{\"k\": ' || event_id || '}, {\"k\": ' || event_id || '}]}, \"kind\": ' || coalesce('\"' || event_type || '\"', 'null') || '}' as metadata from events",
}

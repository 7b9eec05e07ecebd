"""Queries over feeds, forms and schemas that are rendered from the tables: one document for each customer or part, broken by
rules on its key, and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.lineage import spread
from tidemark.operators import enrichment, inspection, outbox, render, sinks
from tidemark.sources import forms, html_table, json_feed, markdown, registry, state
from tidemark.streaming.polls import _shared

#: How a document is broken, by the customer's key; the others are whole.
RULES = 11


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))


def _joined(orders: DataFrame, row: str, name: str, between: str = "") -> DataFrame:
    """One text for each customer: the rows of its orders, in order."""
    return orders.selectExpr("c", "k", f"{row} as row").groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), between).alias(name))


_HEAD = "| Company | Position | Location | Salary | Posting | Age |"
_LINE = "| --- | :--- | ---: | :---: | --- | --- |"
_EMPTY = "\\n".join(f"<!-- TABLE_{t}_START -->\\n{_HEAD}\\n{_LINE}\\n<!-- TABLE_{t}_END -->" for t in ("FAANG", "QUANT"))
_MALFORMED = "(k % 4 = 3 or (c % 5 = 1 and k % 4 <> 0))"
_ROW = rf"""concat('|', k % 10, 'Co &eacute; ', k, k % 10, '|1st *Eng* ', k, ' \\| x|', k % 7, ' 2nd St, Oakland, CA ', k % 7, '||',
  if({_MALFORMED}, 'Info', concat('<a href="https://x.example/', k, '?a=1&amp;b=2" title="a|b"><img alt="Apply"></a>')), '|', k % 30, 'd|')"""


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(source_id, c, body)`: cells with digits and spaces at their ends, pipes in tags and behind backslashes, references."""
    rows = _joined(_orders(spark, sf_dir), _ROW, "rows", "\n")
    body = f"""concat('{_EMPTY}\n<!-- TABLE_START -->\n', if(c % {RULES} = 1, replace('{_HEAD}', ' Location |', ''), '{_HEAD}'), if(c % {RULES} = 2, '', '\n{_LINE}'), '\n', rows,
      if(c % {RULES} = 3, '\nA note.', ''), if(c % {RULES} = 0, '', '\n<!-- TABLE_END -->'), '\n')"""
    return rows.selectExpr("concat('c', c) as source_id", "c", f"{body} as body")


_JOB = "named_struct('id', string(k), 'company', if(k % 3 = 0, null, concat(' Co ', k, ' ')), 'title', concat('Eng ', k), 'location', 'Oakland, CA', 'category', if(k % 4 = 0, 'Product', 'software engineering'), 'listingUrl', if(k % 2 = 0, concat('https://x.example/', k), null), 'url', concat('https://y.example/', k), 'age', concat(k % 30, 'd'))"


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _joined(_orders(spark, sf_dir), f"to_json({_JOB})", "rows", ",")
    body = f"""concat('{{"updatedAt": "2026-01-01", "', if(c % {RULES} = 1, 'items', 'jobs'), '": [', rows, ']', if(c % {RULES} = 0, '', '}}'))"""
    return jobs.selectExpr("concat('c', c) as source_id", "c", f"{body} as body")


_CELLS = """concat('<tr><td>', if(k % 3 = 0, concat('<b>Co ', k, '</b>'), '↳'), '</td><td>Eng ', k, '</td><td>SF, CA<br/>Austin</td><td><a href="https://simplify.jobs/p/', k,
  '"><img alt="Simplify"></a><a href="https://co.example/', k, '"><img alt="Apply"></a></td><td>', k % 30, 'd</td></tr>')"""


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(_orders(spark, sf_dir), _CELLS, "rows", "\n")
    body = f"""concat('## Other\n## 💻 Software Engineering ', if(c % {RULES} = 0, '', 'Internship '), 'Roles\n<table><tr><th>Company</th><th>Role</th><th>Location</th><th>Application</th>', if(c % {RULES} = 1, '', '<th>Age</th>'), '</tr>\n', rows,
      '</table>\n## Archived Software Engineering Internship Roles (old)\n')"""
    return rows.selectExpr("concat('c', c) as source_id", "c", f"{body} as body")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(source_id, format, body, error)`: a format for each customer; some weren't fetched, some are of no known format."""
    kind = {"markdown": "c % 4 < 2", "json_internships": "c % 4 = 2", "html_table": "c % 4 = 3"}
    made = {"markdown": markdown_documents, "json_internships": json_documents, "html_table": html_documents}
    parts = [f(spark, sf_dir).where(kind[name]).selectExpr("source_id", f"if(c % 17 = 16, 'csv', '{name}') as format", "if(c % 13 = 12, null, body) as body", "if(c % 13 = 12, 'HTTP 500', null) as error") for name, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def markdown_table_scan(spark, sf_dir):
    return markdown.parse(markdown_documents(spark, sf_dir)).select("source_id", "category", "company", "position", "location", "salary", "age", "application_url", "valid")


def markdown_health(spark, sf_dir):
    return markdown.health(markdown.parse(markdown_documents(spark, sf_dir)))


def json_feed_scan(spark, sf_dir):
    return json_feed.internships(json_documents(spark, sf_dir)).select("source_id", "company", "position", "application_url", "source_job_id", "category", "age", "valid")


def html_table_scan(spark, sf_dir):
    return html_table.parse(html_documents(spark, sf_dir)).select("source_id", "company", "position", "location", "application_url", "source_url", "source_job_id", "age", "category", "valid")


def feed_dispatch(spark, sf_dir):
    found = registry.parse(documents(spark, sf_dir).where(F.col("format") != "csv"))
    return found.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if("valid").alias("parsed"))


def _diagnosed(spark, sf_dir, *errors: str) -> DataFrame:
    told = markdown.diagnose(markdown_documents(spark, sf_dir)).select("source_id", "category", "candidates", "parsed", "error")
    return told.where(F.col("error").isin(*errors))


def feed_missing_marker(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "not exactly one pair of markers in order")


def feed_missing_header(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "no compatible table", "no separator behind the header", "something else than rows behind the header")


def feed_all_malformed(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "none of the rows could be parsed", "more rows malformed than parsed")


def poll_outcomes(spark, sf_dir):
    """Which polls answered, and why others didn't; a broken feed is never an empty one."""
    return registry.outcomes(documents(spark, sf_dir))


def healthy_observations(spark, sf_dir):
    """Observations of all feeds that answered; none of a source whose poll didn't."""
    return registry.healthy(documents(spark, sf_dir)).select("source_id", "company", "position", "location", "age", "application_url")


def provenance_infer(spark, sf_dir):
    """Names of the sources of records that carry a file and a type only."""
    records = _read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 3 = 0, 'NEW_GRAD_USA.md', 'README.md') as source_file", "if(o_orderkey % 2 = 0, 'Internship', 'New Grad') as job_type", "if(o_orderkey % 5 = 0, 'own', if(o_orderkey % 5 = 1, '', null)) as source_id", "if(o_orderkey % 5 = 0, 'Own', null) as source_label")
    return registry.with_provenance(records).select("id", "source_id", "source_label")


def html_form_extract(spark, sf_dir):
    """A form for each part: a named control, a list with a placeholder and repeated answers, radio buttons, hidden ones."""
    html = """concat('<header><input name="q"></header><form><label for="a">', p_name, ' *</label><input id="a" name="n" required><label>Brand <select name="b"><option>Select</option><option>', p_brand, '</option><option>', lower(p_brand),
      '</option><option>', p_type, '</option></select></label><fieldset><legend>Size ', p_size, '?</legend><label><input type="radio" name="s" aria-required="false"> Yes</label><label><input type="radio" name="s"> No</label></fieldset><div hidden>',
      repeat('<div>', p_partkey % 20), '<input name="trap">', repeat('</div>', p_partkey % 20), '</div><textarea name="cover_letter"></textarea></form>')"""
    pages = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").selectExpr("p_partkey as page_id", f"{html} as html")
    return forms.questions(pages).select("page_id", "ordinal", "label", "field_type", "required", F.array_join("options", "|").alias("options"), "section", "field_name")


def ats_schema_extract(spark, sf_dir):
    """A schema for each part: fields that are hidden, values that are objects or texts, groups that are absent."""
    payload = """concat('{"questions": [{"label": "', p_name, '", "required": ', if(p_size % 2 = 0, 'true', '"no"'), ', "fields": [{"name": "a', p_partkey, '", "type": "input_text"}]}, {"label": "Geo", "fields": [{"name": "lat", "type": "input_hidden"}]},
      {"label": "Brand", "fields": [{"name": "b", "type": "multi_value_single_select", "values": [{"label": "', p_brand, '", "value": 1}, "', lower(p_brand), '", "', p_type, '"]}]}], "demographic_questions": null', if(p_partkey % 3 = 0, ', "compliance": 5', ''), '}')"""
    payloads = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type"), "p_partkey").selectExpr("p_partkey as page_id", f"{payload} as payload")
    return forms.schema_questions(payloads).select("page_id", "ordinal", "label", "field_type", "required", F.array_join("options", "|").alias("options"), "section", "field_name")


def schema_nested(spark, sf_dir):
    """Questions up to 12 levels below the top of a group, in lists and in objects, between others; their order is kept."""
    asked = lambda label: f"""'{{"label": "{label} ', k, '", "type": "text"}}'"""
    payload = f"""concat('{{"questions": ', repeat('{{"z": [{{"label": 5}}, ', k % 7), '[', {asked('First')}, ', {{"label": "No shape"}}, ', {asked('Second')}, ']', repeat(']}}', k % 7), ', "compliance": [', {asked('Third')}, ']}}')"""
    payloads = spread(_orders(spark, sf_dir).select("k"), "k").selectExpr("k as page_id", f"{payload} as payload")
    return forms.schema_questions(payloads).select("page_id", "ordinal", "label", "section")


def scan_block_render(spark, sf_dir):
    """The block of a scan of each part's form: questions of all kinds, read from the form, in their sections and folded."""
    html = """concat('<header><input name="q" placeholder="Search"></header><form><label for="n">Full name *</label><input id="n" name="full_name" required><label>Email <input type="email" name="email" aria-required="false"></label>',
      '<span id="t">Phone number</span><input type="tel" aria-labelledby="t"><textarea name="cover_letter"></textarea><input type="hidden" name="z"><input type="submit"><label for="c">Country</label><select id="c" name="country"><option>Select</option><option>',
      p_brand, '</option><option>', lower(p_brand), '</option><option>', p_type, '</option></select><fieldset><legend>Do you need visa sponsorship?</legend><label><input type="radio" name="v"',
      case p_partkey % 3 when 0 then ' required' when 1 then ' aria-required="false"' else '' end, '> Yes</label><label><input type="radio" name="v"> No</label></fieldset><fieldset><legend>*', p_name, if(p_partkey % 5 = 0, '?', ''),
      '</legend><label><input type="checkbox" name="s"> SQL</label><label><input type="checkbox" name="s"> Java</label></fieldset><div style="display: none"><input name="trap"></div></form>')"""
    parts = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    scans = parts.selectExpr("p_partkey as page_id", "'generic' as provider", "if(p_partkey % 2 = 0, 'partial', 'complete') as status", "concat('https://x.example/a b/', p_partkey, '?c=(1)') as application_url", "if(p_partkey % 3 = 0, 'Only a part.', '') as reason")
    return render.scan_blocks(scans, forms.questions(parts.selectExpr("p_partkey as page_id", f"{html} as html")))


def block_upsert(spark, sf_dir):
    """Digests of whole bodies, every other one with text on both sides of its block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("t"))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("t", F.lit("<!-- scan:start 7 -->old<!-- scan:end 7 -->"), "t")).otherwise(F.col("t"))
    return docs.select("doc_id", F.sha2(render.upsert_block(body, "7", F.lit("new \\1 $2")), 256).alias("body_sha256"))


def character_references(spark, sf_dir):
    """Whole texts with letters written as references, named and numeric, read again."""
    written = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&#38;")), F.lit("a"), F.lit("&#47;")), F.lit("o"), F.lit("&#x2019;")), F.lit("e"), F.lit("&eacute;"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.unescape(written), 256).alias("text_sha256"))


def apply_links(spark, sf_dir):
    """Links to apply by, in pages that hide one before it, as seen from a page six folders deep."""
    html = F.expr("concat('<div hidden><p><a href=/no>Apply</a></p></div><a href=', repeat('../', page_id % 9), 'go/', page_id, '>Apply <b>now</b></a>', coalesce(html, ''))")
    found = inspection.apply_link(html, F.lit("https://jobs.example.com/1/2/3/4/5/6/page.html?x=../y"))
    return _read(spark, sf_dir, "pages").select("page_id", found.alias("link"))


def prohibited_keys(spark, sf_dir):
    """Records whose keys mustn't be kept, some with an escaped letter; values may say anything."""
    record = """concat('{"note": "', coalesce(event_type, ''), ': \\\\"token\\\\": 1", "deep": [{"', case event_id % 4 when 0 then 'to\\\\u006ben' when 1 then 'Set-Cookie' when 2 then 'kind' else 'tok' end, '" : ', event_id, '}]}')"""
    return _read(spark, sf_dir, "events").selectExpr("event_id", f"{record} as record").select("event_id", state.prohibited(F.col("record")).alias("is_prohibited"))


def bucket_commits(spark, sf_dir):
    """Orders committed by key, and again after some changed, some went and some came: only the buckets that differ are written."""
    store = sinks.Snapshots(spark, _shared(spark))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    moved = F.col("o_orderkey") % 1000
    store.commit(keys={"orders": ["o_orderkey"]}, orders=rows.where(moved != 7))
    later = rows.where(moved != 5).withColumn("version", F.when(moved == 3, 2).otherwise(1))
    store.commit(keys={"orders": ["o_orderkey"]}, orders=later)
    return store.read("orders")


def alias_index(spark, sf_dir):
    """The first page of each link, by an index that pages come to in two polls, looked up by all of them as batches."""
    store = sinks.Snapshots(spark, _shared(spark))
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("canonical_id"), F.col("url").alias("application_url"), F.array(F.concat("url", F.lit("#"))).alias("url_aliases"))
    for poll in (1, 0):
        outbox.index_links(store, pages.where(F.col("page_id") % 2 == poll))
    batches = pages.select(F.col("page_id").alias("batch_id"), F.array(F.concat("application_url", F.lit("#")), F.lit("gone")).alias("job_urls"))
    return outbox.entries_by_index(batches, store).select(F.col("batch_id").alias("page_id"), "position", F.col("canonical_id").cast("long").alias("first_page"), "found")


def refused(row: dict) -> None:
    """An action that some alerts refuse."""
    if row["number"] % 7 == 0:
        raise OSError("refused")


def enrichment_loop(spark, sf_dir):
    """Two runs over all pages as entries, five to an alert: scans that fail are tried once more, alerts that refuse stay pending."""
    store = sinks.Snapshots(spark, _shared(spark))
    pages = _read(spark, sf_dir, "pages").selectExpr("page_id", "string(page_id) as canonical_id", "concat('https://jobs.example.com/', page_id) as application_url", "bigint(floor(page_id / 5)) + 1 as issue_number")
    bodies = pages.selectExpr("issue_number as number", "concat('# Alert ', issue_number) as body").distinct()

    def inspect(failing: int):
        def told(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
            status = F.when(F.col("canonical_id").cast("long") % failing == 0, "failed").otherwise("partial")
            asked = targets.selectExpr("canonical_id as page_id", "1 as ordinal", "'Why us?' as label", "'text' as field_type", "true as required", "array() as options", "'job_specific' as category", "string(null) as section", "true as is_custom", "'q' as field_name")
            return targets.select("canonical_id", F.lit("generic").alias("provider"), status.alias("status"), F.lit("seen").alias("reason")), asked

        return told

    act = f"{__name__}:refused"
    enrichment.enrich(store, pages, pages, bodies, inspect(3), act, "t1")
    enrichment.enrich(store, pages.where("false"), pages, bodies, inspect(6), act, "t2")
    scans = store.read("scans")
    return scans.select("canonical_id", "status", "attempt_count", "first_scanned", "last_scanned", "issue_number", "update_pending", F.size("questions").cast("long").alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        markdown_table_scan, markdown_health, json_feed_scan, html_table_scan, feed_dispatch, html_form_extract, ats_schema_extract, scan_block_render, schema_nested, block_upsert, feed_missing_marker, feed_missing_header, feed_all_malformed, poll_outcomes,
        healthy_observations, provenance_infer, character_references, apply_links, prohibited_keys, bucket_commits, alias_index, enrichment_loop,
    )
}

_O = f"o as (select o_custkey as c, o_orderkey as k, 'c' || o_custkey as source_id, o_custkey % {RULES} as r, not {_MALFORMED} as good from (select *, o_custkey as c, o_orderkey as k from orders))"
_MD = r"""md as (select *, k % 10 || 'Co é ' || k || k % 10 as company, '1st Eng ' || k || ' \| x' as position, k % 7 || ' 2nd St, Oakland, CA ' || k % 7 as location, k % 30 || 'd' as age, case when good then 'https://x.example/' || k || '?a=1&b=2' end as application_url from o)"""
_JS = "js as (select *, case when k % 3 <> 0 then 'Co ' || k end as company, 'Eng ' || k as position, 'Oakland, CA' as location, k % 30 || 'd' as age, case when k % 2 = 0 then 'https://x.example/' || k else 'https://y.example/' || k end as application_url, k % 3 <> 0 as valid from o where k % 4 <> 0)"
_HT = "ht as (select *, last_value(case when k % 3 = 0 then 'Co ' || k end ignore nulls) over (partition by c order by k) as company, 'Eng ' || k as position, 'SF, CA | Austin' as location, k % 30 || 'd' as age, 'https://co.example/' || k as application_url from o)"
_COUNTS = "n as (select source_id, any_value(r) as r, any_value(c) as c, count(*) as candidates, count(*) filter (where good) as parsed from o group by source_id)"
_ERROR = """case when r = 0 then 'not exactly one pair of markers in order' when r = 1 then 'no compatible table' when r = 2 then 'no separator behind the header' when r = 3 then 'something else than rows behind the header'
  when parsed = 0 then 'none of the rows could be parsed' when candidates - parsed >= 5 and candidates - parsed > parsed then 'more rows malformed than parsed' end"""
_TOLD = f"told as (select source_id, 'Other' as category, case when r > 3 then candidates else 0 end::bigint as candidates, case when r > 3 then parsed else 0 end::bigint as parsed, {_ERROR} as error from n)"
#: What each document comes to, of whichever format it is.
_POLLS = f"""{_O}, {_MD}, {_JS}, {_HT}, {_COUNTS},
jn as (select source_id, count(*) filter (where valid) as parsed from js where r > 1 group by source_id),
hn as (select source_id, count(*) filter (where company is not null) as parsed from ht where r > 1 group by source_id),
f as (select n.source_id, n.c, n.r, case when n.c % 4 < 2 then 'm' when n.c % 4 = 2 then 'j' else 'h' end as kind, n.candidates, n.parsed as mp, coalesce(jn.parsed, 0) as jp, coalesce(hn.parsed, 0) as hp from n left join jn using (source_id) left join hn using (source_id)),
p as (select source_id, c, kind, case when c % 13 = 12 or c % 17 = 16 then 0 when kind = 'm' then case when r > 3 then mp else 0 end when kind = 'j' then jp else hp end::bigint as parsed,
  case when c % 13 = 12 then 'HTTP 500' when c % 17 = 16 then 'no parser for this format'
    when kind = 'm' then 'Other: ' || (select any_value(error) from (select {_ERROR} as error from (select f.r, f.mp as parsed, f.candidates)))
    when r = 0 then 'Software Engineering: ' || case kind when 'j' then 'not valid JSON' else 'no section of the expected name' end
    when r = 1 then 'Software Engineering: ' || case kind when 'j' then 'no array of jobs' else 'unexpected header' end
    when (case kind when 'j' then jp else hp end) = 0 then 'Software Engineering: no valid rows' end as error from f)"""
_BLOCK = f"""'## Application Questions' || chr(10) || chr(10) || '**Scan status:** ' || case when p_partkey % 2 = 0 then 'Partial' else 'Complete' end || '  ' || chr(10) || '**Provider:** Generic  ' || chr(10) || '**Questions detected:** 7  ' || chr(10)
  || '**Custom / screening questions:** ' || case when p_partkey % 5 = 0 then 1 else 0 end || chr(10) || chr(10) || '[Open application](<https://x.example/a%20b/' || p_partkey || '?c=%281%29>)' || chr(10) || chr(10)
  || case when p_partkey % 3 = 0 then '> Only a part.' || chr(10) || chr(10) else '' end || case when p_partkey % 5 = 0 then '### Custom screening questions' || chr(10) || chr(10) || '8. **\\*' || p_name || '?' || asked else '' end
  || '### Work authorization' || chr(10) || chr(10) || '6. **Do you need visa sponsorship?**  ' || chr(10) || '   ' || case p_partkey % 3 when 0 then 'Required' when 1 then 'Optional' else 'Requirement not stated' end || ' — radio — Options: Yes / No' || chr(10) || chr(10)
  || case when p_partkey % 5 = 0 then '' else '### Other visible questions' || chr(10) || chr(10) || '8. **\\*' || p_name || asked end || '<details>' || chr(10) || '<summary>Standard application fields</summary>' || chr(10) || chr(10)
  || '1. **Full name**  ' || chr(10) || '   Required — text' || chr(10) || '2. **Email**  ' || chr(10) || '   Optional — email' || chr(10) || '3. **Phone number**  ' || chr(10) || '   Requirement not stated — phone' || chr(10)
  || '5. **Country**  ' || chr(10) || '   Requirement not stated — single select — Options: ' || p_brand || case when lower(p_brand) = lower(p_type) then '' else ' / ' || p_type end || chr(10) || '4. **Cover letter**  ' || chr(10) || '   Requirement not stated — long text' || chr(10) || chr(10)
  || '</details>' || chr(10) || chr(10) || '{render.READ_ONLY}' || case when p_partkey % 2 = 0 then chr(10) || '{render.PARTIAL}' else '' end || chr(10)"""
_OPTIONS = "case when lower(p_brand) = lower(p_type) then p_brand else p_brand || '|' || p_type end"

ORACLE_SQL = {
    "markdown_table_scan": f"with {_O}, {_MD} select source_id, 'Other' as category, company, position, location, null::varchar as salary, age, application_url, good as valid from md where r > 3",
    "markdown_health": f"with {_O} select source_id, 'Other' as category, count(*) as candidates, count(*) filter (where good) as parsed, count(*) filter (where not good) as skipped, count(*) filter (where good) > 0 and not (count(*) filter (where not good) >= 5 and count(*) filter (where not good) > count(*) filter (where good)) as healthy from o where r > 3 group by source_id",
    "json_feed_scan": f"with {_O}, {_JS} select source_id, company, position, application_url, k::varchar as source_job_id, 'Software Engineering' as category, age, valid from js where r > 1",
    "html_table_scan": f"with {_O}, {_HT} select source_id, company, position, location, application_url, 'https://simplify.jobs/p/' || k as source_url, k::varchar as source_job_id, age, 'Unknown' as category, company is not null as valid from ht where r > 1",
    "feed_dispatch": f"with {_O}, {_JS}, {_HT}, a as (select source_id, c, 0 as f, good as ok from o where r > 3 union all select source_id, c, 2, valid from js where r > 1 union all select source_id, c, 3, company is not null from ht where r > 1) select source_id, count(*) as candidates, count(*) filter (where ok) as parsed from a where c % 17 <> 16 and c % 13 <> 12 and f = case when c % 4 < 2 then 0 else c % 4 end group by source_id",
    "feed_missing_marker": f"with {_O}, {_COUNTS}, {_TOLD} select * from told where error like 'not exactly%'",
    "feed_missing_header": f"with {_O}, {_COUNTS}, {_TOLD} select * from told where error like 'no compatible%' or error like 'no separator%' or error like 'something else%'",
    "feed_all_malformed": f"with {_O}, {_COUNTS}, {_TOLD} select * from told where error like 'none of%' or error like 'more rows%'",
    "poll_outcomes": f"with {_POLLS} select source_id, error is null as ok, parsed, error from p",
    "healthy_observations": f"with {_POLLS}, a as (select 'm' as kind, source_id, company, position, location, age, application_url from md where good union all select 'j', source_id, company, position, location, age, application_url from js where valid union all select 'h', source_id, company, position, location, age, application_url from ht where company is not null) select source_id, company, position, location, age, application_url from a join p using (source_id, kind) where error is null",
    "provenance_infer": "select o_orderkey as id, case when o_orderkey % 5 = 0 then 'own' when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then 'speedyapply_internships' when o_orderkey % 3 = 0 and o_orderkey % 2 = 1 then 'speedyapply_new_grad' else 'legacy_speedyapply' end as source_id, case when o_orderkey % 5 = 0 then 'Own' else 'SpeedyApply' end as source_label from orders",
    "html_form_extract": f"select p_partkey as page_id, 1 as ordinal, p_name as label, 'text' as field_type, true as required, '' as options, null::varchar as section, 'n' as field_name from part union all select p_partkey, 2, 'Brand', 'single_select', null, {_OPTIONS}, null, 'b' from part union all select p_partkey, 3, 'Size ' || p_size || '?', 'radio', false, 'Yes|No', 'Size ' || p_size || '?', 's' from part union all select p_partkey, 5, 'Cover letter', 'long_text', null, '', null, 'cover_letter' from part",
    "ats_schema_extract": f"select p_partkey as page_id, 1 as ordinal, p_name as label, 'text' as field_type, p_size % 2 = 0 as required, '' as options, 'questions' as section, 'a' || p_partkey as field_name from part where p_partkey % 3 <> 0 union all select p_partkey, 2, 'Brand', 'single_select', null, {_OPTIONS}, 'questions', 'b' from part where p_partkey % 3 <> 0",
    "schema_nested": "select o_orderkey as page_id, i as ordinal, ['First', 'Second', 'Third'][i] || ' ' || o_orderkey as label, case i when 3 then 'compliance' else 'questions' end as section from orders, (select unnest([1, 2, 3]) as i)",
    "scan_block_render": f"select p_partkey as page_id, {_BLOCK} as block from (select *, '**  ' || chr(10) || '   Requirement not stated — multi select — Options: SQL / Java' || chr(10) || chr(10) as asked from part)",
    "block_upsert": "with b as (select doc_id, text as t, '<!-- scan:start 7 -->' || chr(10) || 'new \\1 $2' || chr(10) || '<!-- scan:end 7 -->' as k from documents) select doc_id, sha256(case when doc_id % 2 = 0 then t || k || t else t || case when right(t, 1) = chr(10) or t = '' then '' else chr(10) end || chr(10) || k || chr(10) end) as body_sha256 from b",
    "character_references": "select doc_id, sha256(replace(replace(replace(text, 'e', 'é'), 'a', '/'), 'o', '’')) as text_sha256 from documents",
    "apply_links": "select page_id, 'https://jobs.example.com/' || array_to_string(['1', '2', '3', '4', '5', '6'][:greatest(6 - (page_id % 9)::int, 0)] || ['go', page_id::varchar], '/') as link from pages",
    "prohibited_keys": "select event_id, event_id % 4 < 2 as is_prohibited from events",
    "bucket_commits": "select o_orderkey, o_totalprice, case when o_orderkey % 1000 = 3 then 2 else 1 end as version from orders where o_orderkey % 1000 <> 5",
    "alias_index": "select page_id, 0 as position, min(page_id) over (partition by url) as first_page, true as found from pages union all select page_id, 1, null, false from pages",
    "enrichment_loop": "select page_id::varchar as canonical_id, case when page_id % 6 = 0 then 'failed' else 'partial' end as status, case when page_id % 3 = 0 then 2 else 1 end as attempt_count, 't1' as first_scanned, case when page_id % 3 = 0 then 't2' else 't1' end as last_scanned, floor(page_id / 5)::bigint + 1 as issue_number, (floor(page_id / 5)::bigint + 1) % 7 = 0 as update_pending, 1::bigint as questions from pages",
}

"""What is known of application forms: a ladder of schema, static page, one linked page and rendered page.

Every rung is a table of what was fetched, keyed by entry; an entry is told by the first rung that settles it. All
rungs are joined by key and judged by one expression, so an entry with a broken page stops no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.functions import values as V
from tidemark.sources import links

# Answers that settle an entry, and the reasons given.
REFUSED, GONE = [401, 403, 404, 410], [404, 410]
UNSAFE = "Application URL is not a safe public HTTP(S) URL."
UNSAFE_REDIRECT = "Application redirect did not lead to a safe public HTTP(S) URL."
CLOSED = "Application appears to be closed or unavailable."
DENIED = "Public application page requires authentication or denies access."
COMPLETE = "Greenhouse public structured application schema was retrieved."
FAILED = "Application inspection failed."
CLOSED_SCHEMA = "Application appears to be closed or unavailable."
NO_ACCESS = "Public Greenhouse application data is not accessible."
FAILED_SCHEMA = "Greenhouse form inspection failed."
NO_FIELDS = "Greenhouse returned no recognizable public form fields; completeness cannot be confirmed."
DYNAMIC = ["ashby", "lever", "workday"]


def signals(html: Column) -> Column:
    """`struct(captcha, login, closed, multi_step)` from the page's own text, markup included."""
    page = F.lower(F.regexp_replace(html, r"(?U)\s+", " "))
    many = lambda t: text.has_any(t, ["step 1", "step 2", "multi-step", "multistep"]) | (t.contains("of 2") & t.contains("step"))
    return text.let(page, lambda t: F.struct(text.has_any(t, V.CAPTCHA).alias("captcha"), text.has_any(t, V.LOGIN).alias("login"), text.has_any(t, V.CLOSED).alias("closed"), many(t).alias("multi_step")))


def page_verdict(found: Column, n_questions: Column) -> Column:
    """`struct(status, reason, blocking)`: what stands in the way comes before what was found."""
    some = n_questions > 0
    key = F.when(found["closed"], "closed").when(found["captcha"], "captcha").when(found["login"] & some, "login_fields").when(found["login"], "login").when(some & found["multi_step"], "steps").when(some, "fields").otherwise("none")
    reasons = F.create_map(*(F.lit(x) for kv in V.REASONS.items() for x in kv))
    partial = key.isin("login_fields", "steps", "fields")
    return F.struct(F.when(partial, "partial").otherwise("unavailable").alias("status"), F.element_at(reasons, key).alias("reason"), key.isin("closed", "captcha", "login").alias("blocking"))


def _told(status: str, reason: str, rung: str, n: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(rung).alias("rung"), (F.lit(0) if n is None else n).cast("int").alias("questions"))


def _of_page(rung: str) -> Column:
    return F.struct(F.col(f"{rung}_v.status").alias("status"), F.col(f"{rung}_v.reason").alias("reason"), F.lit(rung).alias("rung"), F.col(f"{rung}_n").cast("int").alias("questions"))


def _rung(pages: DataFrame, name: str) -> DataFrame:
    """Pages `(canonical_id, http_status, final_url, html, n_questions, error)` under the rung's name."""
    judged = pages.withColumn("v", page_verdict(signals(F.coalesce("html", F.lit(""))), F.coalesce("n_questions", F.lit(0))))
    return judged.select("canonical_id", F.lit(True).alias(f"{name}_there"), *(F.col(c).alias(f"{name}_{c}") for c in ("http_status", "final_url", "error", "v")), F.coalesce("n_questions", F.lit(0)).alias(f"{name}_n"))


def schema_verdict(schemas: DataFrame) -> DataFrame:
    """`(canonical_id, status, reason, error_message)` of structured forms `(canonical_id, http_status, n_questions, error)` on their own.

    Only a schema with questions is complete; one without any is partial, as nothing shows that it has none.
    """
    refused, gone = F.coalesce(F.col("http_status").isin(REFUSED), F.lit(False)), F.coalesce(F.col("http_status").isin(GONE), F.lit(False))
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    verdict = F.when(gone, told("unavailable", CLOSED_SCHEMA)).when(refused, told("unavailable", NO_ACCESS)).when(F.col("error").isNotNull(), told("failed", FAILED_SCHEMA)).when(F.col("n_questions") > 0, told("complete", COMPLETE)).otherwise(told("partial", NO_FIELDS))
    return schemas.select("canonical_id", verdict.alias("v"), text.safe_message(F.col("error")).alias("error_message")).select("canonical_id", "v.*", "error_message")


def inspect(targets: DataFrame, schemas: DataFrame, static: DataFrame, linked: DataFrame, rendered: DataFrame) -> DataFrame:
    """`(canonical_id, provider, status, reason, rung, questions, error_message)` of `targets(canonical_id, application_url)`.

    schemas: `(canonical_id, http_status, n_questions, error)` of structured forms; the others are pages.
    """
    own = schemas.select("canonical_id", F.lit(True).alias("schema_there"), F.col("http_status").alias("schema_status"), F.coalesce("n_questions", F.lit(0)).alias("schema_n"))
    known = targets.join(own, "canonical_id", "left")
    for name, pages in (("static", static), ("linked", linked), ("rendered", rendered)):
        known = known.join(_rung(pages, name), "canonical_id", "left")
    first = urls.provider(F.col("application_url"))
    provider = F.when(first == "generic", F.coalesce(urls.provider(F.col("static_final_url")), first)).otherwise(first)
    known = known.withColumn("provider", provider)
    there = lambda name: F.coalesce(F.col(f"{name}_there"), F.lit(False))
    usable = lambda name: there(name) & (F.col(f"{name}_n") > 0)
    refused = F.coalesce(F.col("static_http_status").isin(REFUSED), F.lit(False))
    verdict = (
        F.when(~urls.safe_public(F.col("application_url")), _told("unavailable", UNSAFE, "none"))
        .when(there("schema") & (F.col("schema_n") > 0), _told("complete", COMPLETE, "schema", F.col("schema_n")))
        .when(there("schema") & F.col("schema_status").isin(GONE), _told("unavailable", CLOSED, "schema"))
        .when(there("schema") & F.col("schema_status").isin(REFUSED), _told("unavailable", DENIED, "schema"))
        .when(there("static") & refused & F.col("static_http_status").isin(GONE), _told("unavailable", CLOSED, "static"))
        .when(there("static") & refused, _told("unavailable", DENIED, "static"))
        .when(~there("static") | F.col("static_error").isNotNull(), _told("failed", FAILED, "static"))
        .when(~urls.safe_public(F.col("static_final_url")), _told("unavailable", UNSAFE_REDIRECT, "static"))
        .when(F.col("static_v.blocking"), _of_page("static"))
        .when(usable("static") & ~F.col("provider").isin(DYNAMIC), _of_page("static"))
        .when(there("linked") & (F.col("linked_v.blocking") | (F.col("linked_n") > 0)), _of_page("linked"))
        .when(usable("rendered") | (there("rendered") & ~usable("static")), _of_page("rendered"))
        .otherwise(_of_page("static"))
    )
    found = known.select("canonical_id", "provider", verdict.alias("r"), "static_error").select("canonical_id", "provider", "r.*", "static_error")
    message = F.when(F.col("status") == "failed", text.safe_message(F.coalesce("static_error", F.lit("page was not fetched"))))
    return found.withColumn("error_message", message).drop("static_error")


def anchors(html: Column) -> Column:
    """The anchors of a page, tags included, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)


def href(anchor: Column) -> Column:
    """The link of an anchor's first tag; empty if it has none."""
    return text.unescape(F.regexp_extract(anchor, r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']+)", 1))


def _resolved(parts: Column) -> Column:
    """A path from the root of its parts, without dot segments: one fold, however many steps up there are."""

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    dots = F.element_at(parts, -1).isin(".", "..")  # then the path is that of a folder
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda kept: F.concat(F.lit("/"), F.array_join(F.when(dots, F.array_append(kept, F.lit(""))).otherwise(kept), "/")))


def absolute(link: Column, base_url: Column) -> Column:
    """A link as seen from a page: absolute ones stay; others are a path of the host, a query, or beside the page."""
    scheme, root = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    page = F.regexp_extract(base_url, r"^([^?#]*)", 1)
    whole = F.regexp_extract(base_url, "^([^#]*)", 1)
    own = F.substr(page, F.length(root) + 1)
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.substr(link, F.length(path) + 1)
    parts = F.split(F.concat(F.regexp_extract(own, "^(.*/)", 1), path), "/")
    beside = F.filter(parts, lambda x, i: (x != "") | (i == F.size(parts) - 1))  # but for the last one, empty parts go
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link == "", base_url)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(whole, link))
        .when(link.startswith("/"), F.concat(root, _resolved(F.split(F.substr(path, F.lit(2)), "/")), rest))
        .otherwise(F.concat(root, _resolved(beside), rest))
    )


def apply_link(html: Column, base_url: Column) -> Column:
    """The first anchor whose text speaks of applying and that leads, safely, to the same host or a known board.

    Links are seen from the page; anchors that are hidden, or in something hidden, don't count.
    """
    says = lambda a: ~a["hidden"] & text.has_any(F.lower(a["text"]), ["apply", "application"]) & (F.coalesce(a["href"], F.lit("")) != "")

    def allowed(link: Column) -> Column:
        board = urls.host(link)
        known = urls.ends_with_any(board, [f".{d}" for d in V.PROVIDER_HOSTS.values()])
        return urls.safe_public(link) & ((board == urls.host(base_url)) | known)

    seen = F.transform(F.filter(links.anchors(html), says), lambda a: absolute(a["href"], base_url))
    return F.try_element_at(F.filter(seen, allowed), F.lit(1))

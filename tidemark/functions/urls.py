"""Link functions as native column expressions: normal form, identity, provider, safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .text import let

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"


def _authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), "^.*@", "")


def host(url: Column) -> Column:
    """The host in lower case, without user, port and brackets; empty for what isn't an absolute link."""
    return F.lower(F.translate(F.regexp_replace(_authority(F.trim(url)), r":[0-9]*$", ""), "[]", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def ends_with_any(text: Column, ends: list[str]) -> Column:
    return reduce(lambda x, y: x | y, (text.endswith(e) for e in ends))


def in_domain(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith(f".{domain}")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """With `~` as it is and `*` encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query_pairs(clean: Column) -> Column:
    """Decoded keys and values of a trimmed link's query."""
    query = F.regexp_extract(clean, r"^[^?#]*\?([^#]*)", 1)
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(value(p)).alias("v")))


def _parts_of(clean: Column) -> Column:
    """A trimmed link taken apart: scheme, host, port, way, pairs of the query, and whether it is a board's."""
    return F.struct(
        clean.alias("clean"),
        F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"),
        host(clean).alias("host"),
        F.regexp_extract(_authority(clean), r":0*([1-9][0-9]*)$", 1).alias("port"),
        F.regexp_replace(path(clean), "/{2,}", "/").alias("way"),
        _query_pairs(clean).alias("pairs"),
        let(host(clean), lambda name: ends_with_any(name, V.PRESENTATION_HOSTS)).alias("board"),
    )


def _joined(link: Column | dict[str, Column], remove_provider_tracking: bool) -> Column:
    """The link put together again; `link` has the fields of `_parts_of`."""
    on_board = link["board"]

    def kept(key: Column) -> Column:
        gone = key.startswith("utm_") | key.isin(V.ALWAYS_TRACKING) | (on_board & key.isin(V.PRESENTATION))
        if remove_provider_tracking:
            gone = gone | key.isin(*V.TRACKING, "embed")
        return ~gone

    pairs = F.array_sort(F.filter(link["pairs"], lambda p: let(F.lower(p["k"]), kept)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    port = F.when(link["port"] == "", "").when(link["port"].try_cast("int") <= 65535, F.concat(F.lit(":"), link["port"]))
    way = F.when(link["way"].isin("", "/"), "/").otherwise(F.regexp_replace(link["way"], "/+$", ""))
    whole = F.concat(link["scheme"], F.lit("://"), link["host"], port, way, F.coalesce(F.concat(F.lit("?"), F.nullif(query, F.lit(""))), F.lit("")))
    return F.when(link["clean"].rlike(_ABSOLUTE), whole).otherwise(link["clean"])


def normalized(url: Column, remove_provider_tracking: bool = False) -> Column:
    """Lower-case scheme and host, clean path, query sorted and without tracking, no user and fragment.

    What isn't an absolute link stays as it is, trimmed; a port beyond 65535 gives null.
    """
    return let(_parts_of(F.trim(url)), lambda link: _joined(link, remove_provider_tracking))


def _known_id(link: Column | dict[str, Column]) -> Column:
    """The id that a board's link carries, from `struct(name, parts, n, jobs)`; null for other links."""
    name, parts, n, jobs = (link[c] for c in ("name", "parts", "n", "jobs"))
    part = lambda i: F.try_element_at(parts, F.lit(i))
    before, after = F.try_element_at(parts, F.when(jobs > 1, jobs - 1)), F.try_element_at(parts, F.when(jobs > 0, jobs + 1))
    opening = (jobs > 1) & (jobs < n)
    after_job = F.exists(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p: F.lower(p) == "job") & (F.lower(part(-1)) != "job")
    number = F.try_element_at(F.filter(parts, lambda p: p.rlike("^[0-9]{5,}$")), F.lit(-1))

    def named(provider: str, *items: Column) -> Column:
        return F.concat(F.lit(f"{provider}:"), F.lower(F.concat_ws(":", *items)))

    return (
        F.when(name.endswith("ashbyhq.com") & (n >= 2) & ~part(2).isin("application", "embed"), named("ashby", part(1), part(2)))
        .when(name.endswith("greenhouse.io") & opening, named("greenhouse", before, after))
        .when(name.endswith("lever.co") & (n >= 2), named("lever", part(1), part(2)))
        .when(name.contains("myworkdayjobs.com") & after_job & (F.length(part(-1)) >= 5) & part(-1).rlike("[0-9]"), named("workday", name, part(-1)))
        .when((name == "ats.rippling.com") & opening, named("rippling", before, after))
        .when(ends_with_any(name, ["lifeattiktok.com", "jobs.bytedance.com"]) & number.isNotNull(), named("tiktok", name, number))
        .when(name.endswith("amazon.jobs") & (jobs > 0) & (jobs < n), named("amazon", after))
    )


def identity(url: Column) -> Column:
    """`struct(canonical_id, canonical_url, direct, stable)` of an application link."""

    def facts(plain: Column, bare: Column) -> Column:
        parts = path_parts(plain)
        return let(parts, lambda p: F.struct(plain.alias("plain"), bare.alias("bare"), host(plain).alias("name"), p.alias("parts"), F.size(p).alias("n"), F.array_position(p, F.lit("jobs")).cast("int").alias("jobs")))

    def told(link: Column, known: Column) -> Column:
        wrapper = reduce(lambda x, y: x | y, (in_domain(link["name"], d) for d in V.AGGREGATORS))
        stable = known.isNotNull()
        return F.struct(
            F.coalesce(known, F.concat(F.lit("url:"), link["plain"])).alias("canonical_id"),
            F.when(stable, link["bare"]).otherwise(link["plain"]).alias("canonical_url"),
            (stable | ((link["name"] != "") & ~wrapper)).alias("direct"),
            stable.alias("stable"),
        )

    def both(link: Column) -> Column:
        return let(F.struct(_joined(link, False).alias("plain"), _joined(link, True).alias("bare")), lambda x: let(facts(x["plain"], x["bare"]), lambda f: let(_known_id(f), lambda known: told(f, known))))

    return let(_parts_of(F.trim(url)), both)


def with_identity(df: DataFrame, url: str) -> DataFrame:
    """`df` with the fields of `identity` as columns, built up in steps that generated code runs; for large tables."""
    steps = df.withColumn("_clean", F.trim(url)).withColumns(
        {
            "_absolute": F.col("_clean").rlike(_ABSOLUTE),
            "_scheme": F.lower(F.regexp_extract("_clean", r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)),
            "_host": host(F.col("_clean")),
            "_port": F.regexp_extract(_authority(F.col("_clean")), r":0*([1-9][0-9]*)$", 1),
            "_way": F.regexp_replace(path(F.col("_clean")), "/{2,}", "/"),
            "_pairs": _query_pairs(F.col("_clean")),
        }
    )
    steps = steps.withColumn("_board", ends_with_any(F.col("_host"), V.PRESENTATION_HOSTS))
    link = {c: F.col(f"_{c}") for c in ("clean", "scheme", "host", "port", "way", "pairs", "board")}
    steps = steps.withColumns({"_plain": _joined(link, False), "_bare": _joined(link, True), "_name": F.when(F.col("_absolute"), F.col("_host")).otherwise(""), "_parts": F.when(F.col("_absolute"), F.filter(F.split("_way", "/"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))})
    steps = steps.withColumns({"_n": F.size("_parts"), "_jobs": F.array_position("_parts", F.lit("jobs")).cast("int")})
    steps = steps.withColumn("_known", _known_id({c: F.col(f"_{c}") for c in ("name", "parts", "n", "jobs")}))
    wrapper = reduce(lambda x, y: x | y, (in_domain(F.col("_name"), d) for d in V.AGGREGATORS))
    stable = F.col("_known").isNotNull()
    out = steps.withColumns(
        {
            "canonical_id": F.coalesce("_known", F.concat(F.lit("url:"), "_plain")),
            "canonical_url": F.when(stable, F.col("_bare")).otherwise(F.col("_plain")),
            "direct": stable | ((F.col("_name") != "") & ~wrapper),
            "stable": stable,
        }
    )
    return out.select(*df.columns, "canonical_id", "canonical_url", "direct", "stable")


def provider(url: Column) -> Column:
    """The application board that a link's host belongs to, else `generic`."""

    def named(name: Column) -> Column:
        out = F.lit("generic")
        for kind, domain in reversed(V.PROVIDER_HOSTS.items()):
            out = F.when(in_domain(name, domain), kind).otherwise(out)
        return out

    return let(F.regexp_replace(host(url), r"\.+$", ""), named)


# IPv4 networks that aren't public (IANA special purpose and reserved), as first address and bits.
_PRIVATE = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def _address(text: str) -> int:
    return int.from_bytes(bytes(map(int, text.split("."))), "big")


def safe_public(url: Column) -> Column:
    """Whether a link leads to a public web address, judged without looking names up.

    Addresses of IPv6 are let through only in the global unicast block 2000::/3 outside 2001:db8::/32.
    """
    web = F.lower(F.trim(url)).rlike("^https?://")
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

    def public_number(number: Column) -> Column:
        return ~reduce(lambda x, y: x | y, ((number >= _address(a)) & (number < _address(a) + (1 << (32 - bits))) for a, bits in _PRIVATE))

    def public(name: Column) -> Column:
        octets = F.transform(F.split(name, r"\."), lambda x: x.try_cast("long"))
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        six = name.rlike("^[23][0-9a-f]{3}:") & ~name.rlike("^2001:0?db8:")
        local = (name == "") | (name == "localhost") | name.endswith(".localhost")
        four = name.rlike(rf"^{byte}(\.{byte}){{3}}$")
        return ~local & F.when(four, let(number, public_number)).when(name.contains(":"), six).otherwise(True)

    return F.coalesce(web & let(F.regexp_replace(host(url), r"\.+$", ""), public), F.lit(False))


def aggregator_job_id(url: Column) -> Column:
    """The last part of the path behind a part `p`."""
    parts = path_parts(url)
    return F.when(F.try_element_at(parts, F.lit(-2)) == "p", F.try_element_at(parts, F.lit(-1)))


def board_reference(url: Column) -> Column:
    """`struct(board, job)` of a structured board's link: embedded (`for`, `token`) or .../{board}/jobs/{id}."""
    parts, query = path_parts(url), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    at = F.array_position(parts, F.lit("jobs")).cast("int")
    param = lambda k: F.nullif(F.regexp_extract(query, f"(?:^|&){k}=([^&]*)", 1), F.lit(""))
    board = F.coalesce(param("for"), F.try_element_at(parts, F.when(at > 1, at - 1)))
    job = F.coalesce(param("token"), F.try_element_at(parts, F.when(at > 1, at + 1)))
    return F.when(in_domain(host(url), "greenhouse.io") & board.isNotNull() & job.isNotNull(), F.struct(board.alias("board"), job.alias("job")))


def target_id(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))

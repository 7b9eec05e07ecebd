"""Text functions as native column expressions."""

from __future__ import annotations

import html.entities
import json
import unicodedata
import zlib
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import values as V

def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once, however often `then` names it: plans stay small."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Code points that `fold` maps natively: Latin blocks, combining marks, ligatures and full-width forms.
_BLOCKS = [(0x80, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]


def fold_text(text: str) -> str:
    """What `fold` computes, for any code point: the definition, and its check."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())


@cache
def _tables() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Characters to swap one for one, what for, characters to drop, and those that become several."""
    single, gone, several = {}, [], []
    for c in (chr(i) for low, high in _BLOCKS for i in range(low, high)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            single[c] = plain
        else:
            several.append((c, plain))
    return "".join(single), "".join(single.values()), "".join(gone), several


def fold(text: Column) -> Column:
    """Accents dropped, case folded, all but a-z and 0-9 as single spaces, trimmed."""
    source, target, gone, several = _tables()
    plain = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), several, text)
    out = F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(plain, source + gone, target)).otherwise(text))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def contains_phrase(folded: Column, phrase: str) -> Column:
    """Whether whole words of a folded text are the phrase."""
    return F.concat(F.lit(" "), folded, F.lit(" ")).contains(f" {phrase} ")


def location_pattern() -> str:
    """A place of the scope, perhaps one qualifier, and a spelling of the state."""
    return f"(^| )({'|'.join(V.PLACES)})( ({'|'.join(V.QUALIFIERS)}))? ({'|'.join(V.STATE_SPELLINGS)})( |$)"


def location_matches(location: Column) -> Column:
    """Whether a location is in scope: a named region without another state, or a place with the state."""

    def judged(text: Column) -> Column:
        found = text.rlike(location_pattern())
        for region in V.REGIONS:
            elsewhere = text.rlike(f"(^| ){region} ({'|'.join(V.OTHER_STATES)})( |$)")
            found = found | (contains_phrase(text, region) & ~elsewhere)
        return found

    return F.coalesce(let(fold(location), judged), F.lit(False))


def fingerprint(company: Column, position: Column, job_type: Column, location: Column, season: Column) -> Column:
    """The exact fallback key: SHA-256 of the folded fields."""
    parts = [fold(F.coalesce(x, F.lit(""))) for x in (company, position, job_type, location, season)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def nonempty(text: Column) -> Column:
    """Trimmed, and null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


#: White space that is stripped from the ends of cells.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


#: A character reference, or what stands between references.
_REFERENCE = r"(?s)(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)"
_NAME_TABLES = 64


@cache
def _names() -> tuple[str, str]:
    """HTML's names of characters in small tables by a hash of the name, as one text; and a pattern of those that need no semicolon, the longest first."""
    tables = ["\0"] * _NAME_TABLES
    for name, character in html.entities.html5.items():
        tables[zlib.crc32(name.encode()) % _NAME_TABLES] += f"{name}\1{character}\0"
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "\2".join(tables), f"^({'|'.join(bare)})"


def _named(name: Column) -> Column:
    """The one or two characters that a name stands for, or null."""
    own = F.get(F.split(F.lit(_names()[0]), "\2"), F.pmod(F.crc32(name.cast("binary")), F.lit(_NAME_TABLES)).cast("int"))

    def found(t: Column) -> Column:
        at = F.instr(t, F.concat(F.lit("\0"), name, F.lit("\1")))
        return F.when(at > 0, F.substring_index(F.substring(t, at + F.length(name) + 2, F.lit(3)), "\0", 1))

    return let(own, found)


def _numbered(number: Column) -> Column:
    """The character of a number, a replacement for what is none, nothing for what mustn't be."""

    def character(n: Column) -> Column:
        windows = "".join(chr(k) if (c := bytes([k]).decode("cp1252", "replace")) == "\ufffd" else c for k in range(0x80, 0xA0))  # what HTML reads them as
        low = F.substr(F.lit(windows), n.cast("int") - 0x7F, F.lit(1))
        none = n.between(1, 8) | n.between(0x0E, 0x1F) | (n == 0x0B) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE) & (n > 0xFFFD))
        return (
            F.when(n.between(0x80, 0x9F), low)
            .when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return let(number, character)


def unescape(text: Column) -> Column:
    """HTML character references, named and numeric, as characters; each is read once, so `&amp;lt;` is `&lt;`."""

    def digits(name: Column) -> Column:
        short = F.regexp_replace(name, "^#[xX]?0*|;$", "")
        number = F.coalesce(F.when(name.rlike("^#[xX]"), F.conv(short, 16, 10)).otherwise(short).try_cast("long"), F.lit(0))
        return _numbered(F.when(F.length(short) > 7, F.lit(1 << 24)).otherwise(number))

    def named(token: Column, name: Column) -> Column:
        """The whole name, or else the longest beginning that is one and needs no semicolon."""
        prefix = F.regexp_extract(name, _names()[1], 1)
        known = F.transform(F.array(name, prefix), _named)
        return let(known, lambda k: F.coalesce(F.get(k, F.lit(0)), F.concat(F.get(k, F.lit(1)), F.substr(name, F.length(prefix) + 1)), token))

    def one(token: Column) -> Column:
        short = F.length(token) == 1
        return F.when(~token.startswith("&") | short, token).otherwise(let(F.substr(token, F.lit(2)), lambda name: F.when(name.startswith("#"), digits(name)).otherwise(named(token, name))))

    whole = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), 1), one), "")
    return let(text, lambda t: F.when(t.contains("&"), whole(t)).otherwise(t))


def clean_cell(text: Column) -> Column:
    """A Markdown cell as plain text: no tags, links as their text, no emphasis, single spaces."""
    out = unescape(F.regexp_replace(text, "<[^>]*>", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[*_`]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def label(text: Column) -> Column:
    """A form label: no tags, single spaces, neither a trailing mark of required fields nor colons."""
    out = unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "))
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    marked = lambda t: F.when(t.endswith("*"), F.trim(F.regexp_replace(t, r"(?i)(?:\s|\*)+(?:required)?\s*\*+\s*$", ""))).otherwise(t)  # noqa: E731  fixed: the mark's pattern
    return let(let(out, marked), lambda t: F.when(t.endswith(":"), F.trim(F.regexp_replace(t, ":+$", ""))).otherwise(t))


def field_type(kind: Column, multiple: Column | None = None) -> Column:
    """A form field's type in the common vocabulary."""
    raw = F.replace(F.replace(F.trim(F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    known = F.create_map(*(F.lit(x) for kv in V.FIELD_TYPES.items() for x in kv))
    out = F.coalesce(F.try_element_at(known, raw), F.lit("unknown"))
    if multiple is not None:
        out = F.when(multiple & out.isin("single_select", "checkbox"), "multi_select").otherwise(out)
    return out


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms is in the text, anywhere."""
    return reduce(lambda x, y: x | y, (text.contains(t) for t in terms))


def question_category(question: Column, section: Column) -> Column:
    """`category_of` a label as it is written."""
    return category_of(label(question), section)


def category_of(clean: Column, section: Column) -> Column:
    """The first category with a term in a label (as of `label`); demographic terms count in the section too."""
    part = F.lower(F.coalesce(section, F.lit("")))

    def judged(text: Column) -> Column:
        out = F.when(has_any(F.concat(part, F.lit(" "), text), V.DEMOGRAPHIC), "compliance_demographic")
        out = out.when(has_any(text, V.AUTHORIZATION), "work_authorization").when(part.contains("compliance"), "compliance_demographic")
        for name, terms in V.LATER_CATEGORIES.items():
            own = has_any(text, terms)
            out = out.when((text == "name") | own if name == "profile" else own, name)
        return out.otherwise("other")

    return let(F.lower(clean), judged)


def is_custom_question(question: Column, category: Column) -> Column:
    """`custom_of` a label as it is written."""
    return custom_of(label(question), category)


def custom_of(clean: Column, category: Column) -> Column:
    """Whether a label (as of `label`) asks something of its own: by its category, or as a question or a sentence."""

    def prompt(text: Column) -> Column:
        return text.contains("?") | (F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) >= 5)

    return (category == "job_specific") | ((category == "other") & let(clean, prompt))


def markdown_cell(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))


def escape_text(text: Column) -> Column:
    """Text that Markdown shows as it is."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in "*[]":
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit("\n"), F.lit(" "))


def human_name(name: Column) -> Column:
    text = F.trim(F.translate(F.coalesce(name, F.lit("")), "_-", "  "))
    shown = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    return F.when(F.lower(text).isin("field", "input", "form", "value", "question"), "").otherwise(shown)


def safe_message(text: Column) -> Column:
    """A diagnostic without links and secrets, 500 characters at most."""
    out = F.regexp_replace(text, r"(?i)https?://[^\s'\"<>]+", "<url>")
    secret = r"(?i)\b(cookie|csrf(?:[_ -]?token)?|(?:access|auth|refresh|session|id)?[_ -]?token|authorization)\s*[=:]\s*[^\s,;]+"
    return F.left(F.regexp_replace(out, secret, "$1=<redacted>"), F.lit(500))


def counts_locations(location: Column) -> Column:
    """Whether a location only says how many there are (`5 locations`)."""
    return F.coalesce(location.rlike(r"(?i)^\d+\s+locations\b"), F.lit(False))


def key_name(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def alert_title(count: Column) -> Column:
    return F.when(count == 1, "1 new entry").otherwise(F.concat(count.cast("string"), F.lit(" new entries")))


def lenient_boolean(text: Column) -> Column:
    """true, 1, yes; false, 0, no; else null."""
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def carry_forward(value: str, group: str, order: str) -> Column:
    """The last value that isn't null, up to and with this row of its group."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

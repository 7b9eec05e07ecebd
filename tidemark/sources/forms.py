"""Form questions of pages: controls by one UDTF, naming and classes native; and of structured schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.functions import text

# Elements without content, inputs that aren't questions, options that aren't answers.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IGNORED = {"button", "hidden", "image", "reset", "submit"}
PLACEHOLDERS = {"", "select", "select...", "select an option", "choose", "choose...", "--"}
GROUPS = ["questions", "location_questions", "compliance", "compliance_questions", "demographic_questions", "demographics"]


def is_hidden(given: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    style = given.get("style", "").replace(" ", "").lower()
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class _Controls(HTMLParser):
    """One pass over a page. Open elements are frames on a stack; what closes hands its text to who waits for it."""

    def __init__(self):
        super().__init__()
        self.stack, self.controls, self.by_id, self.by_for, self.has_form, self.serial = [], [], {}, {}, False, 0

    def handle_starttag(self, tag, attrs):
        given = {k: v if v is not None else "" for k, v in attrs}
        hidden = is_hidden(given)
        self.serial += 1
        frame = {"tag": tag, "given": given, "n": self.serial, "text": [], "bare": [], "hidden": hidden or bool(self.stack and self.stack[-1]["hidden"])}
        self.has_form |= tag == "form" or given.get("role", "").lower() == "form"
        kind = given.get("type", "text").lower() if tag == "input" else tag
        if tag in ("input", "textarea", "select") and not frame["hidden"] and not (tag == "input" and kind in IGNORED):
            above = lambda t: next((f for f in reversed(self.stack) if f["tag"] == t), None)
            frame["control"] = {"kind": kind, "given": given, "form": above("form"), "set": above("fieldset"), "label": above("label"), "options": []}
            self.controls.append(frame["control"])
        if tag == "option":
            frame["owner"] = next((f.get("control") for f in reversed(self.stack) if f["tag"] == "select"), None)
        if given.get("id"):
            self.by_id.setdefault(given["id"], frame)
        if tag in VOID:
            return
        self.stack.append(frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(f["tag"] == tag for f in self.stack):
            while self.stack:
                frame = self.stack.pop()
                self._closed(frame)
                if frame["tag"] == tag:
                    return

    def handle_data(self, data):
        inside = False
        for frame in reversed(self.stack):
            inside |= frame["tag"] in ("textarea", "select")
            frame["text"].append(data)
            if not inside:
                frame["bare"].append(data)

    def _closed(self, frame):
        tag, given = frame["tag"], frame["given"]
        shown = " ".join(" ".join(frame["bare"] if tag == "label" else frame["text"]).split())
        if tag == "label" and given.get("for") and shown:
            self.by_for[given["for"]] = f"{self.by_for.get(given['for'], '')} {shown}".strip()
        elif tag == "legend" and shown and self.stack and self.stack[-1]["tag"] == "fieldset":
            self.stack[-1].setdefault("legend", shown)
        elif tag == "option" and frame.get("owner") is not None and "disabled" not in given:
            value = shown or given.get("label", "")
            if value.lower() not in PLACEHOLDERS:
                frame["owner"]["options"].append(value)

    def close(self):
        super().close()
        while self.stack:
            self._closed(self.stack.pop())

    def rows(self):
        controls = [c for c in self.controls if c["form"] is not None] if self.has_form else self.controls
        for i, c in enumerate(controls, start=1):
            given = c["given"]
            legend = (c["set"] or {}).get("legend")
            by_ids = " ".join(" ".join(" ".join(self.by_id[x]["text"]).split()) for x in given.get("aria-labelledby", "").split() if x in self.by_id)
            wrapping = " ".join(" ".join(c["label"]["bare"]).split()) if c["label"] else ""
            said = given.get("aria-required", "").lower()
            required = True if said in ("true", "1") or "required" in given else False if said in ("false", "0") else None
            named = [self.by_for.get(given.get("id", "")), wrapping, by_ids, given.get("aria-label"), legend, given.get("placeholder")]
            yield i, c["kind"], given.get("name"), next((x for x in named if x), None), legend, required, c["options"], "multiple" in given, (c["form"] or {"n": 0})["n"], self.has_form


@udtf(returnType="ordinal int, kind string, name string, label string, legend string, required boolean, options array<string>, multiple boolean, form int, has_form boolean")
class FormControls:
    def eval(self, html: str):
        page = _Controls()
        page.feed(html or "")
        page.close()
        yield from page.rows()


def controls(pages: DataFrame) -> DataFrame:
    """One row for each visible control of `(page_id, html)`."""
    spark = pages.sparkSession
    spark.udtf.register("form_controls", FormControls)
    return spark.sql("select p.page_id, c.* from {pages} p, lateral form_controls(p.html) c", pages=pages)


def distinct_options(options):
    """In order, the first of each regardless of case."""
    clean = F.filter(F.transform(options, text.label), lambda x: x != "")
    first = lambda each: F.filter(each["clean"], lambda x, i: F.array_position(each["low"], F.lower(x)) == i + 1)
    return text.let(text.let(clean, lambda c: F.struct(c.alias("clean"), F.transform(c, F.lower).alias("low"))), first)


def any_required(required) -> Column:
    """Of a group of controls: true if one is required, false if one says that it isn't and none is, else unknown."""
    return F.bool_or(required)


def _classified(found: DataFrame) -> DataFrame:
    """Labels, categories and the first of repeated questions."""
    named = found.withColumns({"label": text.label(F.col("label")), "section": F.nullif(text.label(F.col("section")), F.lit("")), "options": distinct_options(F.col("options"))}).where("label <> ''")
    named = named.withColumn("category", text.question_category(F.col("label"), F.col("section")))
    named = named.withColumns({"is_custom": text.is_custom_question(F.col("label"), F.col("category")), "field_type": text.field_type(F.col("kind"), F.col("multiple"))})
    w = Window.partitionBy("page_id", F.lower("label"), "field_type", "section").orderBy("ordinal", F.lower("label"))
    kept = named.withColumn("place", F.row_number().over(w)).where("place = 1")
    return kept.select("page_id", "ordinal", "label", "field_type", "required", "options", "category", "section", "is_custom", "field_name")


def questions(pages: DataFrame) -> DataFrame:
    """Questions of pages; radio buttons and checkboxes of a name in a form are one.

    Any other control is a group of its own, by its ordinal, so pages are parsed once."""
    each = controls(pages).withColumn("shown", F.coalesce("label", text.human_name(F.col("name"))))
    grouped = F.col("kind").isin("radio", "checkbox") & (F.coalesce("name", F.lit("")) != "")
    each = each.withColumn("alone", F.when(~grouped, F.col("ordinal")))
    groups = each.groupBy("page_id", "form", "kind", "name", "alone").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("legend", "ordinal").alias("section"), F.min_by("shown", "ordinal").alias("first"), F.count("*").alias("n"),
        any_required("required").alias("required"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "shown"))), lambda x: x["shown"]).alias("answers"),
        F.min_by("options", "ordinal").alias("own"), F.bool_or("multiple").alias("several"),
    )
    single, select = F.col("alone").isNotNull(), F.col("kind") == "select"
    label = F.coalesce("section", F.when(F.col("n") > 1, text.human_name(F.col("name"))).otherwise(F.col("first")), text.human_name(F.col("name")))
    options = F.when(~single, F.col("answers")).when(select, F.col("own")).otherwise(F.array().cast("array<string>"))
    multiple = F.when(single, select & F.col("several")).otherwise((F.col("kind") == "checkbox") & (F.col("n") > 1))
    return _classified(groups.select("page_id", "ordinal", F.when(single, F.col("first")).otherwise(label).alias("label"), "kind", "required", options.alias("options"), "section", multiple.alias("multiple"), F.col("name").alias("field_name")))


_FIELD = "struct<name: string, type: string, values: array<string>, options: array<string>>"
_QUESTION = f"struct<label: string, question: string, required: string, type: string, name: string, values: array<string>, options: array<string>, fields: array<{_FIELD}>>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
#: Of a JSON text: strings, brackets and bare values, each with the key before it.
_TOKEN = re.compile(rf'(?:({_STRING})\s*:\s*)?({_STRING}|[][{{}}]|[^][{{}}",:\s]+)', re.DOTALL)
_GROUP_OF = {g: i for i, g in enumerate(GROUPS)}


def _plain(token: str) -> str:
    """A JSON string's text; half a surrogate pair is a question mark."""
    return json.loads(token).encode("utf-8", "replace").decode() if "\\" in token else token[1:-1]


def _truthy(token: str) -> bool:
    """Whether a bare JSON value is neither null, false, zero nor empty."""
    return token not in ('""', "null", "false") and (token[0] not in "-0123456789" or float(token) != 0)


def _label(members: dict[str, str | bool]) -> str | None:
    """An object's label, or else its question, if that is a string; whatever else it is counts as none."""
    told = members.get("label", False)
    chosen = told if (told if isinstance(told, bool) else _truthy(told)) else members.get("question")
    return _plain(chosen) if isinstance(chosen, str) and chosen[0] == '"' else None


def asked(payload: str) -> list[tuple[int, list[int], str, str]] | None:
    """The questions in the groups of a valid JSON text: `(group, path, json, label)`, None if a group is a bare value.

    A question is an object with a label that is a string, and fields, a type or whether it is required. What is in it
    isn't searched: it is taken back when the object around it ends. `path` has the place at each level, among lists
    and objects.
    """
    out, open_, top, group = [], [], None, None
    for m in _TOKEN.finditer(payload):
        key, token = m.groups()
        if key:
            key = _plain(key)
        if token in "{[":
            if len(open_) == 1:
                group = _GROUP_OF.get(key)
            # members, where it begins, questions before it, lists and objects in it, its own key
            top = [{} if token == "{" else None, m.start(2), len(out), 0, key]
            open_.append(top)
        elif token in "}]":
            members, start, before, _, own = open_.pop()
            if not open_:
                break
            top = open_[-1]
            if members and group is not None and ("type" in members or "fields" in members or "required" in members) and (label := _label(members)) is not None:
                out[before:] = [(group, [group, *[f[3] for f in open_[1:]]], payload[start : m.end()], label)]
            top[3] += 1
            if own in ("label", "question", "fields", "required", "type"):
                top[0][own] = payload[start + 1 : m.start()].strip(" \t\r\n") != ""
        elif top is None:
            break
        elif key is not None:
            if len(open_) == 1 and token != "null" and key in _GROUP_OF:
                return None
            top[0][key] = token
    return out


def walk(payloads: DataFrame) -> DataFrame:
    """`(page_id, path, section, json, label)` of all that is `asked` in `(page_id, payload)`; a payload with an invalid
    group has one row, whose path is null. Each text is read once, however deep it is."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, groups, paths, texts, labels = [], [], [], [], []
            for i, payload in enumerate(batch.column(1).to_pylist()):
                for group, path, text_, label in [(None, None, None, None)] if (found := asked(payload)) is None else found:
                    at.append(i)
                    groups.append(None if group is None else GROUPS[group])
                    paths.append(path)
                    texts.append(text_)
                    labels.append(label)
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(paths, pa.list_(pa.int32())), *(pa.array(c, pa.string()) for c in (groups, texts, labels))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "path", "section", "json", "label"])

    valid = payloads.where(F.try_parse_json("payload").isNotNull()).select("page_id", "payload")
    kind = payloads.schema["page_id"].dataType.simpleString()
    return valid.mapInArrow(run, f"page_id {kind}, path array<int>, section string, json string, label string")


def invalid_groups(payloads: DataFrame) -> DataFrame:
    """`(page_id, section)` of groups that are neither absent, null, a list nor an object: such a schema isn't complete."""
    parsed = payloads.select("page_id", F.try_parse_json("payload").alias("p"))
    kinds = F.array(*(F.struct(F.lit(g).alias("section"), _kind(F.try_variant_get("p", f"$.{g}", "variant")).alias("kind")) for g in GROUPS))
    bad = parsed.select("page_id", F.explode(kinds).alias("g")).select("page_id", "g.*")
    return bad.where("kind not in ('', 'VOID') and not startswith(kind, 'ARRAY') and not startswith(kind, 'OBJECT')").select("page_id", "section")


def schema_questions(payloads: DataFrame) -> DataFrame:
    """Questions of `(page_id, payload)`, a structured form schema as JSON; groups in order, hidden fields left out.

    Questions are found in lists and objects of a group, however deep; a question isn't searched for others. Pages with an
    invalid group (`invalid_groups`) have none. What a question says is read once, by `inline`, which no filter passes.
    """
    found = walk(payloads)
    rows = found.select("page_id", "path", "section", F.col("label").alias("own_label"), F.inline(F.array(F.from_json("json", _QUESTION)))).withColumn("label", F.col("own_label"))
    visible = F.filter(F.coalesce("fields", F.array().cast(f"array<{_FIELD}>")), lambda f: ~F.lower(F.coalesce(f["type"], F.lit(""))).isin("hidden", "input_hidden"))
    rows = rows.withColumn("visible", visible).where("path is null or (label <> '' and (fields is null or size(fields) = 0 or size(visible) > 0))")
    first, none = F.try_element_at("visible", F.lit(1)), F.array().cast("array<string>")
    own = F.coalesce("values", "options", none)
    told = F.when(F.size("visible") > 0, F.flatten(F.transform("visible", lambda f: F.coalesce(f["values"], f["options"], none)))).otherwise(own)
    shown = F.transform(told, lambda v: F.coalesce(F.get_json_object(v, "$.label"), F.get_json_object(v, "$.name"), F.get_json_object(v, "$.value"), F.when(~v.startswith("{"), v), F.lit("")))
    kind = F.coalesce(first["type"], "type", F.lit("unknown"))
    out = rows.select("page_id", "path", "label", kind.alias("kind"), text.lenient_boolean(F.col("required")).alias("required"), shown.alias("options"), "section", ((F.size("visible") > 1) & F.lower(kind).isin("checkbox", "select")).alias("multiple"), text.nonempty(F.coalesce(first["name"], "name")).alias("field_name"))
    page = Window.partitionBy("page_id").orderBy("path")
    numbered = out.withColumns({"ordinal": F.row_number().over(page), "unsound": F.bool_or(F.col("path").isNull()).over(page)}).where("not unsound").drop("path", "unsound")
    return _classified(numbered)


def ordered(questions: DataFrame) -> DataFrame:
    """`(page_id, questions)`: a page's questions as one array, in order of place, label and name."""
    rest = [c for c in questions.columns if c not in ("page_id", "ordinal")]
    key = F.struct("ordinal", F.lower("label").alias("low"), F.coalesce("field_name", F.lit("")).alias("name"), F.struct("ordinal", *rest).alias("q"))
    return questions.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["q"]).alias("questions"))

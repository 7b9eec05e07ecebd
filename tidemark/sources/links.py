"""Links of pages, by one pass of an HTML parser over each."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forms import VOID, is_hidden

_ANCHORS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("hidden", T.BooleanType())]))


class _Anchors(HTMLParser):
    """Open elements on a stack with whether they are hidden; what is hidden hides all that is in it."""

    def __init__(self):
        super().__init__()
        self.stack, self.open, self.found = [], [], []

    def handle_starttag(self, tag, attrs):
        given = {k: v if v is not None else "" for k, v in attrs}
        hidden = is_hidden(given) or bool(self.stack and self.stack[-1][1])
        if tag in VOID:
            return
        anchor = None
        if tag == "a":
            anchor = {"href": given.get("href"), "hidden": hidden, "text": []}
            self.found.append(anchor)
            self.open.append(anchor)
        self.stack.append((tag, hidden, anchor))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                closed, _, anchor = self.stack.pop()
                if anchor is not None:
                    self.open.remove(anchor)
                if closed == tag:
                    return

    def handle_data(self, data):
        for anchor in self.open:
            anchor["text"].append(data)


@F.arrow_udf(_ANCHORS)
def anchors(html: pa.Array) -> pa.Array:
    """The anchors of a page in order: href as it is written, with references read, and the text that is in it."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("hidden", pa.bool_())]))
    return pa.array([_anchors(text) for text in html.to_pylist()], kind)


def _anchors(html: str | None) -> list[dict]:
    page = _Anchors()
    page.feed(html or "")
    page.close()
    return [{"href": a["href"], "text": " ".join(" ".join(a["text"]).split()), "hidden": a["hidden"]} for a in page.found]

"""Feeds of an HTML table in a Markdown section: cells by a UDTF, everything after that native."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.functions import text, urls
from tidemark.functions import values as V

SECTION = r"(?ims)^##\s+[^\n]*Software Engineering Internship Roles[ \t]*$(.*?)(?=^##\s+|\z)"
HEADER = ["company", "role", "location", "application", "age"]
# Marks of continued companies, and of presentation.
CONTINUED, PRESENTATION, HOT = ["↳", "â†³"], "🔥🛂🇺🇸🎓🔒", "🔥"
OWN_HOST, SEASON = "simplify.jobs", "Summer 2027"


class _Cells(HTMLParser):
    """Collects (row, column, text, links) while tags pass by."""

    def __init__(self):
        super().__init__()
        self.found, self.row, self.column, self.texts, self.links, self.link, self.summaries = [], -1, -1, None, [], None, 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self._close()
            self.column, self.texts, self.links = self.column + 1, [], []
        elif self.texts is not None and tag == "br":
            self.texts.append("\n")
        elif self.texts is not None and tag == "summary":
            self.summaries += 1
        elif self.texts is not None and tag == "a":
            self.link = {"href": given.get("href") or "", "text": [], "alts": []}
            self.links.append(self.link)
        elif self.link is not None and tag == "img":
            self.link["alts"].append(given.get("alt") or "")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "a":
            self.link = None
        elif tag == "summary" and self.summaries:
            self.summaries -= 1

    def handle_data(self, data):
        if self.texts is not None:
            if not self.summaries:  # a summary only counts the places behind it
                self.texts.append(data)
            if self.link is not None:
                self.link["text"].append(data)

    def _close(self):
        if self.texts is not None:
            shown = " ".join("".join(self.texts).replace("\n", " | ").split())
            links = [(x["href"].strip(), "".join(x["text"]).strip(), [a.strip().lower() for a in x["alts"]]) for x in self.links if x["href"].strip()]
            self.found.append((self.row, self.column, shown, links))
        self.texts, self.link, self.summaries = None, None, 0


@udtf(returnType="row int, column int, cell string, links array<struct<href: string, text: string, alts: array<string>>>")
class TableCells:
    def eval(self, html: str):
        cells = _Cells()
        cells.feed(html or "")
        cells.close()
        cells._close()
        yield from cells.found


def _section():
    """The text behind the section's heading; null if there is none."""
    return F.when(F.col("body").rlike(SECTION), F.regexp_extract("body", SECTION, 1))


def diagnose(documents: DataFrame) -> DataFrame:
    """`(source_id, category, candidates, parsed, skipped, error)`: one row for each document; a table without valid rows has an error."""
    return _told(_valued(_rows(documents)), documents)


def both(documents: DataFrame, hold) -> tuple[DataFrame, DataFrame]:
    """What `diagnose` tells and what `parse` gives, of rows that are read once and held in between."""
    rows = hold(_valued(_rows(documents)))
    return _told(rows, documents), rows.where("fit and row > 0").drop("fit")


def _told(rows: DataFrame, documents: DataFrame) -> DataFrame:
    is_row = F.col("fit") & (F.col("row") > 0)
    told = rows.groupBy("source_id").agg(F.bool_or("fit").alias("fit"), F.count_if(is_row).alias("candidates"), F.count_if(is_row & F.col("valid")).alias("parsed"))
    known = documents.select("source_id", _section().isNotNull().alias("there")).join(told, "source_id", "left").fillna(0, ["candidates", "parsed"])
    error = F.when(~F.coalesce("there", F.lit(False)), "no section of the expected name").when(F.col("fit").isNull(), "empty table").when(~F.col("fit"), "unexpected header").when(F.col("parsed") == 0, "no valid rows")
    return known.select("source_id", F.lit("Software Engineering").alias("category"), "candidates", "parsed", (F.col("candidates") - F.col("parsed")).alias("skipped"), error.alias("error"))


def cells(documents: DataFrame) -> DataFrame:
    """`(source_id, row, column, cell, links)` of the section's table."""
    spark = documents.sparkSession
    spark.udtf.register("table_cells", TableCells)
    found = documents.select("source_id", _section().alias("section"))
    return spark.sql("select d.source_id, c.* from {found} d, lateral table_cells(d.section) c", found=found)


def _rows(documents: DataFrame) -> DataFrame:
    """`(source_id, row, c, names, fit, fits)` of every row, the first with the names too, from one pass over the pages.

    c: the row's cells in order; names, fit: those of the first row, and whether they are the expected ones."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("column", "cell", "links"))), lambda x: F.struct(x["cell"].alias("cell"), x["links"].alias("links")))
    rows = cells(documents).groupBy("source_id", "row").agg(held.alias("c"))
    first = F.when(F.col("row") == 0, F.transform("c", lambda x: F.lower(x["cell"])))
    named = rows.withColumn("names", F.max(first).over(Window.partitionBy("source_id")))
    fit = (F.size("names") == len(HEADER)) & F.forall(F.array(*map(F.lit, HEADER)), lambda n: F.array_contains("names", n))
    return named.withColumns({"fit": F.when(F.col("names").isNotNull(), fit), "fits": F.size("c") == len(HEADER)})


def parse(documents: DataFrame) -> DataFrame:
    """`(source_id, row, company, position, location, application_url, source_url, source_job_id, age, category, season, source_metadata, valid)`."""
    return _valued(_rows(documents)).where("fit and row > 0").drop("fit")


def _valued(rows: DataFrame) -> DataFrame:
    """Rows with their values; the names' own row has none to carry forward."""
    at = lambda name: F.try_element_at("c", F.nullif(F.array_position("names", F.lit(name)), F.lit(0).cast("long")).cast("int"))
    named = rows.select("source_id", "row", "fit", "fits", *(at(n)["cell"].alias(n) for n in HEADER), at("application")["links"].alias("links"))

    shown = F.trim(F.regexp_replace(F.translate("company", PRESENTATION, ""), r"(?U)\s+", " "))
    continued = F.trim("company").isin(CONTINUED)
    named = named.withColumn("own", F.when((F.col("row") > 0) & F.col("fits") & ~continued, F.nullif(shown, F.lit(""))))
    company = F.when(continued, text.carry_forward("own", "source_id", "row")).otherwise(F.col("own"))

    direct = lambda link: ~urls.host(link["href"]).endswith(OWN_HOST)
    pick = lambda test: F.try_element_at(F.filter("links", test), F.lit(1))["href"]
    source_url = pick(lambda x: ~direct(x))
    link = F.coalesce(pick(lambda x: direct(x) & F.array_contains(x["alts"], "apply")), pick(lambda x: direct(x) & (F.lower(F.trim(x["text"])) == "apply")), pick(direct), source_url)
    out = named.select(
        "source_id", "row", company.alias("company"), text.nonempty(F.col("role")).alias("position"), text.nonempty(F.col("location")).alias("location"), link.alias("application_url"),
        source_url.alias("source_url"), urls.aggregator_job_id(source_url).alias("source_job_id"), text.nonempty(F.col("age")).alias("age"),
        F.when(F.col("company").contains(HOT), "FAANG+").otherwise("Unknown").alias("category"), "fit", "fits",
        F.lit(SEASON).alias("season"), F.map_filter(F.create_map(F.lit("simplify_url"), source_url), lambda k, v: v.isNotNull()).alias("source_metadata"),
    )
    return out.withColumn("valid", F.col("fits") & F.forall(F.array("company", "position", "location", "application_url"), lambda x: x.isNotNull())).drop("fits")

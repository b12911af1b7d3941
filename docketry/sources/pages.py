"""What crawled pages hold: titles and links, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import first_present, let

BOILERPLATE = "Supreme Court E-Library"


def title(html: Column) -> Column:
    """The first of h1, center, h2 and the page title before a separator, without tags."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""), r"\s+", " "))
    return first_present(inner("h1"), inner("center"), inner("h2"), F.trim(F.element_at(F.split(inner("title"), r"[|\-–]"), 1)))


def title_of_markdown(text: Column) -> Column:
    """The first heading."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{1,2}\s+(.+)$", 1)), F.lit(""))


def links(html: Column) -> Column:
    """Targets of all links in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))


def absolute(url: Column, base: Column) -> Column:
    """A link against the page it stands on."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(url.rlike("^https?://"), url).when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(host, F.lit("/"), url))


def within(html: Column, box: str) -> Column:
    """What stands in the box of a page with this id, up to where the box itself closes; null without one.

    Boxes may lie in boxes: a count of how many are open tells which end is the
    box's own. One that never closes takes all that follows.
    """
    opens = rf"(?is)^<div\b[^>]*\bid=[\"']{box}[\"'][^>]*>"

    def found(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("last"))

        def step(acc: Column, part: Column) -> Column:
            at, inside = acc["at"] + 1, acc["depth"] > 0
            begins = ~inside & (acc["first"] == 0) & part.rlike(opens)
            depth = F.when(begins, 1).when(inside & part.rlike("(?i)^</div"), acc["depth"] - 1).when(inside & part.rlike(r"(?i)^<div\b"), acc["depth"] + 1).otherwise(acc["depth"])
            ends = inside & (depth == 0)
            return F.struct(at.alias("at"), depth.alias("depth"), F.when(begins, at).otherwise(acc["first"]).alias("first"), F.when(ends, at).otherwise(acc["last"]).alias("last"))

        def cut(place: Column) -> Column:
            last = F.when(place["last"] > 0, place["last"]).otherwise(place["at"] + 1)
            own = F.regexp_replace(F.element_at(parts, F.greatest(place["first"], F.lit(1))), opens, "")
            return F.when(place["first"] > 0, F.concat(own, F.array_join(F.slice(parts, place["first"] + 1, F.greatest(last - place["first"] - 1, F.lit(0))), "")))

        return let(F.aggregate(parts, start, step), cut)

    return F.nullif(let(F.split(html, r"(?i)(?=</?div\b)"), found), F.lit(""))


def decision_links(pages: DataFrame, mark: str = "showdocs", box: str | None = None) -> DataFrame:
    """(page_id, place, url) of the links to decisions, of those within a box if it is named."""
    where = F.col("html") if box is None else within(F.col("html"), box)
    found = pages.select("page_id", F.col("url").alias("page"), F.posexplode(links(where)).alias("place", "href"))
    return found.where(F.contains("href", F.lit(mark))).select("page_id", "place", absolute(F.col("href"), F.col("page")).alias("url"))


def months(html: Column, base: Column | None = None, first: int = 0, last: int = 9999) -> Column:
    """(year, url) of the links below each year's heading within the list of dates, in order.

    Only years ``first`` to ``last`` count; links are made absolute against ``base``.
    """
    inside = F.coalesce(within(html, "container_date"), html)
    marks = F.regexp_extract_all(inside, F.lit(r"(?is)(<h2[^>]*>\s*\d{4}|<a\s[^>]*href=\"[^\"]*\")"), F.lit(1))
    start = F.struct(F.lit(None).cast("int").alias("year"), F.array().cast("array<struct<year:int,url:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        year = F.try_to_number(F.nullif(F.regexp_extract(x, r"(?i)^<h2[^>]*>\s*(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
        url = F.regexp_extract(x, r'href="([^"]*)"', 1)
        whole = url if base is None else absolute(url, base)
        return F.when(year.isNotNull(), F.struct(year.alias("year"), acc["found"].alias("found"))).otherwise(F.struct(acc["year"].alias("year"), F.concat(acc["found"], F.array(F.struct(acc["year"].alias("year"), whole.alias("url")))).alias("found")))

    found = F.aggregate(marks, start, step, lambda acc: acc["found"])
    return found if (first, last) == (0, 9999) else F.filter(found, lambda m: m["year"].between(first, last))


def first_by_url(rows: DataFrame, *order: Column) -> DataFrame:
    """Of each URL the first row."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("_n = 1").drop("_n")


def worth_parsing(html: Column) -> Column:
    """Whether a page is long enough and not the site's own frame."""
    return (F.length(html) >= 1000) & ~(F.contains(html, F.lit(BOILERPLATE)) & (F.length(html) < 2000))

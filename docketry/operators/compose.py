"""Case records from crawled pages: every field of a record, from the page to its quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import classify, extract, text, titles
from docketry.session import ship
from docketry.sources import html

#: The court, and the version of the cleaning that records carry.
COURT, CLEAN_VERSION, UNTITLED = "Supreme Court", "v2.2", "Untitled Case"


def from_pages(pages: DataFrame, url: str = "url", page: str = "html", year: str | None = None, month: str | None = None, now: Column | None = None) -> DataFrame:
    """One case record for each crawled page."""
    ship(pages.sparkSession)
    read = pages.withColumn("_page", html.read(F.col(page)))
    return from_texts(read, F.col("_page.text"), F.col(url), F.col("_page.title"), F.col("_page.page_title"), F.col(year) if year else F.lit(None).cast("int"), F.col(month) if month else F.lit(None).cast("string"), now)


def usable_title(*titles_in_order: Column, special: Column, number: Column, division: Column, case_type: Column, url: Column) -> Column:
    """The first title that is valid; without any one made of what is known, the end of the address, or that there is none."""
    known = F.coalesce(text.present(special), F.concat(F.lit("G.R. No. "), text.present(number)))
    made = F.concat_ws(" ", known, F.concat(F.lit("("), division, F.lit(")")), F.when(case_type == "administrative", "Administrative Matter"))
    end = F.element_at(F.split(F.coalesce(url, F.lit("")), "/"), -1)
    tries = [F.when(titles.valid(t), t) for t in titles_in_order]
    return F.coalesce(*tries, text.present(made), F.when(titles.valid(end), end), F.lit(UNTITLED))


def from_texts(rows: DataFrame, body: Column, url: Column, title: Column, page_title: Column, year: Column, month: Column, now: Column | None = None) -> DataFrame:
    """Case records from texts of pages with their addresses, titles and hints."""
    ship(rows.sparkSession)
    clean = text.normalized(text.without_site_lines(F.coalesce(body, F.lit(""))))
    held = rows.select(clean.alias("clean_text"), url.alias("source_url"), title.alias("_guess"), page_title.alias("page_title"), year.cast("int").alias("promulgation_year"), month.alias("promulgation_month"))
    c = F.col("clean_text")
    held = held.withColumns({"gr_numbers": extract.gr_numbers(c), "special_numbers": extract.special_numbers(c), "_title": titles.derived(c), "division": extract.division(c), "_ponente": extract.ponente(c)})
    held = held.withColumns({
        "gr_number": F.try_element_at("gr_numbers", F.lit(1)), "special_number": F.try_element_at("special_numbers", F.lit(1)), "case_title": F.coalesce(text.present(F.col("_title")), F.col("_guess")),
        "en_banc": F.col("division") == "En Banc", "_ruling": extract.ruling(c, extract.RULING, extract.RULING_LEADS), "_found": extract.sections(c, extract.RULING, extract.RULING_LEADS), "_header": extract.header_block(c),
    })
    silent = F.coalesce(F.col("en_banc"), F.lit(False)) | F.contains(F.upper(F.substring(c, 1, 3000)), F.lit("PER CURIAM"))
    own = F.filter("_found", lambda s: s["section"] != "body")
    listed = F.when(c == "", F.array().cast("array<struct<section:string,content:string>>")).otherwise(F.concat(own, F.array(F.struct(F.lit("header").alias("section"), F.col("_header").alias("content")))))
    kinds = classify.case_types(F.coalesce("case_title", F.lit("")), c, F.coalesce("gr_number", F.lit("")))
    held = held.withColumns({"ponente": F.coalesce("_ponente", F.when(silent, "PER CURIAM")), "_sections": listed, "_kinds": kinds})
    taken = F.date_format(F.to_utc_timestamp(F.current_timestamp() if now is None else now, "UTC"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = usable_title(F.col("case_title"), F.col("_guess"), F.col("page_title"), special=F.col("special_number"), number=F.col("gr_number"), division=F.col("division"), case_type=F.col("_kinds.case_type"), url=F.col("source_url"))
    some = lambda name: F.when(F.size(name) > 0, F.col(name)).alias(name)
    n = F.size("_sections")
    return held.select(
        text.tagged_sha256(F.coalesce("source_url", F.lit(""))).alias("id"), "gr_number", some("gr_numbers"), "special_number", some("special_numbers"), "case_title", shown.alias("shown_title"), "page_title",
        extract.promulgation_date(c).cast("string").alias("promulgation_date"), "promulgation_year", "promulgation_month", F.lit(COURT).alias("court"), "source_url", F.lit(CLEAN_VERSION).alias("clean_version"),
        text.tagged_sha256(c).alias("checksum"), taken.alias("crawl_ts"), "ponente", "division", "en_banc", "clean_text", F.when(n > 0, F.map_from_entries("_sections")).alias("sections"),
        F.col("gr_number").isNotNull().alias("has_gr_number"), F.col("special_number").isNotNull().alias("has_special_number"), F.col("_kinds.case_type").alias("case_type"),
        F.when(F.size("_kinds.case_subtypes") > 0, F.col("_kinds.case_subtypes")).alias("case_subtypes"), F.try_element_at("_kinds.case_subtypes", F.lit(1)).alias("case_subtype"),
        F.struct(F.col("_ruling").isNotNull().alias("has_ruling"), F.length(c).alias("text_length"), n.alias("sections_extracted"), (n > 1).alias("has_structured_sections")).alias("quality_metrics"),
    )

"""Cutting texts into overlapping chunks of whole sentences. Texts stay in the JVM; where chunks begin and end is found from numbers of tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.extract import DISPOSITIVE, case_key, dispositive_excerpt, section_type, sections
from docketry.functions.text import first_present, let, present, preview, sentences, token_estimate, trimmed, uuid5
from docketry.session import ship

SIZE, OVERLAP, LEAST, WHOLE = 640, 96, 200, 1200


def spans_of(tokens: np.ndarray, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, last), counted from 1, of every chunk of sentences with these numbers of tokens.

    A chunk ends before the sentence that would take it above ``size`` tokens,
    and holds one sentence at least that the chunk before has not. It begins
    with the last sentences of the chunk before that hold ``overlap`` tokens at
    most together. Ends and beginnings are searched for in the running sums, so
    a chunk costs two binary searches, however long the text is.
    """
    sums = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    out, n, first, last = [], len(tokens), 0, -1
    while last < n - 1:
        if out:
            first = max(first, int(np.searchsorted(sums, sums[last + 1] - overlap, "left")))
        last = max(last + 1, int(np.searchsorted(sums, sums[first] + size, "right")) - 2)
        out.append((first + 1, last + 1))
    return out


def spans(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of each of several texts, given the tokens of their sentences (array<array<int>>); only numbers go to Python."""
    ship(SparkSession.active())

    @F.pandas_udf("array<array<struct<first:int,last:int>>>")
    def cut(rows: pd.Series) -> pd.Series:
        return rows.map(lambda texts: None if texts is None else [[{"first": a, "last": b} for a, b in spans_of(t, size, overlap)] for t in texts])

    return cut(tokens)


def all_windows(texts: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of each of several texts (array<array<string>> of sentences): filled up to ``size`` tokens, begun with the last ``overlap`` tokens, of ``least`` tokens or more."""
    found = spans(F.transform(texts, lambda held: F.transform(held, token_estimate)), size, overlap)

    def made(held: Column, cuts: Column) -> Column:
        joined = F.transform(cuts, lambda s: F.array_join(F.slice(held, s["first"], s["last"] - s["first"] + 1), " "))
        return F.filter(joined, lambda t: token_estimate(t) >= least)

    return F.zip_with(texts, found, made)


def windows(parts: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """The same of one text; null of a text that is null."""
    return F.element_at(all_windows(F.when(parts.isNotNull(), F.array(parts)), size, overlap, least), 1)


def chunk_id(case: Column, section: Column, paragraph: Column) -> Column:
    """The identifier of a chunk, the same in every run."""
    return uuid5(F.concat_ws("_", case, section, paragraph.cast("string")))


def supplied(given: Column) -> Column:
    """Sections that a record brings along as a map: names in lower case, texts trimmed, empty ones left out."""
    entries = F.transform(F.map_entries(given), lambda e: F.struct(F.lower(e["key"]).alias("section"), trimmed(e["value"]).alias("content")))
    return F.filter(entries, lambda s: first_present(s["content"]).isNotNull())


def summary(columns: list[str]) -> Column:
    """The line that identifies a case and says how it ended; what is missing is left out."""
    has = {c.lower() for c in columns}
    label = lambda name, c: F.concat(F.lit(f"{name}: "), present(F.col(c))) if c in has else F.lit(None).cast("string")
    areas = F.concat(F.lit("Legal Areas: "), present(F.array_join(F.slice("case_subtypes", 1, 3), ", "))) if "case_subtypes" in has else F.lit(None).cast("string")
    number = F.coalesce(label("G.R. Number", "gr_number"), label("Special Number", "special_number"))
    ruling = F.concat(F.lit("Ruling: "), present(dispositive_excerpt(F.col("clean_text"))))
    return F.concat_ws(". ", label("Case", "case_title"), number, label("Date", "promulgation_date"), label("Ponente", "ponente"), label("Case Type", "case_type"), ruling, areas)


def case_chunks(cases: DataFrame, key: str = "id", whole: int = WHOLE) -> DataFrame:
    """All chunks of every case: its summary, then its sections in order, with identifiers, places and previews.

    Sections are those that the record brings in ``sections``, if it has any,
    else those found in ``clean_text``. A case without numbers goes by ``key``.
    """
    parsed = sections(F.col("clean_text"), DISPOSITIVE)
    given = let(supplied(F.col("sections")), lambda s: F.when(F.size(s) > 0, s)) if "sections" in cases.columns else F.lit(None)
    named = cases.withColumn("case_id", case_key(F.col("gr_number"), F.col("special_number"), F.col(key).cast("string")))
    parts = F.when(first_present(F.col("clean_text")).isNotNull(), F.coalesce(given, parsed) if "sections" in cases.columns else parsed)

    def prepared(s: Column) -> Column:
        """A section under its own name, as its whole text where it is short, else as sentences."""
        short = s["section"].isin("ruling", "dispositive", "issues")
        name = F.when(s["section"] == "dispositive", "ruling").otherwise(s["section"])
        none = F.array().cast("array<string>")

        def held(content: Column) -> Column:
            entire = (content != "") & short & (token_estimate(content) <= whole)
            return F.struct(name.alias("section"), F.when(entire, content).alias("entire"), F.when(entire | (content == ""), none).otherwise(sentences(content)).alias("sentences"))

        return let(trimmed(s["content"]), held)

    # Sections and windows are columns of their own: a Python function cannot stand within another expression's lambda.
    named = named.withColumn("_summary", summary(cases.columns)).withColumn("_parts", F.transform(parts, prepared))
    named = named.withColumn("_windows", all_windows(F.transform("_parts", lambda s: s["sentences"])))

    def cut(s: Column, made: Column) -> Column:
        return F.transform(F.when(s["entire"].isNotNull(), F.array(s["entire"])).otherwise(made), lambda c, n: F.struct(s["section"].alias("section"), c.alias("content"), n.alias("paragraph_index"), F.lit("content").alias("chunk_type")))

    first = F.array(F.struct(F.lit("summary").alias("section"), F.col("_summary").alias("content"), F.lit(0).alias("paragraph_index"), F.lit("summary").alias("chunk_type")))
    rest = F.coalesce(F.flatten(F.zip_with("_parts", "_windows", cut)), F.array().cast("array<struct<section:string,content:string,paragraph_index:int,chunk_type:string>>"))
    listed = named.withColumn("_chunks", F.concat(first, rest)).withColumn("total_chunks", F.size("_chunks"))
    # There is always a summary; not being outer would compute the chunks a second time, to look for empty lists.
    flat = listed.select(*(c for c in cases.columns if c not in ("clean_text", "sections")), "case_id", "total_chunks", F.posexplode_outer("_chunks").alias("chunk_index", "_c"))
    out = flat.select("*", "_c.*").drop("_c")
    kind = F.when(F.col("chunk_type") == "summary", "mini_summary").otherwise(section_type(F.col("section")))
    name = F.when(F.col("chunk_type") == "summary", F.concat("case_id", F.lit("_summary"))).otherwise(F.concat_ws("_", "case_id", "section", F.col("paragraph_index").cast("string")))
    return out.withColumn("section_type", kind).withColumn("token_count", token_estimate(F.col("content"))).withColumn("content_preview", preview(F.col("content"))).withColumn("chunk_id", uuid5(name))


#: Fixed value: version of the payload.
CHUNK_VERSION = "v2.0"


def payload(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """(id, payload): the fields that go into an index with every chunk; what a case lacks has a default."""
    has = {c.lower() for c in chunks.columns}
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in has else F.lit("").alias(c)
    flag = lambda c: (F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)).alias(c)
    number = lambda c, kind: (F.coalesce(F.col(c), F.lit(0)) if c in has else F.lit(0)).cast(kind).alias(c)
    method = F.coalesce("classification_method", F.lit("rule_based_fallback")) if "classification_method" in has else F.lit("rule_based_fallback")
    kinds = F.col("case_type_classification") if "case_type_classification" in has else F.create_map().cast("map<string,double>")
    title = F.coalesce("case_title", F.lit("")) if "case_title" in has else F.lit("")
    date = F.coalesce(F.col("promulgation_date").cast("string"), F.lit("")) if "promulgation_date" in has else F.lit("")
    return chunks.select(
        F.col("chunk_id").alias("id"),
        F.struct(
            "content", "section", "section_type", "chunk_type", "paragraph_index", "token_count", "case_id", text("gr_number"), text("special_number"), title.alias("title"), date.alias("date"),
            text("ponente"), text("division"), flag("en_banc"), text("source_url"), number("promulgation_year", "int"), flag("is_administrative"), "chunk_index", "total_chunks",
            F.lit(CHUNK_VERSION).alias("chunk_version"), F.unix_timestamp(F.current_timestamp() if now is None else now).alias("processed_timestamp"),
            method.alias("classification_method"), number("classification_confidence", "double"), kinds.alias("case_type_classification"),
        ).alias("payload"),
    )


def contextual_payload(chunks: DataFrame, context: Column) -> DataFrame:
    """(id, payload): chunks with the sentence that says what they are, and the chunk as it was."""
    has = {c.lower() for c in chunks.columns}
    text = lambda c, name=None: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")).alias(name or c)
    return chunks.select(
        F.col("chunk_id").alias("id"),
        F.struct(
            F.concat(context, F.lit(" "), "content").alias("content"), F.col("content").alias("original_content"), "section", "section_type", text("gr_number"), text("special_number"),
            text("case_title", "title"), text("ponente"), text("case_type"), text("promulgation_date", "date"), "chunk_type", "token_count", F.lit(True).alias("contextual"), F.col("chunk_id").alias("stable_id"),
        ).alias("payload"),
    )

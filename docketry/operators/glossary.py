"""Glossary search: by name, by part of a name, then by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.search import sized
from docketry.operators.substrings import alike, containing

LIKE_FROM = 0.72
#: Fixed values, applied in this order.
REPLACED = [("versus", "v."), ("vs.", "v."), ("vs", "v."), ("people of the philippines", "people"), ("sec.", "section"), ("§", "section"), ("ra ", "republic act "), ("r.a.", "republic act")]
#: A few entries for when no file has any.
SEED = [
    ("Amparo", ["writ of amparo"], "Remedy for violations of the right to life, liberty and security.", 5),
    ("Certiorari", ["rule 65"], "Writ to correct grave abuse of discretion where no appeal lies.", 5),
    ("Estafa", ["swindling"], "Fraud that causes damage to another.", 4),
    ("Habeas corpus", [], "Writ to bring a detained person before the court.", 4),
    ("Quo warranto", [], "Action to try the right to a public office.", 3),
    ("Res judicata", ["bar by prior judgment"], "A matter adjudged is settled between the parties.", 4),
]


ENTRY = "term string, aliases array<string>, definition string, elements array<string>, anchors array<struct<type:string,id:string>>, bar_importance int"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries of JSON files that hold a list or a record with ``entries``; other files are ignored.

    Without any entry the seed stands in.
    """
    files = spark.read.text(list(paths), wholetext=True)
    entry = f"array<struct<{', '.join(f'{n}:{t}' for n, t in (f.strip().split(' ', 1) for f in ENTRY.replace('struct<type:string,id:string>', 'map<string;string>').split(',')))}>>".replace("map<string;string>", "map<string,string>")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", entry)).otherwise(F.from_json("value", f"struct<entries:{entry}>")["entries"])
    found = files.select(F.explode(listed).alias("e")).select("e.term", "e.aliases", "e.definition", F.col("e.bar_importance").alias("importance"), "e.elements", "e.anchors")
    empty = F.lit(None)
    seed = spark.createDataFrame(SEED, "term string, aliases array<string>, definition string, importance int")
    seed = seed.withColumn("elements", empty.cast("array<string>")).withColumn("anchors", empty.cast(found.schema["anchors"].dataType))
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.unionByName(seed.crossJoin(F.broadcast(none)).drop("n"))


def normal(c: Column) -> Column:
    """A name in lower case with its usual short forms written out."""
    c = F.lower(F.trim(c))
    for a, b in REPLACED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\s+", " ")


def names(entries: DataFrame) -> DataFrame:
    """(term, definition, importance, name, exact) for every term and alias of the entries with a definition."""
    good = entries.where((F.trim("term") != "") & (F.trim("definition") != ""))
    own = F.array(F.struct(normal(F.col("term")).alias("name"), F.lit(99.0).alias("exact")))
    also = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(normal(a).alias("name"), F.lit(100.0).alias("exact")))
    return good.select("term", "definition", F.coalesce("importance", F.lit(3)).alias("importance"), F.explode(F.concat(own, also)).alias("n")).select("term", "definition", "importance", "n.name", "n.exact").where("name <> ''")


def search(entries: DataFrame, queries: DataFrame, k: int = 5, fuzzy: bool = True) -> DataFrame:
    """(query_id, term, score, rank): an exact name alone, else parts of names and names that are alike.

    Exact names meet by equality, parts and likeness by the runs of characters
    that they share (``substrings``). A question without a word finds nothing.
    """
    asked = queries.select("query_id", normal(F.col("query")).alias("q")).where("q <> ''").distinct()
    known = names(entries).select("term", "importance", "name", "exact").distinct()
    texts, parts = known.select("name").distinct(), asked.select(F.col("query_id").alias("large_id"), F.col("q").alias("text"))
    extra = (F.col("importance") - 3) * 2.0
    exact = asked.join(known, F.col("q") == F.col("name")).select("query_id", "term", F.col("exact").alias("score"), "exact")
    within = containing(parts, texts.select(F.col("name").alias("small_id"), F.col("name").alias("part"))).select(F.col("large_id").alias("query_id"), F.col("small_id").alias("name"))
    around = containing(texts.select(F.col("name").alias("large_id"), F.col("name").alias("text")), parts.select(F.col("large_id").alias("small_id"), F.col("text").alias("part"))).select(F.col("small_id").alias("query_id"), F.col("large_id").alias("name"))
    told = within.union(around).distinct().withColumn("points", F.lit(82.0))
    if fuzzy:
        near = alike(parts.select(F.col("large_id").alias("left_id"), F.col("text").alias("a")), texts.select(F.col("name").alias("right_id"), F.col("name").alias("b")), LIKE_FROM)
        told = told.union(near.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("name"), (70.0 + F.col("ratio") * 20.0).alias("points")))
    other = told.join(known, "name").select("query_id", "term", (F.col("points") + extra).alias("score"), F.lit(None).cast("double").alias("exact"))
    every = exact.union(other)
    scored = every.withColumn("best", F.max("exact").over(Window.partitionBy("query_id"))).where(F.col("best").isNull() | ((F.col("exact") == F.col("best"))))
    best = scored.groupBy("query_id", "term").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answer(term: Column, definition: Column, elements: Column | None = None, anchors: Column | None = None) -> Column:
    """An entry as text, with its elements if they are given, and what it is anchored in."""
    listed = None if elements is None else F.when(F.size(elements) > 0, F.concat(F.lit("Elements:\n- "), F.array_join(elements, "\n- ")))
    named = lambda a: F.concat(F.coalesce(a["type"], F.lit("")), F.lit(": "), F.coalesce(a["id"], F.lit("")))
    sources = None if anchors is None else F.when(F.size(anchors) > 0, F.concat(F.lit("Anchors: "), F.array_join(F.transform(anchors, named), "; ")))
    return F.concat_ws("\n", F.concat_ws(": ", term, definition), *(c for c in (listed, sources) if c is not None))


#: Score from which an entry answers a question.
ANSWER_FROM = 78.0
#: Fixed patterns: what asks for a definition, for elements or for the difference of two rules, and what names a case and so asks for none.
DEFINES = r"(?i)^(?:what\s+is|define|meaning\s+of|ano\s+ang)\s+(.+)"
ELEMENTS = r"(?i)\b(?:elements|tests?)\s+of\s+(.+)"
RULES = r"(?i)rule\s*45\s*(?:vs|versus|v\.?)\s*65"
NAMES_NUMBER = r"(?i)\bG\.\s*R\.\s*(?:No\.|Nos\.)?\s*\d{1,6}(?:-\d{1,6})?\b"
NAMES_CASE = r"\b([A-Z][A-Za-z'.()\- ]+)\s+v\.?s?\.?\s+([A-Z][A-Za-z'.()\- ]+)\b"
#: Fixed value: what tells the two rules apart.
RULES_TOLD = "Use Rule 45 for errors of law in judgments; Rule 65 for jurisdictional errors (grave abuse of discretion)."


def respond(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer) of every question: the entry it asks for, or null where a search has to answer.

    A question for elements gets them with the entry, one for the difference of
    rules 45 and 65 both definitions, if the glossary has both.
    """
    q = F.trim("query")
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^[ ?.]+|[ ?.]+$", ""), F.lit(""))
    defined, elements = bare(F.regexp_extract(normal(q), DEFINES, 1)), bare(F.regexp_extract(q, ELEMENTS, 1))
    kind = F.when((q == "") | q.rlike(NAMES_NUMBER) | q.rlike(NAMES_CASE), F.lit(None)).when(q.rlike(RULES), "rules").when(normal(q).rlike(r"(?i)^(what\s+is|define|meaning\s+of|ano\s+ang)\b"), "definition").when(elements.isNotNull(), "elements")
    keyed = queries.select("query_id", kind.alias("kind"), F.when(kind == "definition", F.coalesce(defined, q)).when(kind == "elements", elements).alias("key"))
    pair = F.when(F.col("kind") == "rules", F.array(F.lit("Rule 45"), F.lit("Rule 65"))).otherwise(F.array("key"))
    asked = keyed.where("kind is not null").select("query_id", "kind", F.posexplode(pair).alias("place", "query"))
    best = search(entries, asked.select(F.struct("query_id", "place").alias("query_id"), "query"), k=1).select("query_id.query_id", "query_id.place", "term", "score")
    has = {c.lower() for c in entries.columns}
    plain = answer(F.col("term"), F.col("definition"), None, F.col("anchors") if "anchors" in has else None)
    full = answer(F.col("term"), F.col("definition"), F.col("elements") if "elements" in has else None, F.col("anchors") if "anchors" in has else None)
    texts = entries.groupBy("term").agg(F.first(plain).alias("plain"), F.first(full).alias("full"), F.trim(F.first("definition")).alias("definition"))
    found = asked.join(best, ["query_id", "place"]).join(sized(texts), "term")
    one = found.where("kind <> 'rules'").where(F.col("score") >= ANSWER_FROM).select("query_id", F.when(F.col("kind") == "elements", F.col("full")).otherwise(F.col("plain")).alias("answer"))
    both = found.where("kind = 'rules' and definition <> ''").groupBy("query_id").agg(F.max(F.when(F.col("place") == 0, F.col("definition"))).alias("a"), F.max(F.when(F.col("place") == 1, F.col("definition"))).alias("b"))
    told = F.concat(F.lit("Rule 45: "), "a", F.lit("\nRule 65: "), "b", F.lit("\n" + RULES_TOLD))
    return keyed.select("query_id").join(one.unionByName(both.select("query_id", told.alias("answer"))), "query_id", "left")


def syllabus(subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """``subjects`` with the areas that ``topics`` (subject, areas) gives them; one that it lacks is not specified."""
    return subjects.join(topics, "subject", "left").withColumn("areas", F.coalesce("areas", F.array(F.lit("Not specified"))))

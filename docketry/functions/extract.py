"""Fields of a case record, read from its text by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import captured, contains_any, first_present, let, present, trimmed

#: Fixed patterns: numbers of cases.
GR_BLOCK = r"(?i)G\.R\.\s+No(?:s)?\.?\s*([0-9][0-9\-*,\s]+)"
#: Kinds of special numbers in order, with how their prefix is written in a pattern.
SPECIAL = [("A.M.", r"A\.M\."), ("OCA", "OCA"), ("U.C.", r"U\.C\."), ("ADM", "ADM"), ("A.C.", r"A\.C\."), ("AC", "AC"), ("B.M.", r"B\.M\."), ("LRC", "LRC"), ("SP", "SP")]
#: Fixed patterns: a date in the header, then anywhere.
DATE = r"(\w+\s+\d{1,2},\s+\d{4})"
HEADER_DATES = [
    rf"(?i)\[.*?G\.R\.\s+No\.?\s*\d+.*?,\s*{DATE}\s*\]",
    rf"(?i)G\.R\.\s+No\.?\s*\d+.*?,\s*{DATE}",
    rf"(?i)\[.*?A\.M\.\s+No\.?\s*[^,]+,\s*{DATE}\s*\]",
    rf"(?i)(?:FIRST|SECOND|THIRD|EN\s+BANC)\s+DIVISION\s*\[.*?G\.R\.\s+No\.?\s*\d+.*?,\s*{DATE}\s*\]",
    rf"(?i)\[.*?{DATE}\s*\]",
]
BODY_DATES = [rf"(?i)Promulgated\s*(?:on)?\s*:\s*{DATE}", rf"(?i)Promulgated\s*(?:on)?\s*{DATE}", rf"(?i)Decided\s*(?:on)?\s*:\s*{DATE}", rf"(?i)Decided\s*(?:on)?\s*{DATE}", rf"(?i){DATE}"]
#: Fixed patterns: a justice's name before the mark of the office.
NAME = r"([A-Z][A-Za-z\-']+(?:\s+[A-Z][A-Za-z\-']+)*)"
LONG_NAME = r"([A-Z][A-Za-z\-']+(?:\s+[A-Z][A-Za-z\-']+)*(?:\s+(?:SR\.|JR\.|III|IV|V|VI|VII|VIII|IX|X))*)"
PONENTE_LAST = rf"\b{NAME}\s*,\s*J\.?\b"
SPACED = r"(?:D\s*E\s*C\s*I\s*S\s*I\s*O\s*N\s+)"
PONENTES = [rf"{NAME}\s*,\s*(C\.J\.|J\.|JJ\.|CJ\.|CJ|SAJ)\s*[:\.]?", rf"{SPACED}{NAME}\s*,\s*(C\.J\.|J\.|JJ\.|CJ\.|CJ|SAJ)\s*[:\.]?", rf"{LONG_NAME}\s*,\s*(J\.|JJ\.|C\.J\.|CJ\.|CJ|SAJ)\s*[:\.]?", rf"{LONG_NAME}\s*,\s*(J|JJ|C\.J\.|CJ\.|CJ|SAJ)\s*[:\.]?"]
HEADINGS = r"(?i)^(?:DECISION\s+|RESOLUTION\s+|D\s*E\s*C\s*I\s*S\s*I\s*O\s*N\s+|R\s*E\s*S\s*O\s*L\s*U\s*T\s*I\s*O\s*N\s+)"
#: Fixed patterns: the ruling as a page's record and as its chunks see it.
RULING = r"(?is)(?:WHEREFORE.*?SO ORDERED\.?|ACCORDINGLY.*?SO ORDERED\.?|IN VIEW WHEREOF.*?SO ORDERED\.?)"
DISPOSITIVE = r"(?is)(?:WHEREFORE|ACCORDINGLY|IN VIEW OF THE FOREGOING|IN VIEW WHEREOF|THUS|HENCE|PREMISES CONSIDERED).{0,10000}?SO\s+ORDERED\.?"


def head_lines(text: Column, n: int = 10) -> Column:
    """The first lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def gr_numbers(text: Column) -> Column:
    """Numbers of the case in order: those of the first ten lines, else of the first 4,000 characters."""

    def found(where: Column) -> Column:
        parts = F.flatten(F.transform(F.regexp_extract_all(where, F.lit(GR_BLOCK), F.lit(1)), lambda b: F.split(b, r"[,\s]+")))
        return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\*+$", "")), lambda p: p != ""))

    head = found(head_lines(text))
    numbers = F.when(F.size(head) > 0, head).otherwise(found(F.substring(text, 1, 4000)))
    return F.transform(numbers, lambda n: F.when(n.rlike(r"^[0-9]+(-[0-9]+)*$"), F.concat(F.lit("G.R. No. "), n)).otherwise(n))


def special_numbers(text: Column) -> Column:
    """Numbers of administrative and other special cases, kind by kind, within 4,000 characters."""
    window = F.substring(text, 1, 4000)

    def named(kind: str, prefix: str) -> Column:
        return F.transform(F.regexp_extract_all(window, F.lit(rf"(?i){prefix}\s+No\.?\s*([A-Z0-9\-]+)"), F.lit(1)), lambda n: F.concat(F.lit(f"{kind} No. "), n))

    return F.array_distinct(F.concat(*(named(*pair) for pair in SPECIAL)))


def division(text: Column) -> Column:
    """En Banc or the division named within 800 characters."""
    upper = F.upper(F.substring(text, 1, 800))
    found = F.when(F.contains(upper, F.lit("EN BANC")), "En Banc")
    for name in ("First", "Second", "Third"):
        found = found.when(F.contains(upper, F.lit(f"{name.upper()} DIVISION")), f"{name} Division")
    return found


def promulgation_date(text: Column) -> Column:
    """The first pattern that gives a date: those of the header within 2,000 characters, then those of the body."""
    head = F.substring(text, 1, 2000)
    read = [captured(head, p) for p in HEADER_DATES] + [captured(text, p) for p in BODY_DATES]
    return F.coalesce(*(F.to_date(F.coalesce(F.try_to_timestamp(F.regexp_replace(d, r"\s+", " "), F.lit(f)))) for d in read for f in ("MMMM d, yyyy", "MMM d, yyyy")))


def ponente(text: Column) -> Column:
    """The justice who wrote the decision, with the mark of the office."""
    window = F.substring(text, 1, 5000)
    found = []
    for pattern in PONENTES:
        name = F.trim(F.regexp_replace(F.trim(captured(window, pattern)), HEADINGS, ""))
        mark = captured(window, pattern, 2)
        found.append(F.concat(name, F.lit(", "), F.when(mark.isin("J", "JJ"), F.concat(mark, F.lit("."))).otherwise(mark)))
    plain = F.trim(F.regexp_replace(captured(window, PONENTE_LAST), HEADINGS, ""))
    return F.coalesce(*found, F.concat(plain, F.lit(", J.")))


#: Letters that markers of sections are written in; texts keep their length where only these change.
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Where each section begins, and what ends it; of two beginnings of one section the first that gives enough text counts.
MARKERS = [
    ("facts", "THE FACT", ["THE ISSUE", "THE RULING", "WHEREFORE"]), ("facts", "ANTECEDENT FACT", ["THE ISSUE", "THE RULING", "WHEREFORE"]),
    ("issues", "THE ISSUE", ["THE RULING", "WHEREFORE"]), ("issues", "ISSUE", ["THE RULING", "WHEREFORE"]),
    ("arguments", "THE RULING", ["WHEREFORE"]), ("arguments", "DISCUSSION", ["WHEREFORE"]),
]
LEADS = ["WHEREFORE", "ACCORDINGLY", "IN VIEW OF THE FOREGOING", "IN VIEW WHEREOF", "THUS", "HENCE", "PREMISES CONSIDERED"]
RULING_LEADS = ["WHEREFORE", "ACCORDINGLY", "IN VIEW WHEREOF"]


def _first_of(places: list[Column]) -> Column:
    """The smallest place that is not 0; null without one."""
    return F.least(*(F.nullif(p, F.lit(0)) for p in places)) if len(places) > 1 else F.nullif(places[0], F.lit(0))


def _capitals(text: Column) -> Column:
    """The text in capitals, each character in its place."""
    upper = F.upper(text)
    return F.when(F.length(upper) == F.length(text), upper).otherwise(F.translate(text, _SMALL, _LARGE))


def _ruling(text: Column, upper: Column, pattern: str, leads: list[str]) -> Column:
    lead = _first_of([F.instr(upper, w) for w in leads])
    return F.when(F.contains(upper, F.lit("ORDERED")), let(lead, lambda at: captured(F.substr(text, at), pattern, 0)))


def ruling(text: Column, pattern: str = DISPOSITIVE, leads: list[str] = LEADS) -> Column:
    """The disposition: from the first word that leads one in to SO ORDERED; null without one.

    The pattern is only tried from the first such word on, and only where an order is given at all.
    """
    return let(_capitals(text), lambda upper: _ruling(text, upper, pattern, leads))


def sections(text: Column, pattern: str = DISPOSITIVE, leads: list[str] = LEADS) -> Column:
    """Sections of more than 100 characters by name, the ruling of any length; the whole text as body if there are none.

    Markers are located in one copy of the text in capitals, then the text is sliced.
    """

    def content(upper: Column, begin: str, ends: list[str]) -> Column:
        start = F.nullif(F.instr(upper, begin), F.lit(0))
        part = let(start, lambda at: F.substr(text, at, F.coalesce(_first_of([F.position(F.lit(e), upper, at + len(begin)) for e in ends]), F.length(text) + 1) - at))
        return let(F.regexp_replace(part, r"^\s+|\s+$", ""), lambda c: F.when(F.length(c) > 100, c))

    def listed(upper: Column) -> Column:
        pairs = [F.struct(F.lit("ruling").alias("section"), F.trim(_ruling(text, upper, pattern, leads)).alias("content"))]
        for name in dict.fromkeys(m[0] for m in MARKERS):
            tries = [content(upper, begin, ends) for own, begin, ends in MARKERS if own == name]
            pairs.append(F.struct(F.lit(name).alias("section"), F.coalesce(*tries).alias("content")))
        return F.filter(F.array(*pairs), lambda s: s["content"].isNotNull())

    body = F.array(F.struct(F.lit("body").alias("section"), text.alias("content")))
    return let(let(_capitals(text), listed), lambda some: F.when(F.size(some) > 0, some).otherwise(body))


def section_type(section: Column) -> Column:
    """What kind of section a name stands for."""
    s = F.lower(section)
    kinds = [("dispositive", ["ruling", "dispositive", "decision"]), ("factual", ["facts", "antecedent_facts"]), ("issues", ["issues", "issue"]), ("legal_analysis", ["arguments", "discussion", "analysis"]), ("summary", ["summary"])]
    out = F.when(F.lit(False), "")
    for kind, names in kinds:
        out = out.when(s.isin(names), kind)
    return out.otherwise("general")


#: The sentence put before a chunk of each kind.
CONTEXTS = {
    "dispositive": "This section contains the court's final ruling and decision.",
    "factual": "This section describes the facts and circumstances of the case.",
    "issues": "This section identifies the legal issues to be resolved.",
    "legal_analysis": "This section provides the legal analysis and reasoning.",
    "general": "This section contains legal content from the case.",
}


def context_of(kind: Column) -> Column:
    """The sentence that says what kind of section follows."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CONTEXTS.items() for x in pair)), kind), F.lit(CONTEXTS["general"]))


def header_block(text: Column) -> Column:
    """Lines before the first that announces a decision, 21 at most."""
    lines = F.slice(F.split(text, "\n"), 1, 21)
    stop = F.array_position(F.transform(lines, lambda x: contains_any(F.upper(x), ["DECISION", "RESOLUTION", "ORDER"])), True)
    return F.trim(F.array_join(F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines), "\n"))


def dispositive_excerpt(text: Column) -> Column:
    """The first 200 characters of the ruling, cut at a word if one ends after the 150th."""

    def cut(found: Column) -> Column:
        first = F.trim(F.substring(found, 1, 200))
        at = F.length(first) - F.locate(" ", F.reverse(first))
        whole = F.when((F.locate(" ", F.reverse(first)) > 0) & (at > 150), F.concat(F.substr(first, F.lit(1), at), F.lit("..."))).otherwise(first)
        return F.when(F.length(found) > 200, whole).otherwise(first)

    return F.coalesce(let(ruling(text), cut), F.lit(""))


def gr_of_query(query: Column) -> Column:
    """The number that a question names, without leading zeros."""
    found = F.coalesce(captured(query, r"(?i)G\.R\.?\s*NOS?\.?\s*([0-9\-]+)"), captured(query, r"(?i)GR\s*NOS?\.?\s*([0-9\-]+)"), captured(query, r"\b(\d{5,})\b"))
    return F.when(F.contains(found, F.lit("-")), found).otherwise(F.when(found.rlike("^0+$"), "0").otherwise(F.regexp_replace(found, "^0+", "")))


def special_of_query(query: Column) -> Column:
    """The special number that a question names; letters may precede its digits."""
    return F.coalesce(*(F.concat(F.lit(f"{kind} No. "), captured(query, rf"(?i){p}\s+No\.?\s*([A-Z0-9\-]+)")) for kind, p in SPECIAL))


#: Fixed patterns: questions for the decisions of a justice, and where they name the justice.
PONENTE_QUERY = r"cases\s+penned\s+by\s+justice|decisions\s+by\s+justice|opinions\s+by\s+justice|justice\s+[a-z\s]+\s+cases|justice\s+[a-z\s]+\s+decisions|justice\s+[a-z\s]+\s+opinions|penned\s+by\s+justice|written\s+by\s+justice|authored\s+by\s+justice"
PONENTE_NAMES = [r"cases\s+penned\s+by\s+justice\s+([a-zA-Z\s\-']+)", r"decisions\s+by\s+justice\s+([a-zA-Z\s\-']+)", r"justice\s+([a-zA-Z\s\-']+)\s+cases", r"justice\s+([a-zA-Z\s\-']+)\s+decisions", r"penned\s+by\s+justice\s+([a-zA-Z\s\-']+)"]


def asks_ponente(query: Column) -> Column:
    """Whether a question asks for the decisions of a justice."""
    return F.lower(F.trim(query)).rlike(PONENTE_QUERY)


def ponente_of_query(query: Column) -> Column:
    """The justice that a question names."""
    return F.coalesce(*(present(F.trim(captured(query, rf"(?i).*{p}"))) for p in PONENTE_NAMES))


def asks_title(query: Column) -> Column:
    """Whether a question names two parties."""
    return F.lower(query).rlike(r"\bvs\.?\b|\bversus\b")


def parties(query: Column) -> Column:
    """The two sides of a question, in lower case."""
    sides = F.split(F.lower(query), r"\bvs\b\.?|\bversus\b")
    return F.when(F.size(sides) >= 2, F.filter(F.transform(F.slice(sides, 1, 2), trimmed), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def plain_name(name: Column) -> Column:
    """A name in lower case without hyphens, points and commas."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), r"[.,]", ""), r"\s+", " "))


def ponente_matches(doc: Column, name: Column) -> Column:
    """Whether a decision's justice is the one asked for, by full name, surname or all parts."""
    own, asked = plain_name(doc), plain_name(name)
    surname = F.element_at(F.split(asked, " "), -1)
    return F.coalesce((own != "") & (asked != "") & (F.contains(own, asked) | F.contains(own, surname) | F.forall(F.split(asked, " "), lambda p: F.contains(own, p))), F.lit(False))


def display_number(value: Column) -> Column:
    """A number in its usual form, or Unknown."""
    number = F.coalesce(captured(value, r"(?i)G\.R\.?\s*No\.?\s*([0-9\-]+)"), captured(value, r"\b(\d{5,})\b"))
    return F.coalesce(F.concat(F.lit("G.R. No. "), number), F.lit("Unknown"))


def number_link(number: Column) -> Column:
    """A number as a link of the chat."""
    gr, am = captured(number, r"G\.R\.\s+No\.\s+([0-9\-]+)"), captured(number, r"A\.M\.\s+No\.\s+([A-Z0-9\-]+)")
    return (
        F.when(F.coalesce(number, F.lit("")).isin("", "Unknown"), F.concat(F.lit("("), F.coalesce(number, F.lit("")), F.lit(")")))
        .when(gr.isNotNull(), F.concat(F.lit("**["), number, F.lit("](gr:"), gr, F.lit(")**")))
        .when(am.isNotNull(), F.concat(F.lit("**["), number, F.lit("](am:"), am, F.lit(")**")))
        .otherwise(F.concat(F.lit("**("), number, F.lit(")**")))
    )


def query_parts(query: Column) -> Column:
    """The question and its two sides, whole and in words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(query)), r"\bversus\b", "vs"), r"\bvs\.?(?=\W|$)", "vs")
    at = F.regexp_instr(plain, F.lit(r"\bvs\b"))
    words = lambda c: F.filter(F.split(c, r"[,&\s]+"), lambda p: p != "")
    left = words(F.when(at > 0, F.substr(plain, F.lit(1), at - 1)).otherwise(plain))
    right = words(F.when(at > 0, F.substr(plain, at + 2)).otherwise(""))
    return F.struct(plain.alias("full"), F.when(at > 0, F.array_join(left, " ")).otherwise(plain).alias("petitioner"), F.array_join(right, " ").alias("respondent"), left.alias("left"), right.alias("right"))


def title_similarity(parts: Column, title: Column) -> Column:
    """100 for the whole question in the title, 50 for each side, 20 for each longer word."""
    low = F.lower(title)
    points = lambda p, n: F.when((p != "") & F.contains(low, p), n).otherwise(0.0)
    words = F.size(F.filter(F.concat(parts["left"], parts["right"]), lambda p: (F.length(p) > 2) & F.contains(low, p)))
    score = F.when(F.contains(low, parts["full"]), 100.0).otherwise(0.0) + points(parts["petitioner"], 50.0) + points(parts["respondent"], 50.0) + words * 20.0
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).otherwise(score)


def case_key(gr: Column, special: Column, other: Column) -> Column:
    """What tells a case: its number, its special number, or else."""
    return first_present(gr, special, other)


def within_years(year: Column, date: Column, first: int, last: int) -> Column:
    """Whether a case may be of these years: by its year, else by the four digits that its date begins with; unknown years pass."""
    known = F.coalesce(year.cast("int"), F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int"))
    return known.isNull() | known.between(first, last)

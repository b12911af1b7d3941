"""Texts for display, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import captured, first_present, let, trimmed

#: Names of known sites.
SITES = {
    "elibrary.judiciary.gov.ph": "Supreme Court E-Library", "sc.judiciary.gov.ph": "Supreme Court", "lawphil.net": "LawPhil",
    "chanrobles.com": "ChanRobles", "supremecourt.gov.ph": "Supreme Court Official", "officialgazette.gov.ph": "Official Gazette",
}


def site(url: Column) -> Column:
    """The site of a result by name, or its host."""
    host = F.replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("www."), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SITES.items() for x in pair)), host), host)


def web_relevance(url: Column, title: Column) -> Column:
    """10, 20 more for a legal site, 15 for the government, 10 for a title with one of four words."""
    u, t = F.lower(url), F.lower(title)
    return 10.0 + F.when(u.rlike(r"elibrary\.judiciary\.gov\.ph|sc\.judiciary\.gov\.ph|lawphil\.net"), 20.0).otherwise(0.0) + F.when(F.contains(u, F.lit(".gov.ph")), 15.0).otherwise(0.0) + F.when(t.rlike("supreme court|decision|ruling|case"), 10.0).otherwise(0.0)


def plain_snippet(text: Column) -> Column:
    """One line, with two entities resolved."""
    return F.trim(F.replace(F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def clean_response(text: Column) -> Column:
    """Without instruction marks, disclaimers and runs of empty lines."""
    t = F.regexp_replace(text, r"\[/?(INST|SYS|USER|ASSISTANT)\]", "")
    t = F.regexp_replace(t, r"(?im)^(Based on (my )?(general )?knowledge(,)?|I can provide|However,? please note that,?|I may not have (complete )?details?|Note that I)\.?\s*", "")
    t = F.regexp_replace(t, r"(?is)\s+However,? please note that.*$|\s+Please note that I may not have.*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\n\s*\n\s*\n+", "\n\n")


def line_kind(line: Column) -> Column:
    """What a line of an answer is shown as."""
    x = F.trim(line)
    link = x.rlike(r"\*\*\[[^\]]+\]\((gr|am|https?):[^)]+\)\*\*")
    return F.when(x == "", "blank").when(link, "link").when(x.rlike(r"^\*\*[^*]+\*\*:?$|^#{1,3} "), "heading").when(x.rlike(r"^[-*•] "), "bullet").otherwise("paragraph")


def case_of_response(text: Column) -> Column:
    """The number of the case that an answer is about."""
    return F.coalesce(captured(text, r"\((?:gr|am):([^)]+)\)"), captured(text, r"G\.R\. No\. ([0-9\-]+)"))


def messages(prompt: Column) -> Column:
    """A prompt as its parts by role."""
    parts = F.filter(F.split(F.regexp_replace(prompt, r"(?m)^(System|User): ", "\u0001$1\u0002"), "\u0001"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0002")), F.struct(F.lower(F.element_at(F.split(p, "\u0002"), 1)).alias("role"), trimmed(F.element_at(F.split(p, "\u0002"), 2)).alias("content"))).otherwise(F.struct(F.lit("user").alias("role"), trimmed(p).alias("content"))))


def action(answer: Column) -> Column:
    """What a classifier's answer asks to be done, and on what."""
    name = captured(answer, r"\[(SEARCH_CASES|CASE_DIGEST|WEB_SEARCH)(?::([^\]]*))?\]")
    return F.struct(name.alias("name"), captured(answer, r"\[(SEARCH_CASES|CASE_DIGEST|WEB_SEARCH):([^\]]*)\]", 2).alias("focus"))


def template_sections(query: Column) -> Column:
    """Sections of the simplified template."""
    q = F.lower(query)
    f, i = F.contains(q, F.lit("fact")), F.contains(q, F.lit("issue"))
    r, d = F.contains(q, F.lit("ruling")) | F.contains(q, F.lit("decision")), F.contains(q, F.lit("digest")) | F.contains(q, F.lit("covering"))
    return F.when(d, "FACTS|ISSUES|RULING").when(f & ~i & ~r, "FACTS").when(r & ~f & ~i, "RULING").when(i & ~f & ~r, "ISSUES").otherwise("FACTS|ISSUES|RULING")


def enhanced(query: Column) -> Column:
    """A question for the web with the country, and the word law unless it is legal already."""
    low = F.lower(query)
    return F.when(F.contains(low, F.lit("philippine")), query).when(low.rlike("law|legal|court"), F.concat(query, F.lit(" Philippines"))).otherwise(F.concat(query, F.lit(" Philippines law")))


#: Bytes of an answer from which its debug list is cut, and entries that stay.
LARGE_ANSWER, DEBUG_KEPT = 100_000, 20


def debug_shown(size: Column, entries: Column) -> Column:
    """How many of an answer's debug entries are sent along, and whether that is fewer than there are."""
    cut = (size > LARGE_ANSWER) & (entries > DEBUG_KEPT)
    return F.struct(F.when(cut, DEBUG_KEPT).otherwise(entries).cast("long").alias("n_shown"), cut.alias("truncated"))


def web_item(place: Column, title: Column, source: Column, snippet: Column, url: Column) -> Column:
    """One result of a web search in the context of a model."""
    return F.concat(F.lit("\n"), place.cast("string"), F.lit(". **"), title, F.lit("**\n   Source: "), source, F.lit("\n   Content: "), snippet, F.lit("\n   URL: "), url, F.lit("\n"))


#: What is said where a web search gives nothing.
WEB_UNAVAILABLE = "Web search is currently unavailable. Please try searching for specific cases in our database or rephrase your question."
WEB_UNCONFIGURED = "Web search is not configured. Please check API credentials or try searching for specific cases in our database."
WEB_NOTHING = "I couldn't find current information on that topic. Please try rephrasing your question or asking about specific cases in our database."
WEB_FAILED = "I encountered an error while searching for current information. Please try again later or ask about specific cases in our database."


def web_state(available: Column, configured: Column, failed: Column, results: Column) -> Column:
    """What is said instead of an answer from the web; null where there are results."""
    return F.when(~available, WEB_UNAVAILABLE).when(~configured, WEB_UNCONFIGURED).when(failed, WEB_FAILED).when(results == 0, WEB_NOTHING)


def web_plain(titles: Column, snippets: Column) -> Column:
    """The first three results as an answer without a model."""
    lines = F.transform(F.arrays_zip(F.slice(titles, 1, 3).alias("t"), F.slice(snippets, 1, 3).alias("s")), lambda r, i: F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(". "), r["t"], F.lit("**\nSummary: "), r["s"], F.lit("\n")))
    return F.when(F.size(titles) == 0, "No current information found on this topic.").otherwise(F.concat(F.lit("Based on current web sources, here's what I found:\n\n"), F.array_join(lines, "\n")))


def case_in(text: Column) -> Column:
    """The case that a message names: its number, else a title with two sides set in bold."""
    number = F.coalesce(*(captured(text, p) for p in (r"(?i)G\.R\.\s*No\.?\s*([0-9\-]+)", r"(?i)GR\s*No\.?\s*([0-9\-]+)", r"(?i)G\.R\.\s*([0-9\-]+)")))
    bold = [r"(?i)\*\*([^*]*\s+vs?\.?\s+[^*]+)\*\*", r"(?i)\*\*([^*]*\s+v\.?\s+[^*]+)\*\*", r"(?i)\*\*([A-Z][^*]*(?:vs?\.?|v\.)[^*]*)\*\*"]
    sides = lambda t: F.when(F.lower(t).rlike(r" vs | v\. | v ") & F.length(t).between(11, 199), t)
    title = F.coalesce(*(sides(F.trim(captured(text, p))) for p in bold))
    return F.when(number.isNotNull() | title.isNotNull(), F.struct(number.alias("gr_number"), F.when(number.isNull(), title).alias("case_title")))


def listed_case(place: Column, title: Column, date: Column, number: Column, ponente: Column, case_type: Column) -> Column:
    """One case in the list of a justice's decisions; what is missing is left out."""
    line = lambda label, c: F.concat(F.lit("\n- " + label), first_present(c))
    head = F.concat(F.lit("**"), place.cast("string"), F.lit(". "), title, F.coalesce(F.concat(F.lit(" | "), first_present(date)), F.lit("")), F.lit("**"))
    return F.concat(head, *(F.coalesce(x, F.lit("")) for x in (line("", number), line("Ponente: ", ponente), line("Type: ", F.initcap(case_type)))))


def justice_answer(justice: Column, items: Column, total: Column) -> Column:
    """The decisions of a justice: a heading, the items, and how many there are."""
    found = F.when(total > F.size(items), F.concat(F.lit("*Note: Showing "), F.size(items).cast("string"), F.lit(" of "), total.cast("string"), F.lit(" cases found.*"))).otherwise(F.concat(F.lit("*Found "), total.cast("string"), F.when(total == 1, " case").otherwise(" cases"), F.lit(".*")))
    tip = "\U0001f4a1 **Tip:** You can ask for more details about any specific case by mentioning its name or G.R. number."
    return F.concat(F.lit("## Cases Penned by Justice "), justice, F.lit("\n\n"), F.array_join(F.transform(items, lambda i: F.concat(i, F.lit("\n"))), "\n"), F.lit("\n"), found, F.lit("\n\n" + tip))


def request(body: Column) -> Column:
    """A chat request: whether it is valid, and what holds where it leaves something out."""
    r = F.from_json(body, "query string, history array<struct<role:string,content:string>>, template_mode string")

    def whole(x: Column) -> Column:
        history = F.coalesce(x["history"], F.array().cast("array<struct<role:string,content:string>>"))
        mode = F.coalesce(x["template_mode"], F.lit("full"))
        roles = F.forall(history, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) & m["content"].isNotNull())
        valid = F.coalesce(F.trim(x["query"]) != "", F.lit(False)) & roles & mode.isin("full", "simplified")
        return F.struct(valid.alias("valid"), F.trim(x["query"]).alias("query"), F.size(history).alias("n_history"), mode.alias("template_mode"))

    return let(r, whole)


#: Fixed patterns: what stands apart in a line of rich text: links in bold, links, and bold words.
BOLD_LINK, LINK, BOLD = r"\*\*\[[^\]]+\]\((?:gr:|am:|https?:)[^)]+\)\*\*", r"\[[^\]]+\]\([^)]+\)", r"\*\*[^*]+\*\*"


def spans(text: Column) -> Column:
    """(kind, text, target) of the parts of a rich text in order: links to cases and pages, bold words, and plain text."""
    marked = F.regexp_replace(text, f"({BOLD_LINK}|{LINK}|{BOLD})", "\u0001$1\u0001")

    def part(p: Column) -> Column:
        target = captured(p, r"\[[^\]]+\]\(([^)]+)\)")
        case = captured(target, r"^(?:gr|am):(.+)$")
        kind = F.when(p.rlike(f"^{BOLD_LINK}$") & case.isNotNull(), "case").when(p.rlike(f"^(?:{BOLD_LINK}|{LINK})$"), "link").when(p.rlike(f"^{BOLD}$") & ~F.contains(p, F.lit("[")), "bold").otherwise("plain")
        shown = F.when(kind.isin("case", "link"), captured(p, r"\[([^\]]+)\]")).when(kind == "bold", F.regexp_extract(p, r"^\*\*(.*)\*\*$", 1)).otherwise(p)
        return F.struct(kind.alias("kind"), shown.alias("text"), F.when(kind == "case", case).when(kind == "link", target).alias("target"))

    return F.transform(F.filter(F.split(marked, "\u0001"), lambda p: p != ""), part)


def blocks(text: Column) -> Column:
    """(kind, lines) of a rich text: headings by themselves, lists, and paragraphs, which empty lines part."""
    kind = "array<struct<kind:string,lines:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast("array<string>").alias("open"))

    def closed(acc: Column) -> Column:
        listed = F.forall(acc["open"], lambda x: x.rlike(r"^\s*[-*]\s+"))
        one = F.struct(F.when(listed, "list").otherwise("paragraph").alias("kind"), F.when(listed, F.transform(acc["open"], lambda x: F.regexp_replace(x, r"^\s*[-*]\s+", ""))).otherwise(acc["open"]).alias("lines"))
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(one))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        own = line_kind(line)
        heading = F.concat(closed(acc), F.array(F.struct(F.lit("heading").alias("kind"), F.array(F.regexp_replace(F.trim(line), r"^#{1,3} |^\*\*|\*\*:?$", "")).alias("lines"))))
        done = F.when(own == "heading", heading).when(own == "blank", closed(acc)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(own.isin("heading", "blank"), F.array().cast("array<string>")).otherwise(F.concat(acc["open"], F.array(line))).alias("open"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, closed)


def listing_summary(made: Column, plain: Column) -> Column:
    """A model's summary for a list of cases if it says enough, else the plain one."""
    said = F.trim(made)
    return F.when(F.length(said) > 20, said).otherwise(plain)


def prompt(question: Column, context: Column, system: str) -> Column:
    """What a model is asked: the system's text, the context if there is any, and the question."""
    return F.concat(F.lit(f"System: {system}\n\n"), F.coalesce(F.concat(F.lit("Context: "), first_present(context), F.lit("\n\n")), F.lit("")), F.lit("User: "), question)

"""Queries over case records: fields, sections, chunks, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import classify, extract, rules, text, titles
from docketry.operators import chunks
from docketry.plans.registry import query
from docketry.sources.tables import CASES_SQL, cases, spread, table

CTE = f"WITH RECURSIVE cases AS ({CASES_SQL})"


def _joined(c) -> F.Column:
    return F.array_join(c, "|")


@query(CTE + r""",
    h AS (SELECT doc_id, array_to_string(list_slice(string_split(clean_text, chr(10)), 1, 10), chr(10)) AS head, clean_text FROM cases),
    b AS (SELECT doc_id, regexp_extract_all(head, '(?i)G\.R\.\s+No(?:s)?\.?\s*([0-9][0-9\-*,\s]+)', 1) AS hb,
                 regexp_extract_all(substr(clean_text, 1, 4000), '(?i)G\.R\.\s+No(?:s)?\.?\s*([0-9][0-9\-*,\s]+)', 1) AS tb FROM h),
    p AS (SELECT doc_id, unnest(CASE WHEN len(hb) > 0 THEN hb ELSE tb END) AS block FROM b),
    q AS (SELECT doc_id, unnest(regexp_split_to_array(block, '[,\s]+')) AS n FROM p),
    r AS (SELECT DISTINCT doc_id, regexp_replace(n, '\*+$', '') AS n FROM q WHERE regexp_replace(n, '\*+$', '') <> '')
    SELECT c.doc_id, CAST(count(r.n) AS BIGINT) AS n_numbers, min(CASE WHEN regexp_matches(r.n, '^[0-9]+(-[0-9]+)*$') THEN 'G.R. No. ' || r.n ELSE r.n END) AS gr_number
    FROM cases c LEFT JOIN r USING (doc_id) GROUP BY c.doc_id""")
def gr_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the case."""
    found = cases(spark, folder).select("doc_id", extract.gr_numbers(F.col("clean_text")).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_min("n").alias("gr_number"))


@query(CTE + " SELECT doc_id, 'A.M. No. ' || upper(regexp_extract(clean_text, '(?i)A\\.M\\.\\s+No\\.?\\s*([A-Z0-9\\-]+)', 1)) AS special_number FROM cases WHERE regexp_matches(substr(clean_text, 1, 4000), '(?i)A\\.M\\.\\s+No\\.?\\s*([A-Z0-9\\-]+)')")
def special_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of special cases."""
    found = cases(spark, folder).select("doc_id", F.filter(extract.special_numbers(F.col("clean_text")), lambda n: n.startswith("A.M.")).alias("n")).where(F.size("n") > 0)
    return found.select("doc_id", F.element_at("n", 1).alias("special_number"))


@query(CTE + """ SELECT doc_id, CASE WHEN contains(u, 'EN BANC') THEN 'En Banc' WHEN contains(u, 'FIRST DIVISION') THEN 'First Division'
    WHEN contains(u, 'SECOND DIVISION') THEN 'Second Division' WHEN contains(u, 'THIRD DIVISION') THEN 'Third Division' END AS division,
    CASE WHEN contains(u, 'EN BANC') THEN true WHEN regexp_matches(u, '(FIRST|SECOND|THIRD) DIVISION') THEN false END AS en_banc
    FROM (SELECT doc_id, upper(substr(clean_text, 1, 800)) AS u FROM cases)""")
def division_enbanc(spark: SparkSession, folder: str) -> DataFrame:
    """Division of the court; en_banc is null where none is named."""
    found = cases(spark, folder).select("doc_id", extract.division(F.col("clean_text")).alias("division"))
    return found.withColumn("en_banc", F.col("division") == "En Banc")


@query(CTE + r""" SELECT doc_id, CAST(strftime(strptime(coalesce(
      nullif(regexp_extract(substr(clean_text, 1, 2000), '(?i)\[.*?G\.R\.\s+No\.?\s*\d+.*?,\s*(\w+\s+\d{1,2},\s+\d{4})\s*\]', 1), ''),
      nullif(regexp_extract(substr(clean_text, 1, 2000), '(?i)\[.*?(\w+\s+\d{1,2},\s+\d{4})\s*\]', 1), '')), '%B %-d, %Y'), '%Y-%m-%d') AS VARCHAR) AS promulgation_date FROM cases""")
def promulgation_date(spark: SparkSession, folder: str) -> DataFrame:
    """Date of the decision."""
    return cases(spark, folder).select("doc_id", extract.promulgation_date(F.col("clean_text")).cast("string").alias("promulgation_date"))


@query(CTE + r""", m AS (SELECT doc_id, regexp_extract(substr(clean_text, 1, 5000), '([A-Z][A-Za-z\-'']+(?:\s+[A-Z][A-Za-z\-'']+)*)\s*,\s*(C\.J\.|J\.|JJ\.|CJ\.|CJ|SAJ)\s*[:\.]?', 1) AS n,
      regexp_extract(substr(clean_text, 1, 5000), '([A-Z][A-Za-z\-'']+(?:\s+[A-Z][A-Za-z\-'']+)*)\s*,\s*(C\.J\.|J\.|JJ\.|CJ\.|CJ|SAJ)\s*[:\.]?', 2) AS s FROM cases)
    SELECT doc_id, CASE WHEN n <> '' THEN trim(regexp_replace(n, '(?i)^(?:DECISION\s+|RESOLUTION\s+|D\s*E\s*C\s*I\s*S\s*I\s*O\s*N\s+|R\s*E\s*S\s*O\s*L\s*U\s*T\s*I\s*O\s*N\s+)', '')) || ', ' || s END AS ponente FROM m""")
def ponente(spark: SparkSession, folder: str) -> DataFrame:
    """Justice who wrote the decision."""
    return cases(spark, folder).select("doc_id", extract.ponente(F.col("clean_text")).alias("ponente"))


def _any_sql(c: str, words: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(words)}')"


def _subtype_sql() -> str:
    items = []
    for label, words in rules.SUBTYPES:
        condition = _any_sql("t", words) if words else "g LIKE '%-%'"
        if label == "administrative_matter":
            condition = f"NOT {_any_sql('u', rules.NOT_ADMINISTRATIVE)} AND {condition}"
        if label == "disciplinary_complaint":
            condition = f"NOT {_any_sql('u', rules.NOT_ADMINISTRATIVE)} AND contains(u, 'COMPLAINANT') AND contains(u, 'RESPONDENT')"
        items.append(f"CASE WHEN {condition} THEN '{label}' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


@query(CTE + f""", u AS (SELECT doc_id, upper(case_title) AS u, upper(case_title) || chr(10) || upper(substr(clean_text, 1, 4000)) AS t, gr_number AS g FROM cases),
    s AS (SELECT doc_id, u, t, {_subtype_sql()} AS a FROM u)
    SELECT doc_id, CASE WHEN contains(t, 'A.M.') THEN 'administrative' WHEN {_any_sql("t", rules.CRIMINAL)} THEN 'criminal' ELSE 'civil' END AS case_type,
      array_to_string(CASE WHEN contains(t, 'PETITION') AND NOT list_has_any(a, ['certiorari', 'mandamus', 'prohibition', 'habeas_corpus', 'appeal']) THEN list_append(a, 'petition') ELSE a END, '|') AS case_subtypes FROM s""")
def case_type_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Primary type and subtypes by keyword, in the order of the rules."""
    kinds = classify.case_types(F.col("case_title"), F.col("clean_text"), F.col("gr_number"))
    found = cases(spark, folder).select("doc_id", kinds.alias("k"))
    return found.select("doc_id", "k.case_type", _joined(F.col("k.case_subtypes")).alias("case_subtypes"))


def _section_sql() -> str:
    one = lambda begin, end: f"trim(regexp_extract(clean_text, '(?is)({begin}.*?)(?:{end}|$)', 1), ' ' || chr(10))"
    out = "(SELECT doc_id, 'ruling' AS section, trim(regexp_extract(clean_text, '(?is)(?:WHEREFORE|ACCORDINGLY|IN VIEW OF THE FOREGOING|IN VIEW WHEREOF|THUS|HENCE|PREMISES CONSIDERED).*?SO\\s+ORDERED\\.?', 0)) AS content FROM cases)"
    for name in ("facts", "issues", "arguments"):
        tries = [f"CASE WHEN length({one(b, '|'.join(e))}) > 100 THEN {one(b, '|'.join(e))} END" for n, b, e in extract.MARKERS if n == name]
        out += f" UNION ALL (SELECT doc_id, '{name}', coalesce({', '.join(tries)}, '') FROM cases)"
    return out


SECTION_CTE = CTE + f", parted AS (SELECT * FROM ({_section_sql()}) WHERE content <> ''), sec AS (SELECT * FROM parted UNION ALL SELECT doc_id, 'body', clean_text FROM cases WHERE doc_id NOT IN (SELECT doc_id FROM parted))"


@query(SECTION_CTE + " SELECT doc_id, section, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM sec")
def section_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every case."""
    found = cases(spark, folder).select("doc_id", F.explode(extract.sections(F.col("clean_text"))).alias("s"))
    return found.select("doc_id", "s.section", F.length("s.content").cast("long").alias("n_chars"), F.md5(F.encode("s.content", "utf-8")).alias("digest"))


SPLIT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 10)"


@query(f"SELECT doc_id, CAST(len({SPLIT.format('text')}) AS BIGINT) AS n_sentences, CAST(coalesce(list_sum(list_transform({SPLIT.format('text')}, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM documents")
def sentence_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every document."""
    found = spread(table(spark, folder, "documents")).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("n_chars"))


WINDOWS_SQL = f"""WITH RECURSIVE s AS (SELECT doc_id, list_transform({SPLIT.format('text')}, lambda x: CAST(greatest(1, length(x) // 4) AS INTEGER)) AS tok,
      list_transform({SPLIT.format('text')}, lambda x: CAST(length(x) AS INTEGER)) AS len FROM documents),
    w AS (SELECT doc_id, tok, len, 1 AS lo, 1 AS i, tok[1] AS total, CAST([] AS STRUCT(lo INTEGER, hi INTEGER)[]) AS done FROM s WHERE len(tok) > 0
      UNION ALL
      SELECT doc_id, tok, len, CASE WHEN cut THEN nlo ELSE lo END, i + 1, CASE WHEN cut THEN coalesce(list_sum(list_slice(tok, nlo, i)), 0) + tok[i + 1] ELSE total + tok[i + 1] END,
             CASE WHEN cut THEN list_append(done, {{'lo': lo, 'hi': i}}) ELSE done END
      FROM (SELECT *, total + tok[i + 1] > 640 AS cut,
              i + 1 - CAST(len(list_filter(range(1, i - lo + 2), lambda k: list_sum(list_slice(tok, i - k + 1, i)) <= 96)) AS INTEGER) AS nlo FROM w WHERE i < len(tok))),
    e AS (SELECT doc_id, len, list_append(done, {{'lo': lo, 'hi': i}}) AS done FROM w WHERE i = len(tok)),
    c AS (SELECT doc_id, len, unnest(done) AS r FROM e),
    d AS (SELECT doc_id, list_sum(list_slice(len, r.lo, r.hi)) + r.hi - r.lo AS chars FROM c)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(chars // 4) AS BIGINT) AS n_tokens FROM d WHERE chars // 4 >= 200 GROUP BY doc_id"""


@query(WINDOWS_SQL)
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows of sentences over every document."""
    parts = spread(table(spark, folder, "documents")).select("doc_id", text.sentences(F.col("text")).alias("parts"))
    made = parts.select("doc_id", F.explode_outer(chunks.windows(F.col("parts"))).alias("content")).where("content is not null")
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(text.token_estimate(F.col("content"))).cast("long").alias("n_tokens"))


@query(WINDOWS_SQL.replace("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(chars // 4) AS BIGINT) AS n_tokens FROM d WHERE chars // 4 >= 200 GROUP BY doc_id", "SELECT lang, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(chars // 4) AS BIGINT) AS n_tokens, round(avg(chars // 4), 6) AS avg_tokens, round(count(*) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS chunks_per_case FROM d JOIN documents USING (doc_id) WHERE chars // 4 >= 200 GROUP BY lang"))
def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and their tokens by language, and chunks for each document."""
    # Sentences are a column of their own: windows use them more than once.
    parts = spread(table(spark, folder, "documents")).select("doc_id", "lang", text.sentences(F.col("text")).alias("parts"))
    made = parts.select("doc_id", "lang", F.explode_outer(chunks.windows(F.col("parts"))).alias("content")).where("content is not null")
    n = text.token_estimate(F.col("content"))
    per = made.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("tokens"))
    sums = per.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.sum("tokens").cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("cases"))
    return sums.select("lang", "n_chunks", "n_tokens", F.round(F.col("n_tokens") / F.col("n_chunks"), 6).alias("avg_tokens"), F.round(F.col("n_chunks") / F.col("cases"), 6).alias("chunks_per_case"))


@query("SELECT doc_id, CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS n_tokens FROM documents")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens of every document."""
    return table(spark, folder, "documents").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


@query(SECTION_CTE + """ SELECT section, CAST(count(*) AS BIGINT) AS n_sections, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS n_tokens, round(avg(greatest(1, length(content) // 4)), 6) AS avg_tokens,
    CASE section WHEN 'ruling' THEN 'dispositive' WHEN 'facts' THEN 'factual' WHEN 'issues' THEN 'issues' WHEN 'arguments' THEN 'legal_analysis' ELSE 'general' END AS section_type FROM sec GROUP BY section""")
def chunk_stats_by_section(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and their estimated tokens by name."""
    found = cases(spark, folder).select(F.explode(extract.sections(F.col("clean_text"))).alias("s")).select("s.section", text.token_estimate(F.col("s.content")).alias("n"))
    found = found.groupBy("section").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"))
    return found.withColumn("section_type", extract.section_type(F.col("section")))


def all_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every case, its summary first."""
    return chunks.case_chunks(cases(spark, folder), "doc_id")


RULING_SQL = r"regexp_extract(clean_text, '(?is)(?:WHEREFORE|ACCORDINGLY|IN VIEW OF THE FOREGOING|IN VIEW WHEREOF|THUS|HENCE|PREMISES CONSIDERED).*?SO\s+ORDERED\.?', 0)"
SUMMARY_CTE = CTE + f""", r AS (SELECT *, {RULING_SQL} AS full_ruling FROM cases), f AS (SELECT *, trim(substr(full_ruling, 1, 200)) AS f FROM r),
    p AS (SELECT *, length(f) - instr(reverse(f), ' ') AS cut_at, instr(reverse(f), ' ') AS sp FROM f),
    e AS (SELECT *, CASE WHEN length(full_ruling) > 200 AND sp > 0 AND cut_at > 150 THEN substr(f, 1, cut_at) || '...' ELSE f END AS excerpt FROM p),
    m AS (SELECT *, coalesce(gr_number, special_number, CAST(doc_id AS VARCHAR)) AS case_id, concat_ws('. ', 'Case: ' || case_title, coalesce('G.R. Number: ' || gr_number, 'Special Number: ' || special_number), 'Ponente: ' || ponente, 'Ruling: ' || nullif(excerpt, '')) AS content FROM e)"""


def _uuid5_sql(name: str) -> str:
    """The version-5 identifier of a name."""
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    part = lambda at, n: f"substr({h}, {at}, {n})"
    return f"{part(1, 8)} || '-' || {part(9, 4)} || '-5' || {part(14, 3)} || '-' || translate({part(17, 1)}, '0123456789abcdef', '89ab89ab89ab89ab') || {part(18, 3)} || '-' || {part(21, 12)}"


_MARKS = [(r"\bG\.R\.\s+No\.", "G.R. No.", 1), (r"\bA\.M\.\s+No\.", "A.M. No.", 2), (r"\bU\.S\.", "U.S.", 3), (r"\bPhil\.", "Phil.", 4)]


def _sentences_sql(c: str) -> str:
    """Sentences of more than ten characters; abbreviations are set aside while the text is split."""
    whole = "x"
    for pattern, plain, mark in _MARKS:
        c, whole = f"regexp_replace({c}, '{pattern}', chr({mark}), 'g')", f"replace({whole}, chr({mark}), '{plain}')"
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+([A-Z])', '\1' || chr(5) || '\2', 'g'), chr(5)), lambda x: trim({whole}, ' ' || chr(10) || chr(9))), lambda x: length(x) > 10)"


def _chunks_sql(sections: str) -> str:
    """All chunks (doc_id, case_id, section, ord, n, chunk_type, content, tokens, chunk_index, total_chunks, id) of the sections (doc_id, section, content), after ``SUMMARY_CTE``."""
    return SUMMARY_CTE + f"""{sections},
    cut AS (SELECT *, section IN ('ruling', 'issues') AND length(content) // 4 <= 1200 AS short FROM (SELECT doc_id, section, ord, trim(content, ' ' || chr(10) || chr(9)) AS content FROM told) WHERE content <> ''),
    s AS (SELECT doc_id, section, ord, parts, list_transform(range(1, len(parts) + 1), lambda i: CAST(list_sum(list_transform(list_slice(parts, 1, i), lambda x: greatest(1, length(x) // 4))) AS INTEGER)) AS cum FROM (SELECT doc_id, section, ord, {_sentences_sql('content')} AS parts FROM cut WHERE NOT short) WHERE len(parts) > 0),
    w AS (SELECT doc_id, section, 1 AS lo, 1 AS i, 0 AS ended FROM s UNION ALL
      SELECT doc_id, section, CASE WHEN cut THEN i + 1 - CAST(len(list_filter(range(1, i - lo + 2), lambda k: cum[i] - CASE WHEN i > k THEN cum[i - k] ELSE 0 END <= 96)) AS INTEGER) ELSE lo END, i + 1, CASE WHEN cut THEN lo ELSE 0 END
      FROM (SELECT *, cum[i + 1] - CASE WHEN lo > 1 THEN cum[lo - 1] ELSE 0 END > 640 AS cut FROM w JOIN s USING (doc_id, section) WHERE i < len(cum))),
    pieces AS (SELECT doc_id, section, ended AS lo, i - 1 AS hi FROM w WHERE ended > 0 UNION ALL SELECT doc_id, section, lo, i FROM w JOIN s USING (doc_id, section) WHERE i = len(cum)),
    texts AS (SELECT doc_id, section, ord, 0 AS lo, content FROM cut WHERE short UNION ALL SELECT doc_id, section, ord, lo, array_to_string(list_slice(parts, lo, hi), ' ') FROM pieces JOIN s USING (doc_id, section)),
    kept AS (SELECT doc_id, section, ord, content, row_number() OVER (PARTITION BY doc_id, section ORDER BY lo) - 1 AS n FROM texts WHERE lo = 0 OR length(content) // 4 >= 200),
    listed AS (SELECT doc_id, 'summary' AS section, 0 AS ord, 0 AS n, 'summary' AS chunk_type, content FROM m UNION ALL SELECT doc_id, section, ord, n, 'content', content FROM kept),
    placed AS (SELECT l.*, m.case_id, CAST(CASE WHEN length(l.content) = 0 THEN 0 ELSE greatest(1, length(l.content) // 4) END AS INTEGER) AS tokens, CAST(row_number() OVER (PARTITION BY l.doc_id ORDER BY ord, n) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY l.doc_id) AS INTEGER) AS total_chunks FROM listed l JOIN m USING (doc_id)),
    chunked AS (SELECT *, {_uuid5_sql("case_id || CASE chunk_type WHEN 'summary' THEN '_summary' ELSE '_' || section || '_' || n END")} AS id,
      CASE WHEN chunk_type = 'summary' THEN 'mini_summary' ELSE CASE section WHEN 'ruling' THEN 'dispositive' WHEN 'facts' THEN 'factual' WHEN 'issues' THEN 'issues' WHEN 'arguments' THEN 'legal_analysis' ELSE 'general' END END AS section_type FROM placed)"""


#: Chunks of the sections that are found in the texts.
CHUNKS_SQL = _chunks_sql(SECTION_CTE[len(CTE) :] + ", told AS (SELECT *, list_position(['ruling', 'facts', 'issues', 'arguments', 'body'], section) AS ord FROM sec)")
_CHUNK_ROWS = " SELECT doc_id, id, section, section_type, CAST(n AS INTEGER) AS paragraph_index, tokens AS token_count, md5(content) AS digest, chunk_index, total_chunks FROM chunked"
#: Sections that records bring along: every third case brings none, every third a ruling and an empty list of issues, the others texts under names of their own.
SUPPLIED_SQL = """SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN map(['Ruling', 'ISSUES', 'Facts'], ['  ' || substr(clean_text, 1, 900) || chr(10), ' ', clean_text]) WHEN 2 THEN map(['Discussion', 'Issues'], [clean_text || ' ', substr(clean_text, 1, 400)]) END AS sections FROM cases"""


def _digested(made: DataFrame) -> DataFrame:
    return made.select("doc_id", F.col("chunk_id").alias("id"), "section", "section_type", "paragraph_index", "token_count", F.md5(F.encode("content", "utf-8")).alias("digest"), "chunk_index", "total_chunks")


@query(CHUNKS_SQL + _CHUNK_ROWS)
def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every case with identifiers and places."""
    return _digested(all_chunks(spark, folder))


@query(_chunks_sql(SECTION_CTE[len(CTE) :] + f""", given AS (SELECT doc_id, lower(e.key) AS section, e.value AS content, n AS ord FROM (SELECT doc_id, unnest(map_entries(sections)) AS e, generate_subscripts(map_entries(sections), 1) AS n FROM ({SUPPLIED_SQL}))),
    told AS (SELECT doc_id, section, content, ord FROM given UNION ALL SELECT *, list_position(['ruling', 'facts', 'issues', 'arguments', 'body'], section) FROM sec WHERE doc_id NOT IN (SELECT doc_id FROM given))""").replace("WHEN 'arguments' THEN 'legal_analysis'", "WHEN 'arguments' THEN 'legal_analysis' WHEN 'discussion' THEN 'legal_analysis'") + _CHUNK_ROWS)
def supplied_section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of cases that bring sections along, and of those that bring none."""
    c, k = F.col("clean_text"), F.col("doc_id") % 3
    ruling = F.create_map(F.lit("Ruling"), F.concat(F.lit("  "), F.substring(c, 1, 900), F.lit("\n")), F.lit("ISSUES"), F.lit(" "), F.lit("Facts"), c)
    own = F.create_map(F.lit("Discussion"), F.concat(c, F.lit(" ")), F.lit("Issues"), F.substring(c, 1, 400))
    return _digested(chunks.case_chunks(cases(spark, folder).withColumn("sections", F.when(k == 1, ruling).when(k == 2, own)), "doc_id"))


@query(SUMMARY_CTE + " SELECT doc_id, case_id, content, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS content_preview, CAST(greatest(1, length(content) // 4) AS INTEGER) AS token_count, CAST(0 AS INTEGER) AS chunk_index, 'mini_summary' AS section_type FROM m")
def summary_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of every case, which says what the case is and how it ended."""
    made = all_chunks(spark, folder).where("chunk_type = 'summary'")
    return made.select("doc_id", "case_id", "content", "content_preview", "token_count", "chunk_index", "section_type")


@query(CHUNKS_SQL + """ SELECT c.content, section, section_type, chunk_type, CAST(n AS INTEGER) AS paragraph_index, tokens AS token_count, c.case_id, coalesce(gr_number, '') AS gr_number, coalesce(special_number, '') AS special_number, case_title AS title, '' AS date,
    coalesce(ponente, '') AS ponente, '' AS division, false AS en_banc, '' AS source_url, CAST(coalesce(promulgation_year, 0) AS INTEGER) AS promulgation_year, false AS is_administrative, chunk_index, total_chunks, 'v2.0' AS chunk_version, CAST(1700000000 AS BIGINT) AS processed_timestamp,
    'rule_based_fallback' AS classification_method, CAST(0 AS DOUBLE) AS classification_confidence, id FROM chunked c JOIN m USING (doc_id)""")
def point_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What goes into an index with every chunk of every case, in all fields but the empty map of scores."""
    made = chunks.payload(all_chunks(spark, folder), F.timestamp_seconds(F.lit(1700000000)))
    return made.select("id", "payload.*").drop("case_type_classification")


_CONTEXT = "CASE section_type " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in extract.CONTEXTS.items() if k != "general") + f" ELSE '{extract.CONTEXTS['general']}' END"


@query(CHUNKS_SQL + f""" SELECT {_CONTEXT} || ' ' || c.content AS content, c.content AS original_content, section, section_type, coalesce(gr_number, '') AS gr_number, coalesce(special_number, '') AS special_number,
    case_title AS title, coalesce(ponente, '') AS ponente, '' AS case_type, '' AS date, chunk_type, tokens AS token_count, true AS contextual, id AS stable_id FROM chunked c JOIN m USING (doc_id)""")
def contextual_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What goes into a contextual index with every chunk of every case."""
    return chunks.contextual_payload(all_chunks(spark, folder), extract.context_of(F.col("section_type"))).select("payload.*")


@query(CTE + " SELECT doc_id, sha256(k) AS stable_id, 'sha256:' || sha256(clean_text) AS checksum, md5(clean_text || '|' || substr(clean_text, 1, 500)) AS chunk_hash FROM (SELECT doc_id, clean_text, coalesce(gr_number, '') || '|' || coalesce(special_number, '') || '|body|general|0|' || substr(sha256(clean_text), 1, 16) AS k FROM cases)")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers that depend on content alone."""
    c = F.col("clean_text")
    key = F.concat_ws("|", F.coalesce("gr_number", F.lit("")), F.coalesce("special_number", F.lit("")), F.lit("body"), F.lit("general"), F.lit("0"), F.substring(F.sha2(c, 256), 1, 16))
    return cases(spark, folder).select("doc_id", F.sha2(key, 256).alias("stable_id"), text.tagged_sha256(c).alias("checksum"), F.md5(F.encode(F.concat(c, F.lit("|"), F.substring(c, 1, 500)), "utf-8")).alias("chunk_hash"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
    FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_body_0')) AS h FROM documents)""")
def chunk_uuid(spark: SparkSession, folder: str) -> DataFrame:
    """Version-5 identifiers."""
    return table(spark, folder, "documents").select("doc_id", chunks.chunk_id(F.col("doc_id").cast("string"), F.lit("body"), F.lit(0)).alias("chunk_id"))


@query(SECTION_CTE + f""" SELECT doc_id, section, md5(CASE section {' '.join(f"WHEN '{s}' THEN '{extract.CONTEXTS[k].replace(chr(39), chr(39) * 2)}'" for s, k in (('ruling', 'dispositive'), ('facts', 'factual'), ('issues', 'issues'), ('arguments', 'legal_analysis')))} ELSE '{extract.CONTEXTS['general']}' END || ' ' || content) AS digest FROM sec""")
def context_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with the sentence that says what they are."""
    found = cases(spark, folder).select("doc_id", F.explode(extract.sections(F.col("clean_text"))).alias("s"))
    full = F.concat(extract.context_of(extract.section_type(F.col("s.section"))), F.lit(" "), F.col("s.content"))
    return found.select("doc_id", "s.section", F.md5(F.encode(full, "utf-8")).alias("digest"))


@query(CTE + r""", r AS (SELECT doc_id, regexp_extract(clean_text, '(?is)(?:WHEREFORE|ACCORDINGLY|IN VIEW OF THE FOREGOING|IN VIEW WHEREOF|THUS|HENCE|PREMISES CONSIDERED).*?SO\s+ORDERED\.?', 0) AS full_ruling FROM cases),
    f AS (SELECT doc_id, full_ruling, trim(substr(full_ruling, 1, 200)) AS f FROM r),
    p AS (SELECT *, length(f) - instr(reverse(f), ' ') AS cut_at, instr(reverse(f), ' ') AS sp FROM f)
    SELECT doc_id, CASE WHEN length(full_ruling) > 200 AND sp > 0 AND cut_at > 150 THEN substr(f, 1, cut_at) || '...' ELSE f END AS excerpt FROM p""")
def dispositive_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """Beginning of the ruling."""
    return cases(spark, folder).select("doc_id", extract.dispositive_excerpt(F.col("clean_text")).alias("excerpt"))


@query(CTE + " SELECT doc_id, concat_ws('. ', 'Case: ' || case_title, coalesce('G.R. Number: ' || gr_number, 'Special Number: ' || special_number), 'Ponente: ' || ponente) AS summary FROM cases")
def mini_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A line that identifies the case; what is missing is left out."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    return cases(spark, folder).select("doc_id", F.concat_ws(". ", label("Case", "case_title"), F.coalesce(label("G.R. Number", "gr_number"), label("Special Number", "special_number")), label("Ponente", "ponente")).alias("summary"))


@query(SECTION_CTE + """ SELECT c.doc_id, bool_or(s.section = 'ruling') AS has_ruling, CAST(any_value(length(c.clean_text)) AS BIGINT) AS text_length, CAST(count(*) FILTER (s.section <> 'body') AS BIGINT) AS sections_extracted,
    count(*) FILTER (s.section <> 'body') > 0 AS has_structured_sections FROM cases c JOIN sec s USING (doc_id) GROUP BY c.doc_id""")
def quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What the extraction of each case yielded."""
    found = cases(spark, folder).withColumn("s", F.transform(extract.sections(F.col("clean_text")), lambda s: s["section"]))
    n = F.size(F.filter("s", lambda x: x != "body"))
    return found.select("doc_id", F.array_contains("s", "ruling").alias("has_ruling"), F.length("clean_text").cast("long").alias("text_length"), n.cast("long").alias("sections_extracted"), (n > 0).alias("has_structured_sections"))


@query(CTE + r""", l AS (SELECT doc_id, list_slice(string_split(clean_text, chr(10)), 1, 21) AS l FROM cases),
    p AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(upper(x), 'DECISION|RESOLUTION|ORDER')), true) AS stop FROM l)
    SELECT doc_id, md5(trim(array_to_string(CASE WHEN stop > 0 THEN list_slice(l, 1, stop - 1) ELSE l END, chr(10)))) AS digest FROM p""")
def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines above the decision."""
    return cases(spark, folder).select("doc_id", F.md5(F.encode(extract.header_block(F.col("clean_text")), "utf-8")).alias("digest"))


_NORMAL = ["'\\r\\n?', chr(10)", "'\\n{3,}', chr(10) || chr(10)", "',[ \\t]*\\n', ', '", "';[ \\t]*\\n', '; '", "'([A-Za-z0-9_])[ \\t]*\\n[ \\t]*([A-Za-z0-9_])', '\\1 \\2'", "'([A-Za-z0-9_])[ \\t]*\\n[ \\t]*([A-Za-z0-9_])', '\\1 \\2'", "'[ \\t]{2,}', ' '", "'\\s+\\n', chr(10)", "'\\n\\s+', chr(10)"]


def _normal_sql(c: str) -> str:
    for step in _NORMAL:
        c = f"regexp_replace({c}, {step}, 'g')"
    return f"trim({c}, ' ' || chr(10) || chr(9))"


@query(CTE + f" SELECT doc_id, md5({_normal_sql('clean_text')}) AS digest FROM cases")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with white space and broken lines put in order."""
    return cases(spark, folder).select("doc_id", F.md5(F.encode(text.normalized(F.col("clean_text")), "utf-8")).alias("digest"))


@query(CTE + """, g AS (SELECT doc_id, clean_text, regexp_extract(clean_text, '\\[[^\\n]*?G\\.R\\.\\s+No\\.?\\s*\\d+[^\\n]*?\\]', 0) AS m FROM cases),
    b AS (SELECT doc_id, CASE WHEN m <> '' THEN substr(clean_text, strpos(clean_text, m)) ELSE clean_text END AS t FROM g)
    SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(upper(x), '^(A|A\\+|HOME)$')), chr(10))) AS digest FROM b""")
def website_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Texts from the bracketed number on, without navigation."""
    return cases(spark, folder).select("doc_id", F.md5(F.encode(text.without_site_lines(F.col("clean_text")), "utf-8")).alias("digest"))


@query(CTE + """, g AS (SELECT doc_id, clean_text, regexp_extract(clean_text, '\\[[^\\n]*?G\\.R\\.\\s+No\\.?\\s*\\d+[^\\n]*?\\]', 0) AS m FROM cases),
    b AS (SELECT doc_id, CASE WHEN m <> '' THEN substr(clean_text, strpos(clean_text, m)) ELSE clean_text END AS t FROM g)
    SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) || chr(10) || 'the end') AS digest FROM b""")
def website_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in the site's frame without it: its parts go wherever they stand, and lines that mention its navigation."""
    before = "Supreme Court E-Library x\n y Information At Your Fingertips\nToggle posts A A+ A++\nSee also Korea, South and the site map\n"
    after = "\nCONTACT: Supreme Court of the Philippines\nMalaysia (632) 524-2706\nlibraryservices.sc@judiciary.gov.ph\n12 Phil. 3\nthe end\n\u00a9 2019 E-Library"
    framed = F.concat(F.lit(before), F.col("clean_text"), F.lit(after))
    return cases(spark, folder).select("doc_id", F.md5(F.encode(text.without_site_lines(framed, compat=True), "utf-8")).alias("digest"))


@query(CTE + """, d AS (SELECT doc_id, promulgation_year, CASE doc_id % 4 WHEN 0 THEN CAST(1998 + doc_id % 25 AS VARCHAR) || '-01-31' WHEN 1 THEN 'undated' WHEN 2 THEN '' END AS date FROM cases),
    y AS (SELECT doc_id, coalesce(promulgation_year, TRY_CAST(CASE WHEN regexp_matches(date, '^[0-9]{4}') THEN substr(date, 1, 4) END AS INTEGER)) AS year FROM d)
    SELECT doc_id FROM y WHERE year IS NULL OR year BETWEEN 2005 AND 2015""")
def year_filter_unknown_passes(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of some years, by the year or the beginning of the date; those of unknown year pass."""
    four = F.when(F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") % 25 + 1998).cast("string"), F.lit("-01-31"))).when(F.col("doc_id") % 4 == 1, "undated").when(F.col("doc_id") % 4 == 2, "")
    return cases(spark, folder).withColumn("date", four).where(extract.within_years(F.col("promulgation_year"), F.col("date"), 2005, 2015)).select("doc_id")


@query("SELECT doc_id, length(text) >= 500 AS indexable, length(text) >= 100 AS classifiable FROM documents")
def minimum_content(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents are long enough to index and to classify."""
    n = F.length("text")
    return table(spark, folder, "documents").select("doc_id", (n >= 500).alias("indexable"), (n >= 100).alias("classifiable"))


@query(CTE + """, t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'EN BANC ' || case_title WHEN 1 THEN case_title || ' v. Others' ELSE case_title END AS t FROM cases)
    SELECT doc_id, length(t) BETWEEN 10 AND 3000 AND NOT regexp_matches(upper(t), 'EN BANC|(FIRST|SECOND|THIRD) DIVISION|PER CURIAM|REPUBLIC OF THE PHILIPPINES|SUPREME COURT') AND (regexp_matches(lower(t), '\\bv\\.\\b|\\bvs\\b|\\bvs\\.\\b|\\b versus \\b') OR contains(t, 'People of the Philippines')) AS title_like FROM t""")
def title_like(spark: SparkSession, folder: str) -> DataFrame:
    """Which titles look like captions."""
    t = F.col("case_title")
    varied = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("EN BANC "), t)).when(F.col("doc_id") % 5 == 1, F.concat(t, F.lit(" v. Others"))).otherwise(t)
    return cases(spark, folder).select("doc_id", titles.title_like(varied).alias("title_like"))


def _subject_sql() -> str:
    rows = ", ".join(f"('{s}', {k}, '{w}')" for k, (s, ws) in enumerate(rules.SUBJECTS.items()) for w in ws)
    return f"(VALUES {rows}) AS k(subject, rank, keyword)"


SUBJECT_CTE = CTE + f""", low AS (SELECT doc_id, lower(case_title || ' ' || clean_text) AS t FROM cases),
    sc AS (SELECT doc_id, subject, rank, CAST(sum(len(regexp_extract_all(t, '\\b' || keyword || '\\b'))) AS BIGINT) AS score FROM low, {_subject_sql()} WHERE contains(t, keyword) GROUP BY ALL HAVING score > 0)"""


def _subject_scores(spark: SparkSession, folder: str) -> DataFrame:
    counts = classify.subject_counts(F.concat_ws(" ", "case_title", "clean_text"))
    return cases(spark, folder).select("doc_id", F.explode(counts).alias("s")).select("doc_id", "s.*").where("score > 0")


@query(SUBJECT_CTE + " SELECT doc_id, subject, score FROM sc")
def subject_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword counts by subject."""
    return _subject_scores(spark, folder).select("doc_id", "subject", "score")


@query(SUBJECT_CTE + """, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM sc)
    SELECT doc_id, min(CASE WHEN place = 1 THEN subject END) AS primary_subject, CAST(count(*) FILTER (place > 1 AND score >= 0.5 * best) AS BIGINT) AS n_secondary,
    CASE WHEN max(best) >= 10 THEN 'high' WHEN max(best) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM m GROUP BY doc_id""")
def subject_primary_secondary(spark: SparkSession, folder: str) -> DataFrame:
    """Best subject, how many come near it, and how sure that is."""
    by = Window.partitionBy("doc_id")
    placed = _subject_scores(spark, folder).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "rank"))).withColumn("best", F.max("score").over(by))
    sure = F.when(F.max("best") >= 10, "high").when(F.max("best") >= 5, "medium").otherwise("low")
    return placed.groupBy("doc_id").agg(F.min(F.when(F.col("place") == 1, F.col("subject"))).alias("primary_subject"), F.count_if((F.col("place") > 1) & (F.col("score") >= 0.5 * F.col("best"))).alias("n_secondary"), sure.alias("confidence"))


@query(CTE + " SELECT doc_id, trim(regexp_replace(regexp_replace(replace(case_title, 'PEOPLE OF THE PHILIPPINES', ''), '[,\\s]*$', ''), '\\s+', ' ', 'g')) AS title, upper(substr(lang, 1, 1)) || lang AS tag FROM cases")
def title_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Titles without noise and trailing marks."""
    plain = F.regexp_replace(F.regexp_replace(F.replace("case_title", F.lit("PEOPLE OF THE PHILIPPINES"), F.lit("")), r"[,\s]*$", ""), r"\s+", " ")
    return cases(spark, folder).select("doc_id", F.trim(plain).alias("title"), F.concat(F.upper(F.substring("lang", 1, 1)), F.col("lang")).alias("tag"))


@query(CTE + r""" SELECT doc_id, CASE WHEN gr_number IS NULL THEN '(' || ')' ELSE '**[' || gr_number || '](gr:' || regexp_extract(gr_number, 'G\.R\.\s+No\.\s+([0-9\-]+)', 1) || ')**' END AS link, coalesce('G.R. No. ' || nullif(regexp_extract(gr_number, '(?i)G\.R\.?\s*No\.?\s*([0-9\-]+)', 1), ''), 'Unknown') AS shown FROM cases""")
def case_number_link(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as links and as shown."""
    return cases(spark, folder).select("doc_id", extract.number_link(F.col("gr_number")).alias("link"), extract.display_number(F.col("gr_number")).alias("shown"))


@query(CTE + r""", s AS (SELECT doc_id, ponente, list_slice(list_filter(list_transform(string_split(trim(replace(clean_text, chr(10), ' ')), '.'), lambda x: trim(x)), lambda x: length(x) > 50), 1, 3) AS s FROM cases),
    f AS (SELECT doc_id, ponente, list_slice(list_filter(s, lambda x: NOT regexp_matches(lower(x), 'g\.r\. no\.|petitioner|respondent|supreme court')), 1, 2) AS f FROM s)
    SELECT doc_id, array_to_string(list_transform(f, lambda x: x || '.') || CASE WHEN ponente IS NULL THEN [] ELSE ['The decision was penned by Justice ' || ponente || '.'] END, ' ') AS summary FROM f""")
def simple_case_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Two sentences of the text that say more than who is who, and the justice."""
    long = F.filter(F.transform(F.split(F.trim(F.replace("clean_text", F.lit("\n"), F.lit(" "))), r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 50)
    told = F.slice(F.filter(F.slice(long, 1, 3), lambda x: ~F.lower(x).rlike(r"g\.r\. no\.|petitioner|respondent|supreme court")), 1, 2)
    by = F.when(F.col("ponente").isNotNull(), F.array(F.concat(F.lit("The decision was penned by Justice "), F.col("ponente"), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    return cases(spark, folder).select("doc_id", F.array_join(F.concat(F.transform(told, lambda x: F.concat(x, F.lit("."))), by), " ").alias("summary"))

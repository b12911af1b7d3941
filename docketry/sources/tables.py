"""Tables of a folder, and the view of documents as case records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns are pruned and filters pushed by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes up to which a table counts as small, however many cores there are.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A scan of a small table, dealt out to all cores; any other scan as it is.

    A small file may be one row group, which one task reads: what is costly in
    each row would run on one core. A large table has splits for all cores, and
    is never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= min(SMALL, cores * split) else df


#: Documents as case records with a header, a caption and their whole texts, every third in sections. Both SQL dialects read it.
CASES_SQL = """
SELECT doc_id,
  concat(
    CASE doc_id % 4 WHEN 0 THEN 'EN BANC' WHEN 1 THEN 'FIRST DIVISION' WHEN 2 THEN 'SECOND DIVISION' ELSE 'THIRD DIVISION' END, chr(10),
    CASE WHEN doc_id % 5 = 3 THEN concat('[ A.M. No. P-', 10 + doc_id % 13, '-', 2900 + doc_id)
         WHEN doc_id % 7 = 2 THEN concat('[ G.R. Nos. ', 100000 + doc_id, '-', 10 + doc_id % 80)
         ELSE concat('[ G.R. No. ', 100000 + doc_id) END,
    ', ', CASE doc_id % 3 WHEN 0 THEN 'June' WHEN 1 THEN 'January' ELSE 'October' END, ' ', 1 + doc_id % 28, ', ', 2003 + doc_id % 20, ' ]', chr(10),
    CASE doc_id % 6 WHEN 0 THEN 'PEOPLE OF THE PHILIPPINES, PLAINTIFF, VS. JUAN CRUZ ' WHEN 1 THEN 'MARIA REYES, PETITIONER, VS. COURT OF APPEALS '
      WHEN 2 THEN 'ACME CORPORATION, PETITIONER, VS. NLRC ' WHEN 3 THEN 'PEDRO SANTOS, COMPLAINANT, VS. JUDGE LIM '
      WHEN 4 THEN 'IN RE: PETITION FOR ADOPTION OF ANA ' ELSE 'BIR, PETITIONER, VS. DELTA CO. ' END, doc_id % 50, ', RESPONDENT.', chr(10),
    'D E C I S I O N', chr(10),
    CASE doc_id % 5 WHEN 0 THEN 'PERALTA, J.:' WHEN 1 THEN 'LAZARO-JAVIER, J.:' WHEN 2 THEN 'GESMUNDO, C.J.:' WHEN 3 THEN 'PER CURIAM:' ELSE 'DELA CRUZ, J.:' END, chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('THE FACTS', chr(10), substr(text, 1, CAST(floor(length(text) / 3) AS INT)), chr(10), 'THE ISSUE', chr(10), substr(text, CAST(floor(length(text) / 3) AS INT) + 1, CAST(floor(length(text) / 3) AS INT)), chr(10), 'THE RULING', chr(10), substr(text, 2 * CAST(floor(length(text) / 3) AS INT) + 1), chr(10)) ELSE concat(text, chr(10)) END,
    CASE WHEN doc_id % 2 = 0 THEN concat('WHEREFORE, the petition is GRANTED. ', substr(text, 1, 180), ' SO ORDERED.') ELSE 'Costs against petitioner.' END
  ) AS clean_text,
  CASE doc_id % 6 WHEN 0 THEN concat('PEOPLE OF THE PHILIPPINES, PLAINTIFF, VS. JUAN CRUZ ', doc_id % 50) WHEN 1 THEN concat('MARIA REYES, PETITIONER, VS. COURT OF APPEALS ', doc_id % 50)
    WHEN 2 THEN concat('ACME CORPORATION, PETITIONER, VS. NLRC ', doc_id % 50) WHEN 3 THEN concat('PEDRO SANTOS, COMPLAINANT, VS. JUDGE LIM ', doc_id % 50)
    WHEN 4 THEN concat('IN RE: PETITION FOR ADOPTION OF ANA ', doc_id % 50) ELSE concat('BIR, PETITIONER, VS. DELTA CO. ', doc_id % 50) END AS case_title,
  CASE WHEN doc_id % 5 = 3 THEN NULL WHEN doc_id % 7 = 2 THEN concat('G.R. No. ', 100000 + doc_id, '-', 10 + doc_id % 80) ELSE concat('G.R. No. ', 100000 + doc_id) END AS gr_number,
  CASE WHEN doc_id % 5 = 3 THEN concat('A.M. No. P-', 10 + doc_id % 13, '-', 2900 + doc_id) END AS special_number,
  CASE doc_id % 5 WHEN 0 THEN 'PERALTA, J.' WHEN 1 THEN 'LAZARO-JAVIER, J.' WHEN 2 THEN 'GESMUNDO, C.J.' WHEN 4 THEN 'DELA CRUZ, J.' END AS ponente,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 2003 + doc_id % 20 END AS promulgation_year,
  lang, source
FROM documents
"""


#: Messages as questions of all kinds: what is asked for varies with the message, and every third asks its whole text. Both SQL dialects read it.
QUESTIONS_SQL = """
SELECT conv_id, turn, CASE (conv_id + turn) % 12
    WHEN 0 THEN concat('cases penned by justice ', CASE conv_id % 3 WHEN 0 THEN 'Peralta' WHEN 1 THEN 'Lazaro-Javier' ELSE 'Gesmundo' END)
    WHEN 1 THEN concat('Acme Corporation vs NLRC ', conv_id % 60) WHEN 2 THEN concat('G.R. No. 0', 100000 + conv_id, ' digest') WHEN 3 THEN concat('A.M. No. P-', 10 + conv_id % 13, '-', 2900 + conv_id, ' ruling')
    WHEN 4 THEN concat('what is ', CASE conv_id % 4 WHEN 0 THEN 'amparo' WHEN 1 THEN 'Swindling' WHEN 2 THEN 'rule 65' ELSE role END) WHEN 5 THEN concat('the facts and issues of GR No. ', 100000 + conv_id)
    WHEN 6 THEN 'justice Lazaro-Javier decisions' WHEN 7 THEN concat('annulment cases ', 150000 + conv_id) WHEN 8 THEN concat('what was held by Philippine courts on ', role)
    ELSE text END AS query
FROM conversations
"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of a folder as questions (conv_id, turn, query)."""
    return spark.sql(QUESTIONS_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, folder, "conversations"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder as case records."""
    return spark.sql(CASES_SQL.replace("FROM documents", "FROM {documents}"), documents=spread(table(spark, folder, "documents")))

"""One row of each group of near duplicates."""

import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(60))


def test_a_row_that_occurs_twice_stays_once(spark, tmp_path):
    data = [(1, passage(1)), (1, passage(1)), (2, passage(2)), (None, passage(3)), (None, passage(3)), (None, passage(2)), (4, passage(4)), (4, passage(5)), (6, passage(1)), (7, passage(4))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in data], COLUMNS)
    near, repeats = (dict(corpus_pipeline.STAGES)[k] for k in ("simhash near-dedup", "suffix-array dedup"))
    one = spark.createDataFrame(near(spark, docs, str(tmp_path)).collect(), docs.schema)
    expected = sorted([(1, passage(1)), (2, passage(2)), (0, passage(3)), (4, passage(4)), (4, passage(5))])
    assert sorted((r.doc_id or 0, r.text) for r in one.collect()) == expected
    assert sorted((r.doc_id or 0, r.text) for r in repeats(spark, one, str(tmp_path)).collect()) == expected

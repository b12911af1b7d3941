"""Line dedup and repeated strings against plain versions."""

import random

import numpy as np
import pytest
from plain import dedup_lines, near_lines, without_repeats

from docketry.llm import linededup, runindex


def documents(pick, n=60):
    words = [f"w{k}" for k in range(25)] + ["été", "日本"]
    pool = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 12))) for _ in range(40)]
    texts = []
    for _ in range(n):
        lines = [pick.choice(pool) for _ in range(pick.randint(0, 5))]
        for k, line in enumerate(lines):
            parts = line.split()
            if parts and pick.random() < 0.5:
                at = pick.randrange(len(parts))
                kind = pick.choice(["swap", "drop", "add"])
                parts[at : at + 1] = {"swap": ["new"], "drop": [], "add": ["more", parts[at]]}[kind]
                lines[k] = "  ".join(parts)
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(spark, seed):
    texts = [*documents(random.Random(seed)), None, "", "\n\n", "x " * 3000 + "end", "x " * 3000 + "fin"]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, line int, n_lines int")
    expected = dedup_lines(list(enumerate(texts)))
    got = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k].text == (None if text is None else "\n".join(expected[k]))
        assert got[k].n_lines == (0 if text is None else text.count("\n") + 1)
        assert got[k].n_lines - got[k].n_removed == len(expected[k])


def test_lines_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f\nq"), (2, "a b c d e f\nq"), (7, "a b c d e x\nz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in linededup.dedup(df).collect())
    assert got == [(0, "a b c d e f", 0), (2, "a b c d e f\nq", 0), (2, "a b c d e f\nq", 0), (7, "z", 1)]
    assert linededup.dedup(df.where("false")).count() == 0
    assert {r.doc_id for r in linededup.keep(spark.createDataFrame([(1, "one two"), (2, "one two"), (3, " ")], "doc_id long, text string")).collect()} == {1, 3}


def test_lines_of_rows_that_share_an_id(spark):
    line = "one line of several words"
    rows = [(1, line), (2, line + "\nq"), (2, "a wholly different first line here\nr"), (2, None), (2, "")]
    got = {(r.doc_id, r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, line), (2, "q"), (2, "a wholly different first line here\nr"), (2, None), (2, "")}


def test_lines_whose_letters_or_words_form_a_thue_morse_sequence(spark):
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    texts = ["".join("ab"[b] for b in bits[:2048]), "".join("ba"[b] for b in bits[:2048]), " ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits)]
    got = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == {k: (t, 0) for k, t in enumerate(texts)}


def test_lines_that_differ_in_blanks_alone_are_equal(spark):
    texts = ["a b c", "  a\tb\r c \x0b", "a b  c", "a bc"]
    got = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {0: "a b c", 1: "", 2: "", 3: "a bc"}


def test_columns_with_the_names_of_the_operator(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, [1], "x"), (2, "a b c d f", 6, None, "y")], "doc_id long, text string, h1 int, _ld_id array<int>, KEPT string")
    assert [(r.h1, r._ld_id, r.KEPT, r.text) for r in linededup.keep(df).collect()] == [(5, [1], "x", "a b c d e")]


def test_one_edit():
    for a, b in [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("a b", "b a"), ("", "a"), ("a b c d", "a c b d"), ("a", "a b c")]:
        a, b = a.split(), b.split()
        assert linededup.within_one(a, b) == near_lines(a, b, 0)


def repeated_texts(seed, n=60):
    pick = random.Random(seed)
    passages = ["".join(pick.choice("abcde fé") for _ in range(pick.randint(150, 600))) for _ in range(6)]
    texts = []
    for _ in range(n):
        own = "".join(pick.choice("abcdefgh ") for _ in range(pick.randint(0, 300)))
        for _ in range(pick.randint(0, 2)):
            p = pick.choice(passages)
            a, b = sorted(pick.randrange(len(p)) for _ in range(2))
            own += p[a:b] + "".join(pick.choice("xyz") for _ in range(pick.randint(0, 20)))
        texts.append(own)
    return [*texts, None, "", "ab" * 400, "z" * 1000, texts[3], texts[3], "q" * 199]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    texts = repeated_texts(seed)
    df = spark.createDataFrame([(k, t, "clash", 3) for k, t in enumerate(texts)], "doc_id long, text string, spans string, kept int")
    got = {r.doc_id: r for r in runindex.remove(df).collect()}
    for k, (kept, removed, runs) in enumerate(without_repeats(texts)):
        assert (bytes(got[k].kept), got[k].n_removed, got[k].n_spans, got[k].n_bytes) == (kept, removed, runs, len((texts[k] or "").encode()))
        assert got[k].text == (None if texts[k] is None else kept.decode(errors="ignore"))


def test_repeats_across_blocks_of_a_hot_sample(spark, monkeypatch):
    monkeypatch.setattr(runindex, "BLOCK_LEAST", 16)
    monkeypatch.setattr(runindex, "BLOCK", 16)
    pick = random.Random(4)
    hot = "".join(pick.choice("klmnop ") for _ in range(260))
    texts = ["".join(pick.choice("abcdefgh ") for _ in range(pick.randint(1, 90))) + hot[pick.randint(0, 30) : 260 - pick.randint(0, 30)] + str(k) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in runindex.remove(df).collect()}
    assert got == dict(enumerate(without_repeats(texts)))


def test_repeats_of_odd_tables(spark):
    long = "".join(random.Random(9).choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([(None, long), (1, long + "!"), (1, "short"), (5, "tail")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in runindex.remove(df).collect())
    assert got == [(0, ""), (1, "!"), (1, "short"), (5, "tail")]
    assert sorted(r.text for r in runindex.keep(df).collect()) == ["!", "short", "tail"]
    assert runindex.remove(df.where("false")).count() == 0


def test_run_index_against_all_pairs():
    pick = random.Random(6)
    strings = [bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 60))) for _ in range(30)] + [b"abab" * 20, b"abab" * 20]
    index = runindex.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))))
    for least in (3, 10, 25):
        marked = [np.zeros(len(s), bool) for s in strings]
        for k, a, b in zip(*index.matches(least)):
            marked[k][a:b] = True
        seen = {}
        for k, s in enumerate(strings):
            for i in range(len(s) - least + 1):
                seen.setdefault(s[i : i + least], []).append((k, i))
        expected = [np.zeros(len(s), bool) for s in strings]
        for places in seen.values():
            if len(places) > 1:
                for k, i in places:
                    expected[k][i : i + least] = True
        assert all((a == b).all() for a, b in zip(marked, expected))
    assert len(index.heads) < index.n


def test_long_texts_cross_pieces(monkeypatch):
    monkeypatch.setattr(runindex, "PIECE", 300)
    text = ("abcdefghij" * 10 + "".join(random.Random(1).choice("xyz ") for _ in range(2000))).encode()
    row, key, digest, start, end = runindex.contexts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50, 16)
    windows = sorted(w for a, b in zip(start, end) for w in range(a, b - 50 + 1))
    assert windows == list(range(len(text) - 49))

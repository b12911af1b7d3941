"""BPE and packing against the tokenizers library."""

import json
import os
import random
import subprocess
import sys
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import bpe, packing, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello world", "  spaces   and\ttabs\n\n", "don't we'll I'm", "naïve façade 日本語 🎉", "a" * 300, "=-=-" * 90, "x<|endoftext|>y <|endoftext|>", "the the the", "1234567890 12 3", "\x00\x01 end ", "Hello world"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, ids string, id long")


def test_words_follow_the_merges(library):
    coder = bpe.TrieEncoder(vocab.read(PATH))
    pick = random.Random(5)
    alphabet = "abcdehilnorst ABé\n.,'0 "
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 80))) for _ in range(1500)]
    coded = coder.encode_batch(texts)
    for text, ids in zip(texts, coded):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text


def test_encode_and_decode_rows(spark, library):
    coded = bpe.encode(rows(spark), PATH, decode=True)
    got = {r.doc_id: r for r in coded.collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False)
    back = {r.doc_id: r.decoded for r in bpe.decode(coded.drop("decoded"), PATH).collect()}
    assert back == {k: r.decoded for k, r in got.items()}


def test_decoding_broken_bytes():
    coder = bpe.TrieEncoder(vocab.read(PATH))
    half = coder.encode_batch(["日"])[0][:4]
    assert "�" in coder.decode(half)


def test_empty_table(spark):
    assert bpe.encode(rows(spark).where("false"), PATH).count() == 0
    assert packing.pack_documents(rows(spark).where("false"), PATH).count() == 0


def test_pack_is_whole_and_balanced():
    pick = np.random.default_rng(3)
    for lengths in ([1], [1024], [1025, 3], [5000, 1, 1, 700], pick.integers(1, 3000, 400)):
        out = packing.pack(np.array(lengths))
        used, docs = defaultdict(list), defaultdict(list)
        for doc, start, length, number, offset in out.tolist():
            used[number].append((offset, length))
            docs[doc].append((start, length))
        for pieces in [*used.values(), *docs.values()]:
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
        assert all(sum(n for _, n in p) <= 1024 for p in used.values())
        assert [sum(n for _, n in docs[k]) for k in range(len(lengths))] == list(lengths)
        assert len(used) == -(-sum(lengths) // 1024)


def test_costs_are_level():
    lengths = np.array([600] * 40 + [100] * 160)
    out = packing.pack(lengths)
    cost = defaultdict(float)
    for _, _, length, number, _ in out.tolist():
        cost[number] += packing.LINEAR * length + packing.QUADRATIC * length**2
    full = sorted(cost.values())[1:]
    assert max(full) <= 1.25 * min(full)


def test_pack_documents(spark, library):
    texts = [*TEXTS, "many words here " * 2000]
    got = packing.pack_documents(rows(spark, texts), PATH, window=3000).collect()
    docs, used = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids)
        assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        docs[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(range(len(texts)))
    for pieces in [*docs.values(), *used.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length


def test_ids_may_be_null_or_repeat(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c d"), (1, "c d")], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).where(F.col("start") == 0).count() == 3
    assert bpe.encode(df, PATH).count() == 3


def test_a_word_of_a_million_letters_needs_little_memory():
    code = f"""
import random, resource
import numpy as np
from tokenizers import Tokenizer
from docketry.llm import bpe, vocab
coder = bpe.TrieEncoder(vocab.read({PATH!r}))
pick = random.Random(1)
word = "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = coder.encode_batch([word])[0]
grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
assert grown < 300 << 10, grown
assert word not in coder.known
assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file({PATH!r}).encode(word, add_special_tokens=False).ids
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})


def test_special_tokens_need_no_certain_sign(tmp_path):
    stored = json.loads(Path(PATH).read_text())
    stored["added_tokens"].append({**stored["added_tokens"][0], "id": len(stored["model"]["vocab"]) + 1, "content": "[stop]"})
    own = tmp_path / "own.json"
    own.write_text(json.dumps(stored))
    ids = bpe.TrieEncoder(vocab.read(str(own))).encode_batch(["a[stop]b"])[0]
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(str(own)).encode("a[stop]b", add_special_tokens=False).ids


def test_texts_longer_than_a_window_and_equal_ones(spark, library):
    long = " ".join(f"word{k % 97}" for k in range(4000))
    texts = [long, "same text", "same text", "same text", long, "", "x"]
    got = packing.pack_documents(rows(spark, texts).coalesce(1), PATH, window=300).collect()
    pieces, used = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids)))
        used[r.sequence_id] += r.length
    for k, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(b for _, _, b in sorted(pieces[k])), "<u4").tolist() == ids
    assert max(used.values()) <= 1024 and sum(used.values()) == sum(n for p in pieces.values() for _, n, _ in p)


N = 1_000_000
LONG = {"blanks": "a" + " " * N + "b", "breaks": "\n" * N, "mixed": "x" + "\n \t" * (N // 3) + "y", "letter": "a" * N, "within": "one " + "a" * N + " two", "dashes": "-" * N, "special": "<|endoftext|>" + " " * N + "<|endoftext|>"}


@pytest.mark.parametrize("name", sorted(LONG))
def test_runs_of_a_million(library, name):
    """Neither encoder fails on long runs, and the trie's needs some seconds of CPU at most for a million bytes."""
    text, content = LONG[name], vocab.read(PATH)
    expected = library.encode(text, add_special_tokens=False).ids
    assert packing.ids_of(packing.tokenizer(content), text).tolist() == [*expected, 0]
    coder = bpe.encoder(content)
    began = time.process_time()
    ids = coder.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert time.process_time() - began < 12


def test_long_runs_in_rows(spark, library):
    texts = [LONG["blanks"], "in between", LONG["breaks"], None]
    got = defaultdict(dict)
    for r in packing.pack_documents(rows(spark, texts), PATH).collect():
        got[r.doc_id][r.start] = r.ids
    for k, text in enumerate(texts):
        ids = b"".join(got[k][at] for at in sorted(got[k]))
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]

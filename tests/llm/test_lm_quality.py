"""Language model against plain counting, classifier by held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import lm, ordinal, storage


def plain_discounts(counts):
    by = Counter(counts)
    n1, n2, n3, n4 = (by[k] for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def plain_scores(texts, held, order):
    """Modified Kneser-Ney by plain counting, with ``order - 1`` start marks."""
    docs = [[*(t or "").encode().lower().split(), None] for t in texts]
    padded = [["<"] * (order - 1) + d for d in docs]
    words, counts = Counter(), Counter()
    for k, (d, p) in enumerate(zip(docs, padded)):
        if not held(k):
            words.update(d)
            counts.update(tuple(p[i : i + order]) for i in range(len(d)))
    n, v = sum(words.values()), len(words)
    levels = {order: counts}
    for size in range(order - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    cuts = {size: plain_discounts(c.values()) for size, c in levels.items()}
    after = {size: defaultdict(list) for size in levels}
    for size, c in levels.items():
        for g, m in c.items():
            after[size][g[:-1]].append(m)

    def cut(size, m):
        return cuts[size][min(m, 3) - 1] if m else 0

    def p(gram):
        size = len(gram)
        seen = after[size].get(gram[:-1])
        if size == 1:
            free = sum(cut(1, m) for m in seen) / sum(seen) if seen else 1.0
            return free / (v + 1) + (max(levels[1][gram] - cut(1, levels[1][gram]), 0) / sum(seen) if seen else 0)
        if not seen:
            return p(gram[1:])
        m = levels[size][gram]
        return max(m - cut(size, m), 0) / sum(seen) + sum(cut(size, x) for x in seen) / sum(seen) * p(gram[1:])

    return [
        (len(d), sum(w in words for w in d), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in d), sum(math.log10(p(tuple(q[i : i + order]))) for i in range(len(d))))
        for d, q in zip(docs, padded)
    ]


@pytest.mark.parametrize("order, hot, bits, wide", [(3, 8, 64, 16), (3, 10**6, 0, 0), (2, 8, 64, 2), (4, 100, 20, 16)])
def test_scores(spark, monkeypatch, order, hot, bits, wide):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "KEY_BITS", bits)
    monkeypatch.setattr(lm, "WIDE", wide)
    monkeypatch.setattr(lm, "SHARD_WORDS", 64)
    monkeypatch.setattr(lm, "HELD", 4000)
    pick = random.Random(3)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "The"]
    texts = [" ".join(pick.choices(vocabulary, weights=[1 / (k + 1) for k in range(202)], k=pick.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "\n \t", "never seen words", "THE the The", texts[0], texts[0], "w1 " * 3000]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in lm.score_held_out(df, order=order).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    for k, (n, known, train, base, score) in enumerate(plain_scores(texts, held, order)):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_model_is_a_distribution(spark):
    model = lm.fit(spark.createDataFrame([("a b a c",), ("b b a",)], "text string"))
    p = model.word_probability(np.array([-1, *range(model.words.distinct)]))
    assert p.sum() == pytest.approx(1)


def test_words_of_one_pattern_are_different():
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    words = lm.token_hashes(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))[0]
    assert len(set(words.tolist())) == 3


def test_arrays_of_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    for values in (np.arange(5, dtype="u1"), np.array([], dtype="i8"), np.array([1 << 40])):
        storage.save(str(tmp_path / "x"), values)
        mounted = storage.load(str(tmp_path / "x"))
        with monkeypatch.context() as m:
            m.setattr(storage, "is_local", lambda path: False)
            for found in (mounted, storage.load(str(tmp_path / "x"))):
                assert found.dtype == values.dtype and found.tolist() == values.tolist()
    assert [lm.narrow(np.array([k])).dtype.itemsize for k in (255, 256, 1 << 16, 1 << 32)] == [1, 2, 4, 8]


def test_empty_tables(spark):
    df = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert lm.score_held_out(df.where("false")).count() == 0
    only = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm.score_held_out(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0 and math.isfinite(row.score)


RUDE = ["grobian", "lout", "oaf"]


def texts(n, seed):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(pick.choice("abcdefg") for _ in range(pick.randint(2, 7))) for _ in range(pick.randint(20, 80))]
        grade = pick.choice([0, 1, 2, 2, 2])
        if grade == 1:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), pick.choice(RUDE) + pick.choice("abcd"))
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        out.append((k, " ".join(words), grade))
    return out


def test_held_out_accuracy(spark):
    data = texts(2000, 1)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in data], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in data if k % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.classify(docs, labels).collect()}
    unseen = [(k, g) for k, _, g in data if k % 2 == 0]
    assert np.mean([got[k].kept == (g == 2) for k, g in unseen]) > 0.97
    for k, g in unseen:
        assert 0 <= got[k].tail_probability <= 1 and got[k].tail_probability <= got[k].expected_grade <= 2
    means = [np.mean([got[k].expected_grade for k, g in unseen if g == grade]) for grade in range(3)]
    assert means == sorted(means)
    kept = {r.doc_id for r in ordinal.keep(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if r.kept}


def plain_fit(sets, grade, grades):
    """The classifier's fit in plain Python, with slopes by differences of the likelihood."""
    n = len(grade)
    names = sorted({f for s in sets for f in s})
    known = []
    for f in names:
        rows = [k for k, s in enumerate(sets) if f in s]
        far = 0.0
        for t in range(grades - 1):
            share = sum(g > t for g in grade) / n
            spread = math.sqrt(max(len(rows) * share * (1 - share) * (1 - len(rows) / n), 1e-9))
            far = max(far, abs(sum(grade[k] > t for k in rows) - len(rows) * share) / spread)
        if len(rows) >= ordinal.LEAST_TEXTS and far >= ordinal.SIGNAL:
            known.append(f)
    size = len(known)
    shares = [min(max(sum(g > t for g in grade) / n, 1e-3), 1 - 1e-3) for t in range(grades - 1)]
    first = [-math.log(s / (1 - s)) for s in shares]
    free = [0.0] * size + first[:1] + [math.log(max(b - a, 1e-3)) for a, b in zip(first, first[1:])]

    def thresholds(x):
        out = [x[size]]
        for gap in x[size + 1 :]:
            out.append(out[-1] + math.exp(gap))
        return out

    def loss(x):
        theta, total = thresholds(x), 0.0
        for s, g in zip(sets, grade):
            score = sum(x[k] for k, f in enumerate(known) if f in s)
            above = [1.0, *(1 / (1 + math.exp(t - score)) for t in theta), 0.0]
            total -= math.log(max(above[g] - above[g + 1], 1e-12))
        return total / n + ordinal.PENALTY * sum(w * w for w in x[:size])

    mean, square = [0.0] * len(free), [0.0] * len(free)
    for step in range(1, ordinal.STEPS + 1):
        slope = []
        for k in range(len(free)):
            up, down = free[:], free[:]
            up[k] += 1e-5
            down[k] -= 1e-5
            slope.append((loss(up) - loss(down)) / 2e-5)
        mean = [0.9 * a + 0.1 * b for a, b in zip(mean, slope)]
        square = [0.99 * a + 0.01 * b * b for a, b in zip(square, slope)]
        rate = ordinal.RATE * min(1.0, 2 * (1 - step / (ordinal.STEPS + 1)))
        free = [x - rate * (m / (1 - 0.9**step)) / (math.sqrt(q / (1 - 0.99**step)) + 1e-10) for x, m, q in zip(free, mean, square)]
        free[:size] = [math.copysign(max(abs(x) - rate * ordinal.SPARSITY, 0), x) for x in free[:size]]
    return known, free[:size], thresholds(free)


def test_fit_against_a_plain_one():
    pick = random.Random(11)
    grade, sets = [], []
    for _ in range(160):
        g = pick.choice([0, 1, 2, 2])
        own = {100 + pick.randrange(12)}
        if pick.random() < 0.9:
            own.add(1 + g)
        if g and pick.random() < 0.6:
            own.add(7)
        grade.append(g)
        sets.append(sorted(own))
    model = ordinal.fit(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), np.array(grade), 3)
    known, weights, thresholds = plain_fit([set(s) for s in sets], grade, 3)
    assert model.known.tolist() == known and len(known) >= 3
    assert model.weights == pytest.approx(weights, abs=2e-3) and model.thresholds == pytest.approx(thresholds, abs=2e-3)
    for s in sets[:40]:
        score = sum(w for f, w in zip(known, weights) if f in s)
        above = model.above(model.score(np.zeros(len(s), dtype=np.int64), np.array(s), 1))[0]
        assert above == pytest.approx([1 / (1 + math.exp(t - score)) for t in thresholds], abs=2e-3)


def test_one_text_of_a_rated_id_trains(spark):
    docs = spark.createDataFrame([(1, t) for t in ("a", "b", "c")] * 3 + [(2, "x y")] * 4 + [(3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels.select("doc_id", ordinal.rating().alias("grade")), 3, rows=2)
    assert len(model.thresholds) == 2 and ordinal.classify(docs, labels).count() == 14


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, ""), (3, "word " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert ordinal.classify(docs, labels).count() == 5
        assert ordinal.classify(docs.where("false"), labels).count() == 0
    assert all(r.kept for r in ordinal.classify(docs, none).collect())

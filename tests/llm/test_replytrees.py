"""Reply trees: branches, their order, the format and what is read back."""

import random

from pyspark.sql import functions as F

from docketry.llm import replytrees

COLUMNS = "tree long, id string, parent string, role string, text string, score double, formatted string, leaf long"


def made(spark, data, **more):
    rows = [(*r, *[None] * (6 - len(r)), "clash", 9) for r in data]
    return replytrees.format_branches(spark.createDataFrame(rows, COLUMNS), score="score", **more)


def read(df):
    """(tree, leaf): rank, score, turns, texts under the mask."""
    loss = replytrees.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans"))
    out = df.select("*", replytrees.read_turns(F.col("formatted")).alias("said"), loss.alias("loss")).collect()
    for r in out:
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert [bool(x) for x in spans] == [t.role == "assistant" and t.text != "" for t in r.said]
        assert [r.formatted[a:].startswith(replytrees.OPEN) for a in r.turn_starts] == [True] * r.n_turns
    return {(r.tree, r.leaf): (r["rank"], r.branch_score, [(t.role, t.text) for t in r.said], r.loss) for r in out}


def plain(data, keep):
    """Branches by a walk from every leaf."""
    out = {}
    by_tree = {}
    for tree, name, parent, role, text, score in data:
        by_tree.setdefault(tree, {})[name] = (parent, role, text, score or 0.0)
    for tree, known in by_tree.items():
        found = []
        inner = {p for p, *_ in known.values()}
        for leaf in known:
            if leaf in inner:
                continue
            walk, at = [], leaf
            while at in known:
                walk.append(known[at])
                at = known[at][0]
            found.append((-sum(w[3] for w in walk), leaf, [(w[1], w[2]) for w in reversed(walk)]))
        for n, (score, leaf, turns) in enumerate(sorted(found)[:keep]):
            out[tree, leaf] = (n + 1, -score, turns, "".join(t for r, t in turns if r == "assistant"))
    return out


def test_random_trees(spark):
    pick = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|im_start|>", "\\", "\\\\n", "<s>", "é", "日本", "\n", " a", "<", "<\\|im_end|>", "🎉"]
    data = []
    for tree in range(6):
        for n in range(40):
            parent = None if n == 0 or pick.random() < 0.05 else f"m{pick.randint(max(0, n - 6), n - 1):02d}"
            data.append((tree, f"m{n:02d}", parent, pick.choice(["user", "assistant", "a\\n\nb", "system\n\n"]), "".join(pick.choices(bits, k=pick.randint(0, 8))), pick.randint(0, 5) * 1.0))
    for keep in (1, 3, 100):
        assert read(made(spark, data, keep=keep)) == plain(data, keep)


def test_long_chain(spark):
    data = [(1, f"{n:04d}", f"{n - 1:04d}" if n else None, "user" if n % 2 else "assistant", str(n), 0.0) for n in range(300)]
    assert read(made(spark, data)) == plain(data, 1)


def test_defined_cases(spark):
    data = [
        (1, "a", None, None, None, None), (1, "b", "a", "assistant", "", 1.0), (1, "c", "a", "assistant", "yes", 1.0),  # equal scores: the smaller leaf
        (None, "a", None, "user", "no tree", None), (None, "b", "a", "assistant", "still", None),
        (2, None, "x", "user", "no id", None), (2, "x", "gone", "user", "orphan", None),
        (3, "p", "q", "user", "circle", None), (3, "q", "p", "user", "circle", None), (3, "r", "q", "user", "below", None), (3, "s", "s", "user", "own parent", None),
        (4, "d", None, "user", "twice", None), (4, "d", None, "user", "twice", None), (4, "d", None, "assistant", "same id", None),
        (5, "l", None, "assistant", "x" * 300_000 + "</s>", None),
    ]
    got = read(made(spark, data))
    assert got == {
        (1, "b"): (1, 1.0, [("", ""), ("assistant", "")], ""),
        (None, "b"): (1, 0.0, [("user", "no tree"), ("assistant", "still")], "still"),
        (2, None): (1, 0.0, [("user", "orphan"), ("user", "no id")], ""),
        (4, "d"): (1, 0.0, [("assistant", "same id"), ("user", "twice"), ("user", "twice")], "same id"),
        (5, "l"): (1, 0.0, [("assistant", "x" * 300_000 + "</s>")], "x" * 300_000 + "</s>"),
    }
    assert made(spark, []).count() == 0


def test_conversations(spark):
    rows = [(1, 5, "assistant", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, "system", None), (None, 0, None, "x"), (2, 0, "user", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {k[0]: v[2:] for k, v in read(replytrees.format_conversations(df)).items()}
    assert got == {1: ([("system", ""), ("user", "a"), ("user", "a"), ("assistant", "b")], "b"), None: ([("", "x")], ""), 2: ([("user", "</s>[INST] ok [/INST]")], "")}
    for r in replytrees.format_conversations(df).collect():
        for mark in replytrees.CONTROL[2:]:
            assert mark not in r.formatted
        assert r.formatted.count(replytrees.OPEN) == r.formatted.count(replytrees.CLOSE) == r.n_turns


def test_no_python_runs_on_executors(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").cache()
    df.count()
    plan = replytrees.format_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan

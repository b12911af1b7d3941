"""Conversations out of reply trees: paths by iterative self-joins, branches by score, one text for each.

A tree's messages point to the message they reply to. Rounds of self-joins
double how far each message sees up its own path, so a path of n messages takes
log2(n) rounds; they carry ids and scores, never texts. A branch is the path
from a root to a leaf and scores the sum of its messages. The best branches of
each tree are kept, their messages listed by the same jumps taken in turn, and
only then do the texts join them.

A message becomes ``OPEN role newline text CLOSE newline``. Control strings
inside a role or text are broken by a backslash after their first character,
and backslashes are doubled, so that no text can open or close a turn and
``unescape`` gives each back as it was.

Defined cases: a null text or role counts as empty; a null score as zero; rows
without a tree form one tree; nothing replies to a message without an id; a
parent that the tree lacks makes a root; messages that lie on or below a circle
of parents have no root and are in no path. Rows that share tree and id, or
have a tree and no id, stand together at one place, by role and text, and the
smallest parent and greatest score of them count. Branches of one score go by
their leaves' ids, the smallest first. Further columns are ignored, whatever
their names; an empty table gives an empty result. One branch is one row of
the result, so its text must fit in a row.

Everything is column expressions and joins; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that a model may take for marks; none of them is left whole inside a text.
CONTROL = [OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]"]
#: The role whose texts are learned.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """The text without any whole control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _escaped_role(role: Column) -> Column:
    """A role on one line; a line break is a backslash and an n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role(escaped: Column) -> Column:
    return unescape(F.regexp_replace(escaped, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted_turn(role: Column, text: Column) -> Column:
    """One turn with its marks."""
    return F.concat(F.lit(OPEN), _escaped_role(role), F.lit("\n"), escape(text), F.lit(f"{CLOSE}\n"))


# ---------------------------------------------------------------- paths


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps of 1, 2, 4, ... messages, and each message's whole path in sum.

    ``nodes`` has (tree, id, parent, score), one row for each tree and id. A
    round joins the jumps with themselves: who sees k messages up the path, and
    whose last one sees k further, sees 2k. The second table has (tree, id,
    total, depth) of the messages whose path has a root.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    rooted = nodes.join(known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_id")), "left")
    now = common.cut(rooted.select("tree", "id", F.col("_id").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "jumps")
    steps = [now]
    n, left = now.agg(F.count(F.lit(1)), F.count("up")).first()
    reach = 1
    while left and reach <= n:  # what is left beyond that goes in circles
        far = now.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        met = now.where("up is not null").join(far, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_id")))
        moved = met.select("tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("depth") + F.col("_depth")).alias("depth"))
        now = common.cut(moved.union(now.where("up is null")), "jumps")
        steps.append(now)
        left, reach = now.where("up is not null").count(), reach * 2
    return steps, now.where("up is null").select("tree", "id", "total", "depth")


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, id, place) of every message on the ``keep`` best branches of each tree.

    ``place`` counts from the root, from 1. The result is a table of ids in the shared folder.
    """
    spark = nodes.sparkSession
    steps, whole = jumps(nodes)
    inner = steps[0].where("up is not null").select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).distinct()
    leaves = whole.join(inner, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.asc("id"))
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    now = chosen.select("tree", F.col("id").alias("leaf"), "rank", F.col("total").alias("branch_score"), "id", F.col("depth").alias("place"))
    # The farthest jumps first: each distance is the sum of powers of two in one way, so each message is met once.
    for k in range(len(steps) - 1, -1, -1):
        step = steps[k].where("up is not null").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"))
        further = now.join(step, F.col("tree").eqNullSafe(F.col("_tree")) & F.col("id").eqNullSafe(F.col("_id")))
        both = now.union(further.select("tree", "leaf", "rank", "branch_score", F.col("_up").alias("id"), (F.col("place") - (1 << k)).alias("place")))
        before, now = now, common.cut(both, "paths")
        if hasattr(before, "cut_path"):
            common.forget(spark, before.cut_path)
    for step in steps:
        common.forget(spark, step.cut_path)
    return now


# ---------------------------------------------------------------- format


def _format(nodes: DataFrame, texts: DataFrame, keep: int, learned: str) -> DataFrame:
    """Branches of ``nodes`` (tree, id, parent, score) with the ``texts`` (tree, id, role, text) of their messages."""
    common.scratch(texts.sparkSession)
    placed = paths(nodes, keep).select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "leaf", "rank", "branch_score", "place")
    turns = texts.join(placed, F.col("tree").eqNullSafe(F.col("_tree")) & F.col("id").eqNullSafe(F.col("_id")))
    piece = formatted_turn(F.col("role"), F.col("text"))
    turns = turns.withColumn("piece", piece).withColumn("length", F.length("piece").cast("long"))
    order = Window.partitionBy("tree", "leaf").orderBy("place", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("length")
    # A turn's own text stands between the line of its role and the closing mark with a line break.
    first, last = start + F.length(_escaped_role(F.col("role"))) + len(OPEN) + 1, F.col("end") - len(CLOSE) - 1
    is_learned = F.col("role") == learned
    span = F.struct(F.when(is_learned, first).otherwise(start).alias("start"), F.when(is_learned, last).otherwise(start).alias("end"))
    told = turns.select("tree", "leaf", "rank", "branch_score", F.struct("n", "piece", start.alias("start"), span.alias("span")).alias("turn"))
    out = told.groupBy("tree", "leaf").agg(F.max("rank").alias("rank"), F.max("branch_score").alias("branch_score"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return out.select("tree", "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), F.col("turns.start").alias("turn_starts"), F.col("turns.span").alias("loss_spans"))


def format_branches(messages: DataFrame, tree: str = "tree", id: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, keep: int = 1, learned: str = LEARNED) -> DataFrame:
    """One row for each of the ``keep`` best branches of every tree of messages.

    Columns: tree, leaf, rank, branch_score, n_turns, ``formatted``, and for
    each turn in order ``turn_starts`` and ``loss_spans``, as numbers of code
    points of ``formatted``: the span of a turn of role ``learned`` is its
    escaped text, that of any other is empty.
    """
    own = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    nodes = messages.select(F.col(tree).alias("tree"), F.col(id).alias("id"), F.col(parent).alias("parent"), own.alias("score"))
    nodes = nodes.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    return _format(nodes, messages.select(F.col(tree).alias("tree"), F.col(id).alias("id"), _filled(role).alias("role"), _filled(text).alias("text")), keep, learned)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED) -> DataFrame:
    """``format_branches`` of conversations given as rows by turn: each turn replies to the one before.

    A message's id follows from its row alone: turn, role and a digest of the
    text, in this order, a null turn first. Equal rows share an id, so they
    stand together and each is a turn.
    """
    at = F.struct(F.col(turn).isNotNull().alias("given"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), _filled(role).alias("role"), F.xxhash64(_filled(text)).alias("digest"))
    texts = rows.select(F.col(conv).alias("tree"), at.alias("id"), _filled(role).alias("role"), _filled(text).alias("text"))
    before = F.lag("id").over(Window.partitionBy("tree").orderBy("id"))
    nodes = texts.select("tree", "id").distinct().select("tree", "id", before.alias("parent"), F.lit(0.0).alias("score"))
    return _format(nodes, texts, 1, learned)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- reading back


def _bodies(formatted: Column) -> Column:
    return F.filter(F.split(formatted, rf"\Q{CLOSE}\E\n"), lambda body: body != "")


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted text, in order, unescaped."""

    def turn(body: Column) -> Column:
        line = F.instr(body, F.lit("\n"))
        return F.struct(_role(F.substr(body, F.lit(len(OPEN) + 1), line - len(OPEN) - 1)).alias("role"), unescape(F.substr(body, line + 1)).alias("text"))

    return F.transform(_bodies(formatted), turn)


def read_loss(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined. Each span is cut out of its own turn, so the text is read once."""

    def cut(body: Column, n: Column) -> Column:
        span = F.get(loss_spans, n)
        return unescape(F.substr(body, (span["start"] - F.get(turn_starts, n) + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return F.array_join(F.transform(_bodies(formatted), cut), "")


def digest_turns(formatted: Column) -> Column:
    """What the turns say as one text: role, line break, text, line break for each."""
    return F.array_join(F.transform(read_turns(formatted), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

"""Exact top-k lexical search in three phases over postings that are partitioned by term.

Every term of the questions has a list of (document, part), greatest part
first; a document's score for a question is the sum of weight times part over
the question's terms. The three-phase uniform threshold scheme finds the k best
without reading the lists in full for every question:

1. The heads, the first k entries of every list, give sums that are lower
   bounds; the k-th best of them is a question's first bound.
2. A question of m terms fetches from each list whatever is worth an m-th of
   the bound. A document that is in none of these falls short of the bound, so
   it is out. The fetched entries give a second, higher bound, and only
   documents whose sum could still reach it, with the most that each list may
   hold unfetched, stay as candidates.
3. The rest of the candidates' entries is looked up, which makes scores exact.

Questions are taken in blocks of bounded size; what of a block goes to workers
is bounded by that. An entry that several questions fetch is shuffled once, to
its document. Lists are dealt by ranges of term, part and document, so that a
word that all documents have is many tasks.

Defined cases: a null text has no terms, nor has one without letters and
digits; such documents count nowhere and such questions have no result. Each
row is a document or a question of its own, also where it repeats another; rows
of one id are told apart by where they stand. A null document id comes last in
ties. Further columns are ignored, whatever their names; an empty table on
either side gives an empty result. Parts and scores are 64-bit integers, and
equal scores go by the smaller document id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

RESULTS = 50
#: Terms of questions, each counted for every question that has it, that a block takes.
BLOCK = 1_000_000
#: Cells of a table of documents by questions that a worker sums at a time.
CELLS = 1 << 21

#: Bytes that part terms: all of ASCII but letters and digits.
GAP = np.ones(256, dtype=bool)
GAP[ord("0") : ord("9") + 1] = GAP[ord("A") : ord("Z") + 1] = GAP[ord("a") : ord("z") + 1] = GAP[128:] = False


# ---------------------------------------------------------------- terms


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each term, and the number of terms by row."""
    data, offsets = common.utf8(batch.column("text"))
    data = common.LOWER[data]
    return data, *common.tokens_of(data, offsets, GAP)


def _eights(data: np.ndarray) -> np.ndarray:
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


class Vocabulary:
    """The terms of a block of questions, found among words by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        size = np.array([len(t) for t in terms], dtype=np.int64)
        end = np.cumsum(size)
        hashes = common.word_hashes(self.data, end - size, end)
        self.ids = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.ids]
        self.start, self.size = (end - size)[self.ids], size[self.ids]
        _, runs = np.unique(self.hashes, return_counts=True)
        self.most = int(runs.max(initial=0))

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The term's number for each word, or -1."""
        out = np.full(len(start), -1, dtype=np.int64)
        if not self.most:
            return out
        hashes = common.word_hashes(data, start, end)
        first = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):  # more than one only if terms of the questions share a hash
            at = np.minimum(first + k, len(self.hashes) - 1)
            live = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == end - start) & (out < 0))
            live = live[self._same(data, start[live], at[live])]
            out[live] = self.ids[at[live]]
        return out

    def _same(self, data: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which words have the bytes of the terms that stand at ``at``."""
        size, same = self.size[at], np.ones(len(start), dtype=bool)
        own, theirs = _eights(data), _eights(self.data)
        live = np.flatnonzero(size <= common.SHORT)
        for step in range(0, common.SHORT, 8):
            live = live[size[live] > step]
            if not len(live):
                break
            bits = np.minimum(size[live] - step, 8).astype(np.uint64) * np.uint64(8)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
            same[live] &= (own[start[live] + step] & mask) == (theirs[self.start[at[live]] + step] & mask)
        for k in np.flatnonzero(size > common.SHORT):
            same[k] = np.array_equal(data[start[k] : start[k] + size[k]], self.data[self.start[at[k]] : self.start[at[k]] + size[k]])
        return same


def question_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(question, item_id, term) of the distinct terms of every question; ``question`` numbers the rows."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in common.parts(batches, "text"):
            data, start, end, counts = _terms(batch)
            raw = data.tobytes()
            owner = np.repeat(np.arange(len(counts)), counts).tolist()
            found = sorted({(o, raw[a:b]) for o, a, b in zip(owner, start.tolist(), end.tolist())})
            rows = np.array([o for o, _ in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows + at), batch.column("id").take(pa.array(rows)), pa.array([t for _, t in found], pa.binary())], ["question", "item_id", "term"])
            at += len(batch)

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "question long, item_id long, term binary")


def postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, tf, n, doc_id): one row with term -1 and its id for each document that has terms, and its counts of the vocabulary's.

    ``doc`` numbers the rows and ``n`` counts all terms of the document, with repeats.
    """

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        width = max(1, len(vocabulary.ids))
        for batch in common.parts(batches, "text"):
            data, start, end, counts = _terms(batch)
            term = vocabulary.find(data, start, end)
            met = np.flatnonzero(term >= 0)
            owner = np.repeat(np.arange(len(counts)), counts)
            keys, tf = np.unique(owner[met] * width + term[met], return_counts=True)
            some = np.flatnonzero(counts)
            rows = np.concatenate([some, keys // width])
            n = len(some)
            columns = [np.concatenate([np.full(n, -1), keys % width]).astype(np.int32), rows + at, np.concatenate([np.zeros(n, np.int64), tf]), counts[rows]]
            ids = pa.concat_arrays([batch.column("id").take(pa.array(some)), pa.nulls(len(keys), pa.int64())])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids], ["term", "doc", "tf", "n", "doc_id"])
            at += len(batch)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "term int, doc long, tf long, n long, doc_id long")


# ---------------------------------------------------------------- lists


def weight(n: int, df: int) -> int:
    """What a term is worth by how many of ``n`` documents have it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lists_of(held: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """(term, part, doc, head): the lists, each by descending part within its ranges; ``head`` marks the first ``k`` of a range."""
    length = f"(50L + (50L * n * {documents}L) div {terms}L)"
    parts = held.where("term >= 0").select("term", F.expr(f"CAST((1000000000L * tf) div (1000L * tf + 20L * {length}) AS INT)").alias("part"), "doc")
    dealt = parts.repartitionByRange("term", F.desc("part"), "doc").sortWithinPartitions("term", F.desc("part"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            term = batch.column("term").to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1])
            place = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
            if term[0] == last:
                place[: begins[1] if len(begins) > 1 else len(term)] += seen
            last, seen = term[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place < k)], ["term", "part", "doc", "head"])

    return common.cut(dealt.mapInArrow(run, "term int, part int, doc long, head boolean"), "lists")


@dataclass
class Block:
    """Questions of a block, and what is known of their terms: for each (term, question) in order of terms."""

    question: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    """Where each term's questions begin."""
    miss: np.ndarray
    """The most that a list may add for a document of which nothing was fetched from it, by (term, question)."""
    missing: np.ndarray
    """The same in sum over all terms of a question."""

    def sums(self, docs: int, at: np.ndarray, term: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of documents by questions: the sum fetched, and that with the most that may be missing; -1 where nothing was fetched."""
        count = self.first[term + 1] - self.first[term]
        entry = np.repeat(np.arange(len(term)), count)
        pair = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + self.first[term][entry]
        questions = len(self.missing)
        cell = at[entry] * questions + self.question[pair]
        value = self.weight[term][entry] * part[entry]
        met = np.bincount(cell, minlength=docs * questions) > 0
        got = _added(cell, value, docs * questions)
        most = got + np.tile(self.missing, docs) - _added(cell, self.miss[pair], docs * questions)
        return np.where(met, got, -1).reshape(docs, questions), np.where(met, most, -1).reshape(docs, questions)


def _added(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sums by cell, exact: doubles hold sums of halves below 2**53."""
    low = np.bincount(cell, weights=value & 0xFFFFFF, minlength=size).astype(np.int64)
    return low + (np.bincount(cell, weights=value >> 24, minlength=size).astype(np.int64) << 24)


def _documents(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents with their fetched entries, in bounded numbers: documents, and of each entry the document's place, term and part."""
    step = max(1, CELLS // max(1, questions))
    for batch in batches:
        for k in range(0, len(batch), step):
            some = batch.slice(k, step)
            terms, parts = some.column("terms"), some.column("parts")
            size = np.diff(terms.offsets.to_numpy())
            at = np.repeat(np.arange(len(some)), size)
            yield some.column("doc").to_numpy(), at, terms.flatten().to_numpy().astype(np.int64), parts.flatten().to_numpy().astype(np.int64)


def _fetched(entries: DataFrame) -> DataFrame:
    """(doc, terms, parts): fetched entries (term, part, doc) by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, ["doc"]):
            offsets = pa.array(np.append(starts, len(table)).astype(np.int32))
            flat = table.combine_chunks()
            column = lambda c: flat.column(c).chunk(0) if flat.column(c).num_chunks else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([flat.column("doc").take(pa.array(starts)).combine_chunks(), pa.ListArray.from_arrays(offsets, column("term")), pa.ListArray.from_arrays(offsets, column("part"))], ["doc", "terms", "parts"])

    dealt = entries.select("doc", "term", "part").repartition("doc").sortWithinPartitions("doc")
    return common.cut(dealt.mapInArrow(run, "doc long, terms array<int>, parts array<int>"), "fetched")


def _kth(sums: DataFrame, k: int, count: int) -> np.ndarray:
    """By question the k-th greatest ``value``, 0 where there are fewer; (question, value) may repeat."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("value")))
    out = np.zeros(count, dtype=np.int64)
    for r in sums.withColumn("place", place).where(F.col("place") == k).select("question", "value").collect():  # one row a question of the block at most
        out[r.question] = r.value
    return out


# ---------------------------------------------------------------- search


def _search_block(docs: DataFrame, asked: list[tuple[int, bytes]], k: int, id_col: str, text_col: str) -> DataFrame:
    """(question, rank, doc_id, score) for the questions of one block, numbered from 0, by their (question, term)."""
    spark = docs.sparkSession
    names = sorted({t for _, t in asked})
    number = {t: n for n, t in enumerate(names)}
    pairs = np.array(sorted((number[t], q) for q, t in asked), dtype=np.int64)
    questions = int(pairs[:, 1].max()) + 1
    held = common.cut(postings(docs, Vocabulary(names), id_col, text_col), "postings")

    # The vocabulary of the block bounds what comes to the driver.
    df, documents, terms = np.zeros(len(names), dtype=np.int64), 0, 0
    for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect():
        if r.term < 0:
            documents, terms = r.rows, r.n
        else:
            df[r.term] = r.rows
    if not documents:
        return spark.createDataFrame([], "question int, rank int, doc_id long, score long")
    weights = np.array([weight(documents, int(x)) if x else 0 for x in df], dtype=np.int64)
    pairs = pairs[weights[pairs[:, 0]] > 0]
    term, question = pairs.T
    first = np.searchsorted(term, np.arange(len(names) + 1))
    columns = {"term": pa.array(term, pa.int32()), "question": pa.array(question, pa.int32()), "weight": pa.array(weights[term])}
    weighed = common.cut(spark.createDataFrame(pa.table(columns)), "asked")
    lists = lists_of(held, documents, terms, k)

    # Phase 1: the heads' sums are lower bounds.
    heads = lists.where("head").withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "doc"))).where(F.col("place") <= k)
    sums = heads.join(weighed, "term").groupBy("question", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("value"))
    bound = _kth(sums.select("question", "value"), k, questions)

    # Phase 2: an m-th of the bound from every list, each list by the least that any question wants of it.
    lengths = np.bincount(question, minlength=questions)
    wanted = -(-bound[question] // np.maximum(1, lengths[question] * weights[term]))
    least = np.zeros(len(names), dtype=np.int64)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        least[has] = np.minimum.reduceat(wanted, first[has])
    top = np.zeros(len(names), dtype=np.int64)
    for r in lists.where("head").groupBy("term").agg(F.max("part").alias("part")).collect():
        top[r.term] = r.part
    miss = weights[term] * np.maximum(0, np.minimum(least - 1, top))[term]
    block = Block(question, weights, first, miss, np.bincount(question, weights=miss, minlength=questions).astype(np.int64))
    limits = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(has, pa.int32()), "least": pa.array(least[has])})))  # the block's terms at most
    limited = lists.join(limits, "term")
    fetched = _fetched(limited.where("part >= least"))

    @common.tidy
    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, found, waiting = bound.copy(), [], 0

        def kept() -> tuple[np.ndarray, np.ndarray]:
            q, v = (np.concatenate([np.zeros(0, np.int64), *(f[j] for f in found)]) for j in (0, 1))
            order = np.lexsort((-v, q))
            q, v = q[order], v[order]
            begins = np.searchsorted(q, np.arange(questions + 1))
            place = np.arange(len(q)) - begins[q]
            full = np.flatnonzero(np.diff(begins) >= k)
            floor[full] = np.maximum(floor[full], v[begins[full] + k - 1])
            return q[place < k], v[place < k]

        for docs_, at, t, p in _documents(batches, questions):
            got, _ = block.sums(len(docs_), at, t, p)
            rows, q = np.nonzero(got > floor)
            found.append((q, got[rows, q]))
            waiting += len(q)
            if waiting > CELLS:
                found, waiting = [kept()], 0
        q, v = kept()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(v)], ["question", "value"])

    # A value above the first bound that every task keeps k of: the k-th of all of them is the second bound.
    bound = np.maximum(bound, _kth(fetched.mapInArrow(greatest, "question int, value long"), k, questions))

    @common.tidy
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_, at, t, p in _documents(batches, questions):
            got, most = block.sums(len(docs_), at, t, p)
            rows, q = np.nonzero(most >= np.maximum(bound, 1))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(docs_[rows]), pa.array(got[rows, q])], ["question", "doc", "value"])

    # Phase 3: what was not fetched of the candidates makes their scores exact.
    near = common.cut(fetched.mapInArrow(candidates, "question int, doc long, value long"), "candidates")
    rest = limited.where("part < least").join(near.select("doc").distinct(), "doc", "left_semi")
    looked_up = near.join(rest, "doc").join(weighed, ["question", "term"]).select("question", "doc", (F.col("weight") * F.col("part")).alias("value"))
    scores = near.unionByName(looked_up).groupBy("question", "doc").agg(F.sum("value").alias("score"))
    known = held.where("term < 0").select("doc", "doc_id")
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    placed = scores.where("score > 0").join(known, "doc").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = common.cut(placed.select("question", "rank", "doc_id", "score"), "ranked")
    for done in (held, weighed, lists, fetched, near):
        common.forget(spark, done.cut_path)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = RESULTS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every question, fewer where fewer score above 0."""
    spark: SparkSession = docs.sparkSession
    common.scratch(spark)
    asked = common.cut(question_terms(items, item_col, item_text), "questions")
    blocks = -(-asked.count() // block)
    out = None
    for b in range(blocks):
        # About ``block`` rows, and no question in two blocks.
        rows = asked.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        own = {q: n for n, q in enumerate(sorted({r.question for r in rows}))}
        ids = {own[r.question]: r.item_id for r in rows}
        found = _search_block(docs, [(own[r.question], bytes(r.term)) for r in rows], k, id_col, text_col)
        names = spark.createDataFrame(pa.table({"question": pa.array(list(ids), pa.int32()), "item_id": pa.array(list(ids.values()), pa.int64())}))
        named = found.join(names, "question").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.union(named)
    common.forget(spark, asked.cut_path)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

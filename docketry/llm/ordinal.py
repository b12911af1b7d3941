"""Quality classification by ordinal cumulative-link regression on graded ratings.

A text is the set of its hashed features: lower-cased words and their
beginnings, which words of one stem share, runs of other signs, and the steps
that its shares of capitals, signs and repeated words reach. One weight for each feature, shared by all grades, gives the text's
score s, and ordered thresholds give the probability of a grade above k:

    P(grade > k) = 1 / (1 + exp(t_k - s)),  t_0 < t_1 < ...

Weights and thresholds come from ``STEPS`` steps of Adam on the mean negative
log-likelihood with a quadratic penalty; after each step weights move towards
zero by ``SPARSITY`` times its rate, so that few differ from zero and a stem
that tells takes precedence over words that copies happen to share. They are
fitted on at most ``TRAIN_ROWS`` rated texts, those whose ids have the smallest
hashes. A feature gets a weight if ``LEAST_TEXTS`` of
these have it and its share among some grade and those above departs from
chance by ``SIGNAL`` standard deviations, so that the many words that say
nothing add no noise to long texts. Every text is then scored as a whole.

Defined cases: a null text counts as empty; ratings that are null are left
out, and of several ratings of one text the lowest counts; of several texts of
a rated id the one with the smallest digest trains; rated ids without a text
and texts without an id do not train; without any rating, or with one grade
only, every text has an equal score and is kept; rows that repeat an id are
scored as texts of their own; further columns stay as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

#: Rated texts to fit on, at most; bits of a feature; texts that must have it; how far it must depart from chance.
TRAIN_ROWS, BITS, LEAST_TEXTS, SIGNAL = 20_000, 32, 3, 6.0
PENALTY, SPARSITY, STEPS, RATE = 5e-6, 0.1, 250, 0.08
#: A text is kept if the probability of the highest grade is at least this.
KEEP_FROM = 0.65

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Steps of a share, in percent.
STEPS_OF_SHARE = np.array([2, 5, 10, 20, 35, 50, 70, 90])


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of a mask, which do not cross rows."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    good = mask[edges[:-1]] if len(mask) else np.zeros(0, dtype=bool)
    start, end = edges[:-1][good], edges[1:][good]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of texts laid end to end, each pair once, by row; only ``known`` features, if given."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    spans = common.Spans(common.LOWER[data])
    start, end, row = _runs(WORD[data], offsets)
    words = spans.of(start, end)
    begin, stop, other = _runs(~WORD[data] & ~common.SPACE[data], offsets)
    signs = common.mix(spans.of(begin, stop) + np.uint64(1))
    capitals = np.concatenate([[0], np.cumsum(UPPER[data])])
    shouted = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((words, row))
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[order][1:] == words[order][:-1]) & (row[order][1:] == row[order][:-1])
    shares = [np.bincount(row, shouted, minlength=rows), np.bincount(other, stop - begin > 1, minlength=rows), np.bincount(other, minlength=rows), np.bincount(row[order], same, minlength=rows)]
    keys, owners = [words, signs], [row, other]
    for n_bytes in BEGINNINGS:
        longer = np.flatnonzero(end - start > n_bytes)
        keys.append(common.mix(spans.of(start[longer], start[longer] + n_bytes) + np.uint64(2)))
        owners.append(row[longer])
    for k, share in enumerate(shares):
        reached = (100 * share / np.maximum(n, 1))[:, None] >= STEPS_OF_SHARE
        owner, step = np.nonzero(reached)
        keys.append(common.mix((step + 100 * (k + 1)).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        owners.append(owner)
    feature, owner = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)
    if known is not None:
        if not len(known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hit = known[np.minimum(np.searchsorted(known, feature), len(known) - 1)] == feature
        feature, owner = feature[hit], owner[hit]
    pair = np.unique(owner << bits | feature)
    return pair >> bits, pair & ((1 << bits) - 1)


@dataclass(frozen=True)
class Model:
    """Features in order with their weights, and thresholds between grades."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """The sum of each row's weights."""
        if not len(self.known):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        hit = self.known[at] == feature
        return np.bincount(row[hit], self.weights[at[hit]], minlength=rows)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -700, 700)))

    def judge(self, batch: pa.RecordBatch, text: str) -> np.ndarray:
        """P(grade > k) of every text of a batch."""
        row, feature = features(*common.utf8(batch.column(text)), known=self.known)
        return self.above(self.score(row, feature, len(batch)))


def blank(grades: int) -> Model:
    """A model that keeps everything."""
    return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(grades - 1, -50.0))


def telling(row: np.ndarray, number: np.ndarray, size: int, grade: np.ndarray, grades: int, least: int = LEAST_TEXTS, signal: float = SIGNAL) -> np.ndarray:
    """Which of ``size`` features depart from chance for some threshold between grades."""
    n = len(grade)
    total = np.bincount(number, minlength=size)
    far = np.zeros(size)
    for k in range(grades - 1):
        high = (grade > k).astype(np.float64)
        share = high.mean()
        spread = np.sqrt(np.maximum(total * share * (1 - share) * (1 - total / n), 1e-9))
        far = np.maximum(far, np.abs(np.bincount(number, high[row], minlength=size) - total * share) / spread)
    return (total >= least) & (far >= signal)


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """The model of rated texts given as (row, feature) pairs."""
    if len(np.unique(grade)) < 2:
        return blank(grades)
    known, number = np.unique(feature, return_inverse=True)
    used = telling(row, number, len(known), grade, grades)
    take = used[number]
    row, number, known = row[take], (np.cumsum(used) - 1)[number[take]], known[used].astype(np.int64)
    size, at = len(known), np.arange(len(grade))
    share = np.clip([(grade > k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    thresholds = -np.log(share / (1 - share))
    # The first threshold and the logarithms of the gaps are free, so the order holds.
    free = np.concatenate([np.zeros(size), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    mean, square = np.zeros_like(free), np.zeros_like(free)
    edge = np.ones((len(grade), 1))
    for step in range(1, STEPS + 1):
        gaps = np.exp(free[size + 1 :])
        theta = free[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, free[:size][number], minlength=len(grade))
        p = np.concatenate([edge, 1 / (1 + np.exp(np.clip(theta - score[:, None], -500, 500))), 0 * edge], axis=1)
        upper, lower = p[at, grade], p[at, grade + 1]
        likely = np.maximum(upper - lower, 1e-12)
        by_score = (upper + lower - 1) / len(grade)
        by_theta = np.zeros(grades + 1)
        np.add.at(by_theta, grade, upper * (1 - upper) / likely / len(grade))
        np.add.at(by_theta, grade + 1, -lower * (1 - lower) / likely / len(grade))
        by_theta = by_theta[1:-1]
        slope = np.concatenate([np.bincount(number, by_score[row], minlength=size) + 2 * PENALTY * free[:size], [by_theta.sum()], np.cumsum(by_theta[::-1])[::-1][1:] * gaps])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        free = free - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
        own = free[:size]
        own[:] = np.sign(own) * np.maximum(np.abs(own) - rate * SPARSITY, 0)
    return Model(known, free[:size], free[size] + np.concatenate([[0.0], np.cumsum(np.exp(free[size + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of bounded size; ``ratings`` has the id and an integer ``grade`` from 0."""
    spark = docs.sparkSession
    common.scratch(spark)
    rated = ratings.where(F.col("grade").between(0, grades - 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    rated = common.cut(rated.withColumn("hash", F.xxhash64("_id")), "ratings")
    top = rated.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    if top is None:
        return blank(grades)
    # At most ``rows`` ids, so they may go to every executor.
    sample = F.broadcast(rated.where(F.col("hash") <= top).select("_id", "grade"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Of rows that repeat an id one trains, so the bound holds for rows as well.
    found = texts.join(sample, F.col("id") == F.col("_id")).groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade"))

    @common.tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text"):
            row, feature = features(*common.utf8(batch.column("text")))
            edges = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["grade", "features"])

    held = common.cut(found.mapInArrow(extract, "grade int, features binary"), "features")

    @common.tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, sets = [], []
        for batch in batches:
            grade += batch.column("grade").to_pylist()
            sets += [np.frombuffer(x, dtype="<u4") for x in batch.column("features").to_pylist()]
        if grade:
            model = fit(np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets), np.array(grade), grades)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.known.astype("<i8"), model.weights.astype("<f8"), model.thresholds.astype("<f8"))], ["known", "weights", "thresholds"])

    made = held.coalesce(1).mapInArrow(learn, "known binary, weights binary, thresholds binary").collect()
    common.forget(spark, held.cut_path)
    return Model(np.frombuffer(made[0][0], "<i8"), np.frombuffer(made[0][1], "<f8"), np.frombuffer(made[0][2], "<f8")) if made else blank(grades)


def grade(docs: DataFrame, model: Model, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the highest grade) and kept.

    Columns of ``docs`` with these names are replaced.
    """
    common.scratch(docs.sparkSession)
    docs = docs.select(*common.without(docs.columns, ["expected_grade", "tail_probability", "kept"]))
    names = docs.columns

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, text_col):
            above = model.judge(batch, text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep_from)], [*names, "expected_grade", "tail_probability", "kept"])

    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


#: Low quality, toxic, and neither.
GRADES = 3


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The grade of a labelled text: 0 if its quality is low, 1 if it is toxic, 2 otherwise."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` graded by a model of the labelled ones among them."""
    model = train(docs, labels.select(id_col, rating().alias("grade")), GRADES, id_col, text_col)
    return grade(docs, model, text_col)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Those of ``docs`` that the model of the labelled ones keeps, with their columns."""
    model = train(docs, labels.select(id_col, rating().alias("grade")), GRADES, id_col, text_col)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, text_col):
            above = model.judge(batch, text_col)
            yield batch.filter(pa.array(above[:, -1] >= keep_from))

    return docs.mapInArrow(run, docs.schema)

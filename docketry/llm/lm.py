"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped for scoring.

Words are numbered by their place among the sorted hashes of all training
words. Every token makes one n-gram of ``order`` words; before the first word
stand ``order - 1`` start marks. Tasks count the n-grams of their texts, and
send them as sorted, compressed columns to the shard that a hash of the context
picks. A shard is written once: sorted hashes of contexts, where each context's
followers begin, and followers and counts in order. It passes its suffixes,
n-grams without their first word, on to the next lower order, where the count
of an n-gram is the number of different words before it. Workers map the arrays
to memory and look up the distinct n-grams of a batch of texts in one sweep.

With counts c, contexts h, h' a context without its first word, and discounts D
by count (1, 2, 3 and more) of each order:

    p(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(w | h')
    p(w)     = max(k(w) - D', 0) / K + g' / (V + 1)

g(h) is what the discounts set free, k(w) the number of different words before
w and K their sum. Words not seen in training share the last term of p(w); of a
context not seen p(w | h) is p(w | h').

A context is spread over all shards by its followers if all its words are
frequent, as only such contexts can be; its totals are summed apart. Counts are
bytes where they fit and 64-bit integers where not, so nothing wraps. A context
is told by a 64-bit hash of its words' numbers, a word by a 64-bit hash of its bytes.

Defined cases: a null text counts as empty, which is the end token alone; rows
that repeat an id are texts of their own; a row without an id is a training
text; without any training text all words are unknown and V is 0; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import common, storage

#: Words of an n-gram.
ORDER = 3
#: Hash of the end token; words have other hashes but for chance.
END = common.mix(np.array([0x5DEECE66D], dtype=np.uint64))[0]
#: Words and tokens of a shard, about, and shards at least.
SHARD_WORDS, SHARD_TOKENS, SHARDS_LEAST = 1 << 20, 3 << 20, 16
#: A word is frequent if it makes more than one part in so many of a shard, and of all tokens: so there are at most as many as the latter.
HOT, FREQUENT = 8, 1 << 16
#: N-grams that a task holds before it sends or merges them.
HELD = 3 << 19
#: Followers from which a context's totals are stored, not summed when wanted.
WIDE = 16
#: Bits of a sort key, which holds as many columns of numbers as fit.
KEY_BITS = 64


def token_hashes(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows (A-Z lower-cased), each row closed by the end token, and tokens by row."""
    data, offs = common.utf8(batch.column(text))
    data = common.LOWER[data]
    begin, end, counts = common.tokens_of(data, offs)
    out = np.full(len(begin) + len(counts), END, dtype=np.uint64)
    if len(begin):
        out[np.arange(len(begin)) + np.repeat(np.arange(len(counts)), counts)] = common.word_hashes(data, begin, end)
    return out, counts + 1


def _shards(things: int, each: int) -> int:
    """A power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, things / each))))


def own_path(folder: str, shard: int) -> str:
    """A name of its own for what a task writes, so that a second attempt never touches files in use."""
    return f"{folder}/{shard}-{uuid.uuid4().hex}"


def gram_shards(tokens: int) -> int:
    """Shards for the n-grams of so many tokens."""
    return max(SHARDS_LEAST, _shards(tokens, SHARD_TOKENS))


def frequent_from(tokens: int) -> float:
    """The count above which a word is frequent."""
    return max(tokens / (gram_shards(tokens) * HOT), tokens / FREQUENT)


@dataclass(frozen=True)
class Words:
    """The sorted hash arrays of the vocabulary: a file of hashes and one of counts for each shard."""

    paths: tuple[str, ...]
    sizes: tuple[int, ...]
    tokens: int
    #: Numbers of the frequent words.
    frequent: tuple[int, ...]

    @property
    def distinct(self) -> int:
        return sum(self.sizes)

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0, *self.sizes])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of each of some sorted hashes."""
        number = np.full(len(hashes), -1, dtype=np.int64)
        count = np.zeros(len(hashes), dtype=np.int64)
        bits = len(self.paths).bit_length() - 1
        edges = [0, *np.searchsorted(hashes, [np.uint64(k << (64 - bits)) for k in range(1, len(self.paths))]).tolist(), len(hashes)]
        for k, (path, offset) in enumerate(zip(self.paths, self.offsets)):
            own = hashes[edges[k] : edges[k + 1]]
            if len(own) and self.sizes[k]:
                known = array(path + ".hash")
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[at] == own
                number[edges[k] : edges[k + 1]][hit] = offset + at[hit]
                count[edges[k] : edges[k + 1]][hit] = array(path + ".count")[at[hit]]
        return number, count


#: Arrays that this worker has mapped, all of one model; those of an earlier model are let go. A process may map some 65,000 files.
_mapped: dict[str, np.ndarray] = {}
_model, MAPPED = "", 16384


def array(path: str) -> np.ndarray:
    """A file of the model, mapped to memory where the store allows."""
    global _model
    found = _mapped.get(path)
    if found is None:
        found = storage.load(path)
        if not storage.is_local(path):
            return found
        folder = path.rsplit("/", 2)[0]
        if folder != _model or len(_mapped) >= MAPPED:
            _mapped.clear()
            _model = folder
        _mapped[path] = found
    return found


def count_words(train: DataFrame, folder: str) -> Words:
    """The vocabulary of the training texts."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text", 8 << 20):
            word, n = np.unique(token_hashes(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    counted = common.cut(train.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    distinct, tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = _shards(distinct, SHARD_WORDS)
    bits = shards.bit_length() - 1
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)

    def save(table: pa.Table) -> pa.Table:
        word = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        k = table.column("shard")[0].as_py()
        path = own_path(f"{folder}/words", k)
        storage.save(path + ".hash", word[order])
        n = table.column("n").to_numpy()[order]
        storage.save(path + ".count", narrow(n))
        often = pa.array([np.flatnonzero(n > limit)], pa.list_(pa.int64()))
        return pa.table({"shard": pa.array([k], pa.int32()), "size": pa.array([len(word)], pa.int64()), "often": often, "path": pa.array([path])})

    limit = frequent_from(tokens)
    made = {r[0]: r for r in counted.withColumn("shard", shard).groupBy("shard").applyInArrow(save, "shard int, size long, often array<long>, path string").collect()}
    common.forget(train.sparkSession, counted.cut_path)
    sizes = tuple(made[k][1] if k in made else 0 for k in range(shards))
    offsets = np.cumsum([0, *sizes])
    return Words(tuple(made[k][3] if k in made else "" for k in range(shards)), sizes, tokens, tuple(int(offsets[k] + at) for k in sorted(made) for at in made[k][2]))


def narrow(values: np.ndarray) -> np.ndarray:
    """The values as the smallest unsigned integers that hold them."""
    most = int(values.max(initial=0))
    return values.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if most < 1 << 8 * b))


# ---------------------------------------------------------------- n-grams as columns of numbers


def grams(number: np.ndarray, counts: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The n-gram of every token as columns, first word first; the start mark is number ``start``."""
    place = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    columns = [number]
    for back in range(1, order):
        before = np.full(len(number), start, dtype=number.dtype)
        before[back:] = number[:-back] if back < len(number) else number[:0]
        before[place < back] = start
        columns.insert(0, before)
    return columns


def packed(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Rows of numbers below 2**bits as one 64-bit key each, first column highest."""
    return functools.reduce(lambda a, c: a << np.uint64(bits) | c.astype(np.uint64), columns[1:], columns[0].astype(np.uint64))


def distinct(columns: list[np.ndarray], n: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order and the sums of their counts; numbers are below 2**bits."""
    if not len(n):
        return columns, n
    over = len(columns) * bits - KEY_BITS
    head = np.ones(len(n), dtype=bool)
    if over <= 0:
        key = packed(columns, bits)
        order = np.argsort(key)
        key = key[order]
        head[1:] = key[1:] != key[:-1]
    elif over < bits and len(columns) > 1:
        # The key lacks the last bits of the last column, which tell only rows of equal keys apart.
        key = packed(columns[:-1], bits) << np.uint64(bits - over) | columns[-1].astype(np.uint64) >> np.uint64(over)
        order = np.argsort(key)
        key, last = key[order], columns[-1][order]
        same = key[1:] == key[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        by = np.lexsort((last[tied], key[tied]))
        order[tied], last[tied] = order[tied[by]], last[tied[by]]
        head[1:] = ~same | (last[1:] != last[:-1])
    else:
        order = np.lexsort(columns[::-1])
        head[1:] = functools.reduce(np.logical_or, (c[order[1:]] != c[order[:-1]] for c in columns))
    first = np.flatnonzero(head)
    n = np.add.reduceat(n[order], first)
    order = order[first]
    return [c[order] for c in columns], n


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of numbers."""
    out = common.mix(columns[0].astype(np.uint64) + np.uint64(0x51ED27))
    for c in columns[1:]:
        out = common.mix(out ^ common.mix(c.astype(np.uint64) + np.uint64(0xA24BAED4)))
    return out


def among(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are among some sorted ones."""
    if not len(known):
        return np.zeros(len(numbers), dtype=bool)
    return known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers


def spread(columns: list[np.ndarray], context: np.ndarray, frequent: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each n-gram, and whether all words of its context are frequent."""
    often = functools.reduce(np.logical_and, (among(c, frequent) for c in columns[:-1]))
    key = np.where(often, common.mix(context ^ common.mix(columns[-1].astype(np.uint64))), context)
    return (common.mix(key) & np.uint64(shards - 1)).astype(np.int64), often


def squeeze(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted rows and counts by bytes of equal weight, the first column as differences."""
    parts = [narrow(c) for c in (np.diff(columns[0].astype(np.int64), prepend=0), *columns[1:], n)]
    planes = [c.view(np.uint8).reshape(len(n), -1).T.tobytes() for c in parts]
    return bytes(c.itemsize for c in parts) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def expand(blob: bytes, width: int, kind: np.dtype) -> tuple[list[np.ndarray], np.ndarray]:
    """What ``squeeze`` made the bytes of, numbers as ``kind``."""
    sizes = list(blob[: width + 1])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[width + 1 :]), dtype=np.uint8)
    rows, out, at = len(raw) // sum(sizes), [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + rows * size].reshape(size, rows).T).view(f"<u{size}").ravel())
        at += rows * size
    return [np.cumsum(out[0], dtype=np.int64).astype(kind), *(c.astype(kind) for c in out[1:-1])], out[-1].astype(np.int64)


def _joined(columns: list[np.ndarray], n: np.ndarray, more: list[tuple[list[np.ndarray], np.ndarray]], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of all of these."""
    if not more:
        return columns, n
    return distinct([np.concatenate(c) for c in zip(columns, *(m for m, _ in more))], np.concatenate([n, *(m for _, m in more)]), bits)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from how many have counts 1 to 4."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def cut_of(cut: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *cut])[np.minimum(c, 3).astype(np.int64)]


def by_count(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of counts, and how many are 1, 2 and 3 or more, of groups that begin at ``at``."""
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)], axis=1) if len(at) else np.zeros((0, 4), np.int64)


# ---------------------------------------------------------------- the arrays of one order


def store(path: str, columns: list[np.ndarray], n: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Write the distinct n-grams of a shard, given in order.

    Returns hashes and totals of its contexts and which of them are spread.
    """
    head = np.ones(len(n), dtype=bool)
    head[1:] = functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in columns[:-1]))
    at = np.flatnonzero(head)
    leading = [c[at] for c in columns[:-1]]
    context, stats, size = hashed(leading), by_count(n, at), np.diff(np.append(at, len(n)))
    often = functools.reduce(np.logical_and, (among(c, frequent) for c in leading))
    # N-grams of one context already stand together, so only contexts are sorted.
    order = np.argsort(context)
    context, stats, size, often = context[order], stats[order], size[order], often[order]
    begin = np.concatenate([[0], np.cumsum(size)])
    rows = np.repeat(at[order] - begin[:-1], size) + np.arange(len(n))
    follower, n = columns[-1][rows], n[rows]
    wide = np.flatnonzero(size > WIDE)
    storage.save(path + ".context", context)
    storage.save(path + ".begin", narrow(begin))
    storage.save(path + ".word", narrow(follower))
    large = np.flatnonzero(n > 255)
    storage.save(path + ".count", np.where(n > 255, 0, n).astype("u1"))
    storage.save(path + ".large", large)
    storage.save(path + ".largecount", n[large])
    storage.save(path + ".wide", wide)
    storage.save(path + ".stats", stats[wide].ravel())
    return context, stats, np.flatnonzero(often)


def at_of(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values among sorted ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def counts_at(path: str, at: np.ndarray) -> np.ndarray:
    """Counts at some places of a shard."""
    n = array(path + ".count")[at].astype(np.int64)
    zero = np.flatnonzero(n == 0)  # counts beyond a byte
    if len(zero):
        n[zero] = array(path + ".largecount")[np.searchsorted(array(path + ".large"), at[zero])]
    return n


def look_up(path: str, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count (0: unseen) of each n-gram, and the four totals of its context within the shard; contexts in order."""
    count, stats = np.zeros(len(context), dtype=np.int64), np.zeros((len(context), 4), dtype=np.int64)
    at, hit = at_of(array(path + ".context"), context)
    at, rows = at[hit], np.flatnonzero(hit)
    if not len(rows):
        return count, stats
    begin, word = array(path + ".begin"), array(path + ".word")
    low, end = begin[at].astype(np.int64), begin[at + 1].astype(np.int64)
    high, first = end.copy(), low.copy()
    # All followers are sought at once, each among those of its context.
    sought = follower[rows]
    todo = np.flatnonzero(low < high)
    while len(todo):
        a, b = low[todo], high[todo]
        middle = (a + b) >> 1
        less = word[middle] < sought[todo]
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
        low[todo], high[todo] = a, b
        todo = todo[a < b]
    found = (low < end) & (word[np.minimum(low, end - 1)] == sought)
    count[rows[found]] = counts_at(path, low[found])
    each, back = np.unique(at, return_index=True)
    own, size = first[back], (end - first)[back]
    totals = np.zeros((len(each), 4), dtype=np.int64)
    broad = size > WIDE
    totals[broad] = array(path + ".stats").reshape(-1, 4)[np.searchsorted(array(path + ".wide"), each[broad])]
    own, size = own[~broad], size[~broad]
    if len(own):
        starts = np.cumsum(size) - size
        totals[~broad] = by_count(counts_at(path, np.repeat(own - starts, size) + np.arange(size.sum())), starts)
    stats[rows] = totals[np.searchsorted(each, at)]
    return count, stats


@dataclass(frozen=True)
class Level:
    """The n-grams of one order: paths of its shards, the discounts, and paths of the totals of spread contexts."""

    shards: tuple[str, ...]
    cut: tuple[float, float, float]
    spread: tuple[str, ...]


@dataclass(frozen=True)
class Model:
    """What scoring needs: paths of the arrays and a bounded number of figures for each."""

    words: Words
    order: int
    levels: tuple[Level, ...]
    follow: tuple[str, ...]
    word_cut: tuple[float, float, float]
    kinds: int
    word_free: float
    frequent: np.ndarray

    def word_probability(self, number: np.ndarray) -> np.ndarray:
        """p(w) of distinct numbers, in order but for -1; of -1 the probability of an unknown word."""
        out = np.full(len(number), self.word_free / (self.words.distinct + 1))
        rows = np.flatnonzero(number >= 0)
        edges = np.searchsorted(number[rows], self.words.offsets)
        for k, path in enumerate(self.follow):
            own = rows[edges[k] : edges[k + 1]]
            if len(own) and path:
                c = array(path)[number[own] - self.words.offsets[k]].astype(np.float64)
                out[own] += np.maximum(c - cut_of(self.word_cut, c), 0) / max(self.kinds, 1)
        return out

    def terms(self, context: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The discounted share of each n-gram, and the weight of the next lower order in its context; contexts' hashes in order."""
        level = self.levels[len(columns) - 2]
        where, often = spread(columns, context, self.frequent, len(level.shards))
        count, stats = np.zeros(len(context), dtype=np.int64), np.zeros((len(context), 4), dtype=np.int64)
        # By shard, and by context within each; small integers are sorted without comparisons.
        order = np.argsort(narrow(where), kind="stable")
        edges = np.searchsorted(where[order], np.arange(len(level.shards) + 1))
        for k, path in enumerate(level.shards):
            own = order[edges[k] : edges[k + 1]]
            if len(own) and path:
                count[own], stats[own] = look_up(path, context[own], columns[-1][own])
        if often.any():
            stats[often] = 0
            own = np.flatnonzero(often)
            bits = len(level.spread).bit_length() - 1
            part = (context[own] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), dtype=np.int64)
            for k in np.unique(part):
                if level.spread[k]:
                    some = own[part == k]
                    at, hit = at_of(array(level.spread[k] + ".context"), context[some])
                    stats[some[hit]] = array(level.spread[k] + ".stats").reshape(-1, 4)[at[hit]]
        seen = stats[:, 0] > 0
        total = np.where(seen, stats[:, 0], 1)
        share = np.where(seen, np.maximum(count - cut_of(level.cut, count), 0) / total, 0.0)
        return share, np.where(seen, stats[:, 1:] @ np.array(level.cut) / total, 1.0)

    def probabilities(self, known: np.ndarray, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """p(w | the words before it) of every token of some texts, whose words are places among distinct numbers."""
        number = known[word]
        p = self.word_probability(known)[word]
        for order in range(2, self.order + 1):
            columns = grams(number, counts, order, self.words.distinct)
            # One row for each n-gram, by context and word; its first token stands for all.
            contexts, place = np.unique(hashed(columns[:-1]), return_inverse=True)
            key, first, back = np.unique(place * len(known) + word, return_index=True, return_inverse=True)
            share, weight = self.terms(contexts[key // len(known)], [c[first] for c in columns])
            p = share[back] + weight[back] * p
        return p


def numbered(words: Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of the distinct words, each token's place among them, and tokens by row."""
    hashes, counts = token_hashes(batch)
    known, back = np.unique(hashes, return_inverse=True)
    return *words.find(known), back, counts


def fit(train: DataFrame, order: int = ORDER) -> Model:
    """Count the model on a table with a ``text`` column."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = train.sparkSession
    folder = common.fresh(spark, "lm")
    words = count_words(train, folder)
    start, shards = words.distinct, gram_shards(words.tokens)
    bits = max(1, start.bit_length())
    kind = np.dtype("<u4") if bits <= 32 else np.dtype("<i8")
    # The start of a text is as frequent as texts are.
    texts = train.count() if words.tokens else 0
    frequent = np.array([*words.frequent, *([start] if texts > frequent_from(words.tokens) else [])], dtype=np.int64)

    def sent(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Shards, and what goes to each of them."""
        if len(columns) == 1:
            to = np.searchsorted(words.offsets, columns[0], side="right") - 1
        else:
            to = spread(columns, hashed(columns[:-1]), frequent, shards)[0]
        by = np.argsort(to, kind="stable")
        used, begin = np.unique(to[by], return_index=True)
        used = used.astype(np.int64)
        return used, [squeeze([c[rows] for c in columns], n[rows]) for rows in np.split(by, begin[1:])]

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0

        def send() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            used, blobs = sent(*distinct(columns, np.ones(len(columns[0]), dtype=np.int64), bits))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in common.parts(batches, "text", 8 << 20):
            number, _, word, counts = numbered(words, batch)
            held.append(grams(number.astype(kind)[word], counts, order, start))
            waiting += len(word)
            if waiting >= HELD:
                yield send()
                waiting = 0
        if held:
            yield send()

    def merged(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        columns, n, waiting, size = [np.zeros(0, kind)] * width, np.zeros(0, np.int64), [], 0
        for blob in table.column("blob"):
            waiting.append(expand(blob.as_py(), width, kind))
            size += len(waiting[-1][1])
            # Merged whenever as much again has come, so the work grows with the size and not its square.
            if size > max(4 * HELD, len(n)):
                columns, n = _joined(columns, n, waiting, bits)
                waiting, size = [], 0
        return _joined(columns, n, waiting, bits)

    def gather(width: int, table: pa.Table) -> pa.Table:
        """Write a shard; rows: 0 its path and counts of counts, 1 its suffixes, 2 totals of spread contexts."""
        k = table.column("shard")[0].as_py()
        columns, n = merged(table, width)
        path = own_path(f"{folder}/{width}", k)
        context, stats, split = store(path, columns, n, frequent)
        used, blobs = sent(*distinct(columns[1:], np.ones(len(n), dtype=np.int64), bits))
        sort = np.concatenate([[0], np.ones(len(used)), np.full(len(split), 2)]).astype(np.int8)
        figures = np.zeros((len(sort), 4), dtype=np.int64)
        figures[0] = [(n == c).sum() for c in (1, 2, 3, 4)]
        figures[1 + len(used) :] = stats[split]
        ident = np.concatenate([[k], used, context[split].view(np.int64)]).astype(np.int64)
        none = [None] * len(split)
        return pa.table([pa.array(sort), pa.array(ident), *(pa.array(figures[:, c]) for c in range(4)), pa.array([path, *[None] * (len(sort) - 1)], pa.string()), pa.array([None, *blobs, *none], pa.binary())], ["kind", "shard", "a", "b", "c", "d", "path", "blob"])

    sending = train.mapInArrow(count, "shard long, blob binary")
    levels: list[Level] = []
    for width in range(order, 1, -1):
        common.release(spark)
        made = common.cut(sending.groupBy("shard").applyInArrow(_of_width(gather, width), "kind byte, shard long, a long, b long, c long, d long, path string, blob binary"), "gathered")
        rows = made.where("kind = 0").select("shard", "a", "b", "c", "d", "path").collect()
        written = {r[0]: r[5] for r in rows}
        often = made.where("kind = 2").groupBy("shard").agg(*(F.sum(c).alias(c) for c in "abcd"))
        apart = _totals(often, f"{folder}/spread{width}")
        levels.insert(0, Level(tuple(written.get(k, "") for k in range(shards)), discounts(*(sum(r[c] for r in rows) for c in range(1, 5))), apart))
        if width < order:
            common.forget(spark, before)
        before = made.cut_path
        sending = made.where("kind = 1").select("shard", "blob")

    def align(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        columns, n = merged(table, 1)
        out = np.zeros(words.sizes[k], dtype=np.int64)
        out[columns[0] - words.offsets[k]] = n
        path = own_path(f"{folder}/words", k) + ".follow"
        storage.save(path, narrow(out))
        figures = [int((n == c).sum()) for c in (1, 2, 3, 4)] + [int((n >= 3).sum()), int(n.sum())]
        return pa.table([pa.array([k], pa.int64()), pa.array([path]), *(pa.array([f], pa.int64()) for f in figures)], ["shard", "path", *"abcdef"])

    common.release(spark)
    aligned = sending.groupBy("shard").applyInArrow(align, "shard long, path string, a long, b long, c long, d long, e long, f long").collect()
    common.forget(spark, before)
    follow = {r[0]: r[1] for r in aligned}
    n1, n2, n3, n4, many, kinds = (sum(r[c] for r in aligned) for c in range(2, 8))
    word_cut = discounts(n1, n2, n3, n4)
    free = (word_cut[0] * n1 + word_cut[1] * n2 + word_cut[2] * many) / kinds if kinds else 1.0
    return Model(words, order, tuple(levels), tuple(follow.get(k, "") for k in range(len(words.paths))), word_cut, kinds, free, frequent)


def _of_width(run, width: int):
    """``run`` for one width, as a function of the group alone."""

    def one(table: pa.Table) -> pa.Table:
        return run(width, table)

    return one


def _totals(often: DataFrame, folder: str) -> tuple[str, ...]:
    """Paths of the totals of spread contexts (shard: the context's hash), by the hash's upper bits."""
    often = common.cut(often, "spread-contexts")
    parts = _shards(often.count(), SHARD_WORDS)
    bits = parts.bit_length() - 1
    part = F.shiftrightunsigned("shard", 64 - bits).cast("int") if bits else F.lit(0)

    def save(table: pa.Table) -> pa.Table:
        k = table.column("part")[0].as_py()
        context = table.column("shard").to_numpy().view(np.uint64)
        by = np.argsort(context)
        path = own_path(folder, k)
        storage.save(path + ".context", context[by])
        storage.save(path + ".stats", np.stack([table.column(c).to_numpy()[by] for c in "abcd"], axis=1).ravel())
        return pa.table({"part": pa.array([k], pa.int32()), "path": pa.array([path])})

    made = dict(often.withColumn("part", part).groupBy("part").applyInArrow(save, "part int, path string").collect())
    common.forget(often.sparkSession, often.cut_path)
    return tuple(made.get(k, "") for k in range(parts))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; log10 of the text's probability.

    ``base_score`` is that of single words with one added to each count.
    """
    words = model.words

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text", 4 << 20):
            number, seen, word, counts = numbered(words, batch)
            base = np.log10((seen + 1.0) / (words.tokens + 1.0 * (words.distinct + 1)))
            p = np.log10(model.probabilities(number, word, counts))
            at = np.cumsum(counts) - counts
            sums = [np.add.reduceat(x, at) if len(at) else x for x in ((number >= 0).astype(np.int64)[word], base[word], p)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts.astype(np.int64)), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether a row is kept from training: by CRC-32 of its id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all rows by a model of those that are not held out."""
    common.scratch(docs.sparkSession)
    model = fit(docs.where(~held_out(id_col)).select(F.col(text_col).cast("string").alias("text")), order)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")

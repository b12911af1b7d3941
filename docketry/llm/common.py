"""What the operators share: scratch storage, hashing of texts, block pairs, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import ship

# ---------------------------------------------------------------- scratch storage


#: Bytes of an Arrow batch on its way to a worker, so that long texts do not travel by the ten thousand.
BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where none is set and all runs on this machine, as in local tests, a
    temporary folder is made. Batches that go to workers are bounded here too.
    """
    ship(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        # With its scheme, as Spark resolves it: a bare path need not be on this machine.
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: list[str] = []


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{scratch(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Remove all that this session's operators have written to the shared folder; their results must be stored by then."""
    while _made:
        forget(spark, _made.pop())


def mark() -> int:
    """How many paths have been made so far, for ``clean_since``."""
    return len(_made)


def clean_since(spark: SparkSession, at: int, *keep: str) -> None:
    """Remove what has been written to the shared folder since a mark, but for some paths; what read it must be stored."""
    gone = [path for path in _made[at:] if path not in keep]
    _made[at:] = [path for path in _made[at:] if path in keep]
    for path in gone:
        forget(spark, path)


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    It ends the lineage: what follows survives the loss of any executor
    without running ``df`` again. ``df.cut_path`` of the result is the path.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table or folder of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended; it does so when the driver's memory is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """A function over batches that gives its worker's free memory back when it ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def without(columns: list[str], added: list[str]) -> list[str]:
    """The columns but those that added ones of the same name replace."""
    names = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in names]


#: A key is heavy if it has more than one part in so many of all rows; so there are no more heavy keys than that.
HEAVY = 1024


def join_counted(rows: DataFrame, table: DataFrame, on: dict[str, str], count: str, total: int) -> DataFrame:
    """``rows`` joined to a table with one row per key and the ``count`` of the rows that have it.

    ``on`` maps columns of ``rows`` to the table's key and ``total`` is the sum
    of the counts. Rows of heavy keys stay where they are and meet the at most
    ``HEAVY`` rows of the table by broadcast; all others are sort-merged.
    """
    limit = max(1, total // HEAVY)
    same = functools.reduce(lambda a, b: a & b, (F.col(r) == F.col(t) for r, t in on.items()))
    heavy = F.broadcast(table.where(F.col(count) > limit))
    light = table.where(F.col(count) <= limit)
    others = rows.join(heavy, same, "left_anti")
    return rows.join(heavy, same).union(others.join(light.hint("merge"), same))


# ---------------------------------------------------------------- bytes and hashes

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
BASE2_INV = np.uint64(pow(int(BASE2), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Words up to this many bytes are hashed all at once, longer ones each by XXH64.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word ``data[start:end]``.

    Eight bytes at a time go through ``mix``, which is one-to-one: words of one
    length up to eight bytes never collide, and no pattern of letters does by design.
    """
    size = end - start
    out = mix((size + 1).astype(np.uint64) * BASE2)
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] = mix(out[live] ^ (eights[start[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]))
    for k in np.flatnonzero(size > SHORT):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return out


class Spans:
    """Hashes of any spans of an array of symbols, from prefix sums of a polynomial.

    Equal spans have equal hashes; that equal hashes mean equal spans must be verified.
    """

    def __init__(self, symbols: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INV):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of symbols[start:end], independent of where it stands."""
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A well-mixed hash of symbols[start:end] and its length."""
        return mix(self.raw(start, end) + mix((end - start).astype(np.uint64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def parts(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that each holds about ``limit`` bytes of text or one row; ``text`` may be a column of lengths."""
    for batch in batches:
        own = batch.column(text)
        n = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(n) - n) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(n)] if len(n) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def tokens_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and the number of words by row; ``gap`` tells other bytes that part words."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    solid = ~gap[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    first = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    head[first] = solid[first]
    tail[first[1:] - 1] = solid[first[1:] - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


# ---------------------------------------------------------------- groups in blocks

#: Rows that a block of a group may have, at least and at most.
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 256, 16384, 64


def pair_blocks(df: DataFrame, key: str, spread: str, ready: Column | None = None, extra: list[Column] = (), least: int = BLOCK_LEAST, most: int = BLOCK_MOST) -> DataFrame:
    """Rows of the keys that several rows share, dealt out as pairs of blocks.

    A group of n rows is cut by a hash of ``spread`` into blocks of bounded
    size, and every pair of blocks becomes one unit (``key``, ``bi``, ``bj``).
    Each two rows of a group meet in the unit of their blocks, so no unit is
    unbounded and no row is dropped. ``extra`` are further aggregates of the
    group, and ``ready`` is a condition on them and the key. Units come whole
    and sorted within their partition.
    """
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *extra)
    stats = stats.where((F.col("_n") > 1) & (F.lit(True) if ready is None else ready)).select(F.col(key).alias("_key"), "_n")
    # As a table of its own, so that the join below may split the rows of one key.
    stats = cut(stats, "groups")
    block = F.least(F.greatest(F.lit(least), F.ceil(F.col("_n") / BLOCKS)), F.lit(most))
    rows = df.join(stats, F.col(key) == F.col("_key")).drop("_key")
    rows = rows.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("bi", F.least("_own", "_other")).withColumn("bj", F.greatest("_own", "_other")).drop("_n", "_blocks", "_other")
    return rows.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted stream, with where each group starts."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cuts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for c in by:
            v = table.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1]).astype(np.int64)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = cuts(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
            table = table.slice(starts[-1])
        held, count = table.to_batches(), len(table)
    if held:
        table = pa.Table.from_batches(held)
        yield table, cuts(table)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all pairs within each of several small groups."""
    row = np.repeat(np.arange(len(starts)), sizes)
    own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[row] - 1 - own
    i = np.repeat(starts[row] + own, left)
    j = i + 1 + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    return i, j


def forest(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of ``near`` on n points.

    ``near(a, b)`` tells for positions a and b which are linked, as a matrix.
    Each point is expanded once and no list of all links is ever held.
    """
    left, right = [], []
    todo = np.arange(n)
    while len(todo):
        frontier, todo = todo[:1], todo[1:]
        while len(frontier) and len(todo):
            take, frontier = frontier[:strip], frontier[strip:]
            hit = near(take, todo)
            found = hit.any(axis=0)
            if found.any():
                left.append(take[hit[:, found].argmax(axis=0)])
                right.append(todo[found])
                frontier = np.concatenate([frontier, todo[found]])
                todo = todo[~found]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(id, component_id) for every id of ``edges`` (a, b): the smallest id it can reach.

    Alternating large and small stars: each round is two aggregations and two
    joins over the edges, which shrink to stars around the smallest ids within
    a number of rounds logarithmic in the longest chain. Rounds are written to
    the shared folder; only two sums come to the driver.
    """
    spark = edges.sparkSession
    held = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    mark = _mark(held)
    while mark[0]:
        both = held.select(F.col("u").alias("n"), F.col("v").alias("m")).union(held.select(F.col("v").alias("n"), F.col("u").alias("m")))
        # The smallest neighbours are tables of their own, so that a join may split the edges of a hub.
        near = cut(both.groupBy("n").agg(F.min("m").alias("r")).select(F.col("n").alias("k"), F.least("n", "r").alias("r")), what)
        large = both.join(near, F.col("n") == F.col("k")).where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        large = cut(large, what)
        lowest = cut(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("r")), what)
        small = large.join(lowest, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("r").alias("v")), F.struct(F.col("v").alias("u"), F.col("r").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct(), what)
        for done in (held, near, large, lowest):
            forget(spark, done.cut_path)
        held, before, mark = now, mark, _mark(now)
        if mark == before:
            break
    roots = held.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return held.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])

"""Removal of long repeated strings with run-length compressed Burrows-Wheeler indexes.

Which strings can repeat at all is found first. Of the ``LENGTH`` bytes of a
window the ``GRAM`` bytes with the smallest hash are its sample; equal windows
have equal samples at equal places, so two equal windows meet under the hash
of their sample. Windows that follow each other and share a sample form one
context. A context whose sample occurs nowhere else holds no repeat; contexts
that are equal as a whole, by a 128-bit BLAKE2b digest of their bytes, are
repeats as a whole and stand in the index once.

What is left, different contexts of one sample, goes to an index. The suffixes
of a block of contexts are sorted, and the Burrows-Wheeler transform is kept as
runs with the text positions at run ends. Only at the start of a run can the
longest match of a suffix with the one before it in order exceed that of the
position to its left less one, so the matching statistics of every position
stream from the sampled ones: a match of n bytes at a sample covers n bytes
there and at its partner. Matches of ``LENGTH`` bytes or more are marked. In
repetitive text there are few runs, so few comparisons.

A sample that very many contexts share is dealt out as pairs of bounded blocks.
Nothing is dropped: each two contexts of a sample share an index.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` bytes
have no removals; rows that repeat an id are documents of their own, and if
their texts are equal each repeats the other; a null id stays null; further
columns stay as they are; an empty table gives an empty result. Where a cut
falls within a character, the ``kept`` bytes are exact and the text loses the
rest of that character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

#: Bytes of a string that must not repeat, and bytes of its sample.
LENGTH, GRAM = 200, 64
#: Window starts that are hashed at a time; bits that hold a place among them.
PIECE, PLACE = 2 << 20, np.uint64((1 << 22) - 1)
#: Contexts that a block may have, at least and at most; contexts that share an index.
BLOCK_LEAST, BLOCK, INDEXED = 1024, 2048, 2500
#: Suffixes that are compared at a time.
COMPARED = 8192


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, key, digests, start, end) of every context of texts laid end to end; places within the row."""
    found: list[tuple[np.ndarray, ...]] = []
    wide = length - gram + 1
    for a in range(0, len(data), PIECE):
        piece = data[a : a + PIECE + length - 1]
        if len(piece) < length:
            break
        spans = common.Spans(piece)
        n = len(piece) - gram + 1
        hashes = common.mix((spans.sums[gram:] - spans.sums[:n]) * spans.back[:n])
        least = (hashes & ~PLACE) | np.arange(n, dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        place = (least & PLACE).astype(np.int64)
        # Windows that cross into the next text do not count.
        edges = offsets[(offsets > a) & (offsets < a + len(piece))] - a
        cross = np.zeros(len(place) + 1, dtype=np.int64)
        np.add.at(cross, np.maximum(edges - length + 1, 0), 1)
        np.add.at(cross, np.minimum(edges, len(place)), -1)
        good = np.cumsum(cross[:-1]) == 0
        other = np.ones(len(place) + 1, dtype=bool)
        other[1:-1] = (place[1:] != place[:-1]) | (good[1:] != good[:-1])
        start = np.flatnonzero(good & other[:-1])
        stop = np.flatnonzero(good & other[1:]) + length
        at = place[start]
        row = np.searchsorted(offsets, a + start, side="right") - 1
        raw = piece.tobytes()
        digest = b"".join(hashlib.blake2b(raw[b:c], digest_size=16).digest() for b, c in zip(start.tolist(), stop.tolist()))
        found.append((row, hashes[at], np.frombuffer(digest, "<i8").reshape(-1, 2), a + start - offsets[row], a + stop - offsets[row]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.reshape(0, 2), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of several strings, with sampled run ends."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        """``data``: the strings end to end. Each gets an end mark that sorts before all bytes."""
        count = len(lengths)
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.n = n = len(data) + count
        text = np.zeros(n, dtype=np.int16)
        solid = np.ones(n, dtype=bool)
        solid[self.starts + lengths] = False
        text[solid] = data.astype(np.int16) + 1
        self.text = text
        order = self._sort()
        before = text[order - 1]
        # A string's first symbol starts a run, as no match goes on across an end mark.
        change = before == 0
        change[0] = True
        change[1:] |= before[1:] != before[:-1]
        #: First place of each run, its symbol, and text positions at its start and at the end of the run before.
        self.heads = np.flatnonzero(change)
        self.symbols = before[self.heads]
        self.first = order[self.heads]
        self.last_before = order[self.heads - 1]

    def _sort(self) -> np.ndarray:
        """Suffixes in order, by doubling; only those not yet told apart are sorted again."""
        n, bits, per = self.n, 9, 6
        padded = np.concatenate([self.text, np.zeros(per, dtype=np.int16)]).astype(np.int64)
        key = padded[:n]
        for k in range(1, per):
            key = (key << bits) | padded[k : k + n]
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        group = np.flatnonzero(fresh)
        size = np.diff(np.append(group, n))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.repeat(group, size)
        active = order[np.repeat(size, size) > 1]
        reach = per
        while len(active):
            after = active + reach
            own = rank[active]
            key = (own << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            active, key, own = active[by], key[by], own[by]
            at = np.arange(len(active))
            lead = np.ones(len(active), dtype=bool)
            lead[1:] = own[1:] != own[:-1]
            slot = own + at - np.maximum.accumulate(np.where(lead, at, 0))
            order[slot] = active
            lead[1:] = key[1:] != key[:-1]
            group = np.flatnonzero(lead)
            size = np.diff(np.append(group, len(active)))
            rank[active] = np.repeat(slot[group], size)
            active = active[np.repeat(size, size) > 1]
            reach *= 2
        return order

    def matches(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, end) of the matches of ``least`` symbols or more at run starts and their partners.

        Together they cover every string of that length that starts twice.
        """
        left, right = self.first[1:], self.last_before[1:]
        good = np.flatnonzero(np.maximum(left, right) + least <= self.n)
        # Most pairs part early; a few far symbols tell.
        for far in (least - 1, least // 2, least // 4, 3 * least // 4, 0):
            good = good[self.text[left[good] + far] == self.text[right[good] + far]]
        left, right = left[good], right[good]
        length = np.zeros(len(left), dtype=np.int64)
        step = 64
        for at in range(0, len(left), COMPARED):
            where = np.arange(at, min(at + COMPARED, len(left)))
            while len(where):
                # Compare the next symbols of those that still agree; an end mark ends a match.
                a = left[where, None] + length[where, None] + np.arange(step)
                b = right[where, None] + length[where, None] + np.arange(step)
                one = self.text[np.minimum(a, self.n - 1)]
                same = (one == self.text[np.minimum(b, self.n - 1)]) & (one > 0) & (np.maximum(a, b) < self.n)
                run = np.where(same.all(axis=1), step, same.argmin(axis=1))
                length[where] += run
                where = where[run == step]
        good = np.flatnonzero(length >= least)
        at = np.concatenate([left[good], right[good]])
        span = np.concatenate([length[good], length[good]])
        string = np.searchsorted(self.starts, at, side="right") - 1
        begin = at - self.starts[string]
        return string, begin, begin + span


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, digest, spans) of the rows with repeats: byte spans that together hold every repeated string.

    ``digest`` is xxhash64 of the text, so rows that share an id stay apart. A
    span has its start in its upper 32 bits and its end in the lower. Spans may
    overlap.
    """
    spark = docs.sparkSession
    common.scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))

    @common.tidy
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text"):
            row, key, digest, start, end = contexts(*common.utf8(batch.column("text")), length, gram)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("digest").take(at), pa.array(key.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(start << 32 | end)], ["id", "digest", "key", "c1", "c2", "span"])

    found = common.cut(rows.where(F.octet_length("text") >= length).mapInArrow(sample, "id long, digest long, key long, c1 long, c2 long, span long"), "contexts")
    shared = common.cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"), F.col("n").alias("_n")), "samples")
    total = _total(shared, "_n")
    again = common.cut(common.join_counted(found, shared, {"key": "_key"}, "_n", total).drop("_key", "_n"), "shared")
    for done in (found, shared):
        common.forget(spark, done.cut_path)
    classes = common.cut(again.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "digest", "span")).alias("one")), "classes")
    copies = classes.where("n > 1").select(F.col("key").alias("_key"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("n").alias("_n"))
    whole = common.join_counted(again, copies, {"key": "_key", "c1": "_c1", "c2": "_c2"}, "_n", total).select("id", "digest", "span")

    # Contexts that share a sample with others that differ: their bytes are compared.
    several = common.cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).where("k > 1 and low = 1").select(F.col("key").alias("_key"), F.col("k").alias("_k")), "several")
    wanted = common.join_counted(classes, several, {"key": "_key"}, "_k", _total(several, "_k")).select("key", "n", "one.*")
    wanted = wanted.groupBy("id", "digest").agg(F.collect_list(F.struct("key", "n", "span")).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "wanted")
    holders = rows.join(wanted.hint("merge"), _same("id", "_id") & (F.col("digest") == F.col("_digest"))).select("id", "digest", F.encode("text", "utf-8").alias("bytes"), F.explode("wanted").alias("w"))
    start = F.shiftright("w.span", 32).cast("int")
    held = holders.select("w.key", "id", "digest", start.alias("start"), (F.col("w.n") == 1).alias("single"), F.substring("bytes", start + 1, F.col("w.span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") - start).alias("bytes"))
    # Rows that repeat an id and a text hold a context several times; it is wanted once.
    held = common.cut(held.dropDuplicates(["key", "id", "digest", "start"]), "held")
    units = common.pair_blocks(held.withColumn("uid", F.xxhash64("id", "digest", "start")), "key", "uid", least=BLOCK_LEAST, most=BLOCK)

    @common.tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in common.whole_groups(batches, ["key", "bi", "bj"], INDEXED):
            # A context of several units of one sample must not match itself.
            _, once = np.unique(np.stack([table.column(c).to_numpy() for c in ("key", "uid")]), axis=1, return_index=True)
            table = table.take(pa.array(once))
            raw = table.column("bytes").to_pylist()
            string, start, end = RunIndex(np.frombuffer(b"".join(raw), dtype=np.uint8), np.array(list(map(len, raw)), dtype=np.int64)).matches(length)
            single = table.column("single").to_numpy(zero_copy_only=False)[string]
            string, start, end = string[single], start[single], end[single]
            origin = table.column("start").to_numpy()[string].astype(np.int64)
            picked = table.select(["id", "digest"]).take(pa.array(string)).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in picked.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((origin + start) << 32 | (origin + end))], ["id", "digest", "span"])

    partial = units.select("key", "bi", "bj", "uid", "id", "digest", "start", "single", "bytes").mapInArrow(index, "id long, digest long, span long")
    marks = whole.union(partial).groupBy("id", "digest").agg(F.collect_set("span").alias("spans"))
    marks = common.cut(marks, "repeats")
    for done in (again, classes, several, held):
        common.forget(spark, done.cut_path)
    return marks


def _total(df: DataFrame, count: str) -> int:
    return df.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without repeated strings, and n_bytes, n_removed, n_spans and the ``kept`` bytes.

    Of every string of ``length`` bytes that also starts anywhere else, all
    bytes go, judged on the input. Columns of ``docs`` with the names of the
    added ones are replaced.
    """
    docs = docs.select(*common.without(docs.columns, ["n_bytes", "n_removed", "n_spans", "kept"]))
    return _remove(docs, id_col, text_col, length, gram, True)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with texts without repeated strings; a document of which nothing is left goes."""
    return _remove(docs, id_col, text_col, length, gram, False)


def _remove(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, figures: bool) -> DataFrame:
    found = repeats(docs, id_col, text_col, length, gram).select(F.col("id").alias("_run_id"), F.col("digest").alias("_run_digest"), F.col("spans").alias("_run_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn("_run_own", F.xxhash64(text)).withColumn("_run_key", F.col(id_col).cast("long"))
    joined = joined.join(found.hint("merge"), _same("_run_key", "_run_id") & (F.col("_run_own") == F.col("_run_digest")), "left")
    names = [f.name for f in docs.schema.fields]
    joined = joined.select(*docs.columns, "_run_spans")

    @common.tidy
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, text_col):
            data, offs = common.utf8(batch.column(text_col))
            kept, size, removed, runs = [], [], [], []
            for a, b, spans in zip(offs, offs[1:], batch.column("_run_spans")):
                own = data[a:b]
                if not spans.is_valid:
                    kept.append(own.tobytes())
                    removed.append(0)
                    runs.append(0)
                else:
                    spans = spans.values.to_numpy()
                    depth = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(depth, spans >> 32, 1)
                    np.add.at(depth, spans & 0xFFFFFFFF, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    kept.append(own[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                size.append(len(own))
            texts = [None if not was else k.decode("utf-8", errors="ignore") for was, k in zip(batch.column(text_col).is_valid().to_pylist(), kept)]
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            if not figures:
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not (r and r == z) for r, z in zip(removed, size)], pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    added = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(strip, T.StructType([*docs.schema.fields, *(added if figures else [])]))

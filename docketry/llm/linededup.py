"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words; lines without words are left alone. Of equal
lines the earliest stays, by document id, digest of the document's text and
line number. A line also goes if an earlier one is within the edit bound: one
word replaced, added or left out, in a pair whose longer line has at least five
words.

One pass over the texts gives a row for each line and a compressed copy of each
document; no text is shuffled but in that form. Equal lines are one row, told
by a 128-bit BLAKE2b digest of their words. For each such line all variants with
one word deleted are emitted as hashed keys, and equal keys are joined: two
lines of the same length are one replacement apart if they agree without the
word at the same place, and a line is one word longer than another if one of
its variants is the other. Joining goes through the earliest line of each key,
so a key that very many lines share costs as many rows as it has lines.
Candidates are then verified word by word.

Most lines have no near relative, and their variants are not emitted: an edit
falls in one half of the longer line and leaves the other half as it is, so a
line none of whose halves is shared by a line of fitting length is settled by
two to four hashes. This leaves no pair out.

Joins are sort-merge joins at every size, whose hot keys adaptive execution
splits; the side that is joined to is a table with one row for each key.

Defined cases: a null text has no lines; rows that repeat an id but not the
text are documents of their own; rows that repeat both are one document, and a
line of theirs is kept or dropped alike; rows without an id keep all lines and
make no other line go; further columns stay as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

#: Words of the longer line of a near pair, at least, for one edit to be within the bound.
LEAST_WORDS = 5
#: Blanks that separate words, but the line break.
BLANK = "\t\x0b\x0c\r "
#: Columns of the rows of documents and lines.
ID, DIGEST, TEXT, BYTES, LINE = "_ld_id", "_ld_digest", "_ld_text", "_ld_bytes", "_ld_line"
KEYS = ["k1", "k2", "k3", "k4"]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line number, begin and end of words, first word, end of words) of the lines with words."""
    begin, end, _ = common.tokens_of(data, offsets)
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line = np.searchsorted(starts, begin, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
    stop = np.append(first[1:], len(begin))[: len(first)]
    row = np.searchsorted(offsets, begin[first], side="right") - 1
    number = line[first] - np.searchsorted(starts, offsets[row])
    return row, number, begin, end, first, stop


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """BLAKE2b of each line's words, joined by single spaces, as two 64-bit integers."""
    raw = data.tobytes()
    # Lines whose words are already one space apart are hashed in place.
    odd = np.zeros(len(begin) + 1, dtype=np.int64)
    odd[2:] = np.cumsum((begin[1:] != end[:-1] + 1) | (data[np.minimum(end[:-1], len(data) - 1)] != 32))
    plain = odd[stop] == odd[first + 1]
    spans = zip(begin[first].tolist(), end[stop - 1].tolist(), plain.tolist())
    made = b"".join(hashlib.blake2b(raw[a:b] if ok else b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b, ok in spans)
    return np.frombuffer(made, dtype="<i8").reshape(-1, 2)


def halves(spans: common.Spans, first: np.ndarray, stop: np.ndarray, least: int = LEAST_WORDS) -> list[np.ndarray]:
    """Hashes of the halves that an edit leaves alone; 0: none.

    Two lines of n words, or of n and n - 1, are near only if they share their
    first or last n // 2 words; a line of odd length may be the shorter one of
    a pair of the next class.
    """
    n = stop - first
    found = []
    for c, own in ((n // 2, n >= least - 1), ((n + 1) // 2, (n % 2 == 1) & (n + 1 >= least))):
        mark = common.mix(c.astype(np.uint64))
        for k, part in enumerate((spans.of(first, first + c), spans.of(stop - c, stop))):
            key = common.mix((part ^ mark) + np.uint64(k + 1)) | np.uint64(1)
            found.append(np.where(own, key, np.uint64(0)))
    return found


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word at most must be replaced, added or left out to make a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at:] == b[at + 1 :] or a[at + 1 :] == b[at + 1 :]


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the size, so that cost grows evenly and a hot key may be split."""
    return left.join(right.hint("merge"), on, how)


def _scan(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, dict[str, str]]:
    """A row for each document (line -1; the text compressed) and one for each of its lines with words.

    Columns of ``docs`` have names of their own there, which are returned as well.
    """
    others = {f.name: (f"_ld_{k}", f.dataType) for k, f in enumerate(docs.schema.fields) if f.name != text_col}
    text = F.col(text_col).cast("string")
    named = docs.select(*(F.col(c).alias(own) for c, (own, _) in others.items()), F.col(id_col).cast("long").alias(ID), F.xxhash64(text).alias(DIGEST), text.alias(TEXT))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in common.parts(batches, TEXT):
            data, offs = common.utf8(batch.column(TEXT))
            raw, n = data.tobytes(), len(batch)
            valid = batch.column(TEXT).is_valid().to_pylist()
            blobs = pa.array([squeeze(raw[a:b]) if ok else None for a, b, ok in zip(offs, offs[1:], valid)], pa.binary())
            given = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*given, blobs, pa.array(np.diff(offs)), pa.array(np.full(n, -1, dtype=np.int32)), *[pa.nulls(n, pa.int64())] * 6], schema.names)
            # Lines of rows without an id take no part.
            row, number, begin, end, first, stop = lines_of(data, offs)
            part = batch.column(ID).is_valid().to_numpy(zero_copy_only=False)[row]
            row, number, first, stop = row[part], number[part], first[part], stop[part]
            exact = digests(data, begin, end, first, stop)
            keys = [pa.array(k.view(np.int64), mask=k == 0) for k in halves(common.Spans(common.word_hashes(data, begin, end)), first, stop, least)]
            at, m = pa.array(row), len(row)
            empty = [pa.nulls(m, c.type) for c in given[:-2]]
            yield pa.RecordBatch.from_arrays([*empty, *(c.take(at) for c in given[-2:]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(number.astype(np.int32)), pa.array(exact[:, 0]), pa.array(exact[:, 1]), *keys], schema.names)

    own = [(ID, T.LongType()), (DIGEST, T.LongType()), (TEXT, T.BinaryType()), (BYTES, T.LongType()), (LINE, T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType()), *((k, T.LongType()) for k in KEYS)]
    schema = T.StructType([T.StructField(n, t) for n, t in [*others.values(), *own]])
    return common.cut(named.mapInArrow(run, schema), "lines"), {c: n for c, (n, _) in others.items()}


def _decisions(held: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """(id, digest, kept, near): of each document with an id the lines that are the earliest of their words, and those of them that go as near copies; paths to forget."""
    at = F.struct(F.col(ID).alias("id"), F.col(DIGEST).alias("digest"), F.col(LINE).alias("line"))
    every = held.where(F.col(LINE) >= 0).select(at.alias("at"), "h1", "h2", *KEYS)
    distinct = common.cut(every.groupBy("h1", "h2").agg(F.min("at").alias("at"), *(F.first(k).alias(k) for k in KEYS)).drop("h1", "h2"), "distinct-lines")

    spark = held.sparkSession
    common.release(spark)
    half = distinct.select("at", F.explode(F.array_compact(F.array(*KEYS))).alias("key"))
    shared = common.cut(half.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key")), "shared-halves")
    likely = _merge(half, shared, F.col("key") == F.col("_key")).select("at.*")
    wanted = common.cut(likely.groupBy("id", "digest").agg(F.collect_set("line").alias("wanted")), "wanted-lines")
    common.forget(spark, shared.cut_path)
    common.release(spark)
    docs = held.where(F.col(LINE) == -1).select(ID, F.col(DIGEST).alias("_digest"), TEXT, BYTES)
    found = _merge(docs, wanted, (F.col(ID) == F.col("id")) & (F.col("_digest") == F.col("digest"))).select("id", "digest", TEXT, BYTES, "wanted")

    @common.tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in common.parts(batches, BYTES):
            row, number, text = [], [], []
            for k, (blob, lines) in enumerate(zip(batch.column(TEXT).to_pylist(), batch.column("wanted").to_pylist())):
                all_lines = expand(blob).split(b"\n")
                row += [k] * len(lines)
                number += lines
                text += [b" ".join(all_lines[n].split()).decode() for n in lines]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("digest").take(take), pa.array(number, pa.int32()), pa.array(text, pa.string())], ["id", "digest", "line", "text"])

    texts = found.mapInArrow(pick, "id long, digest long, line int, text string").dropDuplicates(["id", "digest", "line"])
    texts = common.cut(texts, "line-texts")
    common.forget(spark, wanted.cut_path)
    common.release(spark)

    @common.tidy
    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text"):
            data, offs = common.utf8(batch.column("text"))
            row, _, begin, end, first, stop = lines_of(data, offs)
            spans = common.Spans(common.word_hashes(data, begin, end))
            n = stop - first
            # Long lines have many variants, so few lines are taken at a time.
            block = (np.cumsum(n) - n) // VARIANTS
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(n)] if len(n) else []
            for a, b in zip(edges, edges[1:]):
                key, kind, line = _variants(spans, first[a:b], stop[a:b], row[a:b], least)
                take = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), *(batch.column(c).take(take) for c in ("id", "digest", "line"))], ["key", "kind", "id", "digest", "line"])

    emitted = common.cut(texts.mapInArrow(variants, "key long, kind byte, id long, digest long, line int"), "variants")
    common.release(spark)
    at = F.struct("id", "digest", "line")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, at)).alias(f"first{kind}")
    met = common.cut(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first(0), first(1), first(2)).where("n > 1").withColumnRenamed("key", "_key"), "met-variants")
    other = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = _merge(emitted, met, F.col("key") == F.col("_key")).select("id", "digest", "line", other.alias("other")).where(F.col("other") < at).distinct()
    pairs = common.cut(pairs, "near-pairs")
    for done in (emitted, met):
        common.forget(spark, done.cut_path)
    common.release(spark)
    later = texts.select(F.struct("id", "digest", "line").alias("_at"), "text")
    both = _merge(pairs.select(at.alias("at"), "other"), later, F.col("at") == F.col("_at")).select("at", "other", "text")
    both = _merge(both, texts.select(F.struct("id", "digest", "line").alias("_at"), F.col("text").alias("earlier")), F.col("other") == F.col("_at"))

    @common.tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.encode().split(), b.encode().split()) for a, b in zip(batch.column("text").to_pylist(), batch.column("earlier").to_pylist())]
            yield batch.select(["id", "digest", "line"]).filter(pa.array(good, pa.bool_()))

    near = both.select("at.*", "text", "earlier").mapInArrow(verify, "id long, digest long, line int").withColumn("near", F.lit(1))
    told = distinct.select("at.*", F.lit(0).alias("near")).union(near)
    lists = [F.collect_set(F.when(F.col("near") == k, F.col("line"))).alias(n) for k, n in ((0, "kept"), (1, "near"))]
    return told.groupBy("id", "digest").agg(*lists), [x.cut_path for x in (distinct, texts, pairs)]


#: Variants that are hashed at a time.
VARIANTS = 1 << 18


def _variants(spans: common.Spans, first: np.ndarray, stop: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, row): lines without one word by place (0) or anywhere (1), and whole lines (2)."""
    n = stop - first
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # The polynomial of what is left: what stands behind the deleted word moves one place forward.
    head = spans.raw(first[of], first[of] + place)
    tail = spans.raw(first[of] + place + 1, stop[of])
    left = common.mix(head + tail * common.powers(common.BASE, int(n.max(initial=0)) + 1)[place] + common.mix((n[of] - 1).astype(np.uint64)))
    long = n[of] >= least
    same = common.mix(left ^ common.mix(place.astype(np.uint64) + np.uint64(1)))
    kinds = [(same[long], of[long], 0), (left[long], of[long], 1), (spans.of(first, stop), np.arange(len(n)), 2)]
    key = np.concatenate([k for k, _, _ in kinds])
    kind = np.concatenate([np.full(len(k), c, dtype=np.int8) for k, _, c in kinds])
    return key, kind, row[np.concatenate([o for _, o, _ in kinds])]


def _apply(docs: DataFrame, id_col: str, text_col: str, least: int, figures: bool) -> DataFrame:
    common.scratch(docs.sparkSession)
    held, inner = _scan(docs, id_col, text_col, least)
    told, done = _decisions(held, least)
    told = common.cut(told, "line-decisions")
    for path in done:
        common.forget(docs.sparkSession, path)
    common.release(docs.sparkSession)
    told = told.select(F.col("id").alias("_told_id"), F.col("digest").alias("_told_digest"), "kept", "near")
    whole = held.where(F.col(LINE) == -1).select(*inner.values(), ID, DIGEST, TEXT, BYTES)
    joined = _merge(whole, told, (F.col(ID) == F.col("_told_id")) & (F.col(DIGEST) == F.col("_told_digest")), "left")
    names = docs.columns

    @common.tidy
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in common.parts(batches, BYTES):
            texts, count, removed, near, lost = [], [], [], [], []
            for name, blob, kept, gone in zip(*(batch.column(c).to_pylist() for c in (ID, TEXT, "kept", "near"))):
                text = None if blob is None else expand(blob).decode()
                lines = [] if text is None else text.split("\n")
                gone = set(gone or ())
                stay = lines
                if name is not None and len(kept or ()) - len(gone) < len(lines):
                    own = set(kept or ()) - gone
                    stay = [line for n, line in enumerate(lines) if n in own or not line.strip(BLANK)]
                texts.append(text if len(stay) == len(lines) else "\n".join(stay))
                count.append(len(lines))
                removed.append(len(lines) - len(stay))
                near.append(len(gone) if text is not None else 0)
                lost.append(len(stay) < len(lines) and not any(line.strip(BLANK) for line in stay))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(inner[c]) for c in names]
            if figures:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (count, removed, near))], [*names, "n_lines", "n_removed", "n_near"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not x for x in lost], pa.bool_()))

    added = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed", "n_near")] if figures else []
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    return joined.drop("_told_id", "_told_digest").mapInArrow(rebuild, T.StructType([*fields, *added]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the lines that stay, and n_lines, n_removed (of them n_near near copies).

    Columns of ``docs`` with these names are replaced.
    """
    return _apply(docs.select(*common.without(docs.columns, ["n_lines", "n_removed", "n_near"])), id_col, text_col, least, True)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the lines that stay; a document that loses all its words goes."""
    return _apply(docs, id_col, text_col, least, False)

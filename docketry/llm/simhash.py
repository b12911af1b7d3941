"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32 bits. Of two
fingerprints that differ in at most three bits, one segment differs in at most
one bit. So each segment is indexed under its exact value and under its 32
variants with one bit wiped out: equal segments meet under the exact value,
segments one bit apart under the variant without that bit. Rows of equal keys
are joined and verified on the whole fingerprints.

Equal fingerprints are one row throughout. A key that many fingerprints share
is dealt out as pairs of bounded blocks, and of the verified links of a block
pair only a spanning forest is kept, so nothing grows with the square of a
group and no link between groups is lost.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; a text with one or two words is
one shingle; rows that repeat an id are rows of their own with that id; a null
id never links and has no component; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import common

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Shingles whose bits are counted at a time.
AT_ONCE = 200_000
#: Groups up to this size are compared pair by pair in one go.
SMALL = 48


def fingerprint_texts(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as unsigned 64-bit integers."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    votes = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        if held:
            hashes = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(votes, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            held.clear()
            rows.clear()

    waiting = 0
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < shingle:
            hashes = np.array([digest(b" ".join(words))], dtype=np.uint64)
        else:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle))))), dtype=np.uint64, count=len(words) - shingle + 1)
        total[row] = len(hashes)
        for at in range(0, len(hashes), AT_ONCE):
            piece = hashes[at : at + AT_ONCE]
            held.append(piece)
            rows.append(row)
            waiting += len(piece)
            if waiting >= AT_ONCE:
                flush()
                waiting = 0
    flush()
    set_bits = votes * 2 > total[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel() if len(texts) else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; with ``digest`` one of the exact text as well."""
    common.scratch(docs.sparkSession)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.parts(batches, "text"):
            data, offs = common.utf8(batch.column("text"))
            raw = data.tobytes()
            found = fingerprint_texts([raw[a:b] for a, b in zip(offs, offs[1:])])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "fp"])

    names = ["id", "own"] if digest else ["id"]
    text = F.col(text_col).cast("string")
    columns = [F.col(id_col).cast("long").alias("id"), *([_digest(text).alias("own")] if digest else []), text.alias("text")]
    return docs.select(*columns).mapInArrow(run, "".join(f"{n} long, " for n in names) + "fp long")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _variants() -> list:
    """Keys of a fingerprint: segment, wiped bit (32: none), value."""
    keys = []
    for segment in (0, 1):
        value = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(33):
            mask = 0xFFFFFFFF & ~(1 << bit) if bit < 32 else 0xFFFFFFFF
            keys.append(value.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((segment << 38) | (bit << 32))))
    return keys


def link(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect all (rep, fp) rows at most ``distance`` <= 3 bits apart.

    ``fps`` has one row per fingerprint. The edges are a spanning subset.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wiped bit find up to 3 differing bits")
    keyed = fps.select("rep", "fp", F.explode(F.array(*_variants())).alias("key"))
    # Which half holds the segment that the key was made of; a wiped bit must occur both ways.
    segment = F.when(F.col("key").bitwiseAND(F.lit(1 << 38)) == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    exact = F.shiftright("key", 32).bitwiseAND(F.lit(63)) == 32
    both = [F.min("_seg").alias("_lo"), F.max("_seg").alias("_hi")]
    units = common.pair_blocks(keyed.withColumn("_seg", segment), "key", "fp", (F.col("_lo") != F.col("_hi")) | exact, both)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, ["key", "bi", "bj"]):
            rep = table.column("rep").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.diff(np.append(starts, len(table)))
            left, right = [], []
            small = sizes <= SMALL
            pos = np.concatenate([[0], np.cumsum(sizes[small] * (sizes[small] - 1) // 2)])
            step = 0
            s, z = starts[small], sizes[small]
            while step < len(s):
                stop = max(step + 1, int(np.searchsorted(pos, pos[step] + 2_000_000)))
                i, j = common.pairs_within(s[step:stop], z[step:stop])
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                left.append(i[ok])
                right.append(j[ok])
                step = stop
            for at, size in zip(starts[~small], sizes[~small]):
                own = fp[at : at + size]
                i, j = common.forest(size, lambda a, b, own=own: np.bitwise_count(own[a][:, None] ^ own[b][None, :]) <= distance)
                left.append(i + at)
                right.append(j + at)
            i, j = np.concatenate(left), np.concatenate(right)
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            if len(a):
                a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return units.select("key", "bi", "bj", "rep", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fingerprint (hex) and component_id.

    ``component_id`` is the smallest id reachable by links of fingerprints at
    most ``distance`` bits apart.
    """
    held = common.cut(fingerprints(docs, id_col, text_col), "simhash")
    fps = common.cut(held.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    found = common.components(link(fps, distance), "simhash-links")
    by_fp = fps.join(found, F.col("rep") == F.col("id"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    out = held.join(by_fp, F.col("fp") == F.col("_fp"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` without those whose group has a smaller id; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, distance).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Exactly one row of ``docs`` for each group of near duplicates.

    Groups are of texts, so rows that repeat an id fall together only if their
    texts are near, and rows without an id take part. The smallest id stays, of
    its texts the one with the smallest digest, of equal texts the first row as
    JSON; a row without an id stays only where the group has no id.
    """
    held = common.cut(fingerprints(docs, id_col, text_col, digest=True), "simhash")
    rows = held.groupBy("fp", "id", "own").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "own", "n")
    fps = common.cut(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-reps")
    found = common.components(link(fps.select(F.col("fp").alias("rep"), "fp"), distance), "simhash-links")
    best = fps.join(found, F.col("fp") == F.col("id"), "left").groupBy(F.coalesce("component_id", "fp").alias("group")).agg(F.min("first").alias("first"))
    best = common.cut(best.select(F.col("first.id").alias("_first_id"), F.col("first.own").alias("_first_own"), F.col("first.n").alias("_first_n")), "simhash-first")
    joined = docs.withColumn("_own", _digest(F.col(text_col).cast("string"))).withColumn("_key", F.col(id_col).cast("long"))
    joined = joined.join(best, F.col("_key").eqNullSafe(F.col("_first_id")) & (F.col("_own") == F.col("_first_own")))
    if best.where("_first_n > 1").isEmpty():
        return joined.select(*docs.columns)
    row = F.struct(*docs.columns)
    again = joined.where("_first_n > 1").groupBy("_first_id", "_first_own").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return joined.where("_first_n = 1").select(*docs.columns).union(again.select("_row.*"))

"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2``: the matrix products
and the attention within the piece. Documents are taken in windows of bounded
size within a partition, so nothing is shuffled and a lost task repeats only
its own window. In a window, whole sequences are cut off documents that are
too long; what remains of each goes, in descending order, to the sequence of
lowest cost among those with enough room. There are just as many sequences as
the tokens need, so a document that fits nowhere is cut and fills the gaps.
Only the last sequence of a window has padding.

Ids come from tiktoken with the vocabulary's own ranks, the fastest encoder at
hand. Its pattern engine gives up on very long runs of white space; such a text
goes to the tokenizers library, which is slower and gives the same ids.

Defined cases: a null or empty text is the end token alone; special tokens of
the vocabulary are found in texts; texts may be of any length and have runs of
any length; repeated rows are packed as documents of their own; a null id stays
null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import common, vocab

SEQUENCE, END = 1024, 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that a window holds before it is packed.
WINDOW = 2_000_000


class Coder:
    """Encodes texts with the vocabulary of a tokenizer file."""

    def __init__(self, content: bytes):
        found = vocab.load(content)
        self.fast = tiktoken.Encoding("packing", pat_str=vocab.PATTERN, mergeable_ranks={t: n for n, t in found.tokens.items()}, special_tokens=dict(found.special))
        self.content = content

    @functools.cached_property
    def library(self) -> Tokenizer:
        made = Tokenizer.from_str(self.content.decode())
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern engine's stack: a long run of white space
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(content: bytes) -> Coder:
    """One encoder for each vocabulary and worker."""
    return Coder(content)


def ids_of(coder: Coder, text: str | None, end: int = END) -> np.ndarray:
    """The document's ids with the end token, as little-endian 32-bit integers."""
    own = coder.encode(text) if text else np.zeros(0, np.uint32)
    return np.append(own, np.uint32(end)).astype("<u4", copy=False)


def pack(lengths: np.ndarray, sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Rows (document, start, length, sequence number, offset) for documents of these lengths.

    Every token lies in one piece, no sequence is longer than ``sequence``, and
    all but the last few are full.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    full = lengths // sequence
    out: list[tuple[int, int, int, int, int]] = []
    number = 0
    for doc in np.flatnonzero(full):
        for k in range(full[doc]):
            out.append((int(doc), k * sequence, sequence, number, 0))
            number += 1
    rest = lengths - full * sequence
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    count = int(-(-rest.sum() // sequence))
    cost = np.zeros(count)
    room = np.full(count, sequence, dtype=np.int64)
    if count:
        room[-1] -= count * sequence - rest.sum()  # what is left over is one sequence's padding
    used = np.zeros(count, dtype=np.int64)
    price = lambda n: linear * n + quadratic * n * n
    for doc in order:
        start, left = int(full[doc] * sequence), int(rest[doc])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            at = int(fits.argmin())
            take = left
            if fits[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[at])
            out.append((int(doc), start, take, number + at, int(used[at])))
            cost[at] += price(take)
            used[at] += take
            room[at] -= take
            start, left = start + take, left - take
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end: int = END, window: int = WINDOW, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and ids.

    ``ids`` are the piece's ids as little-endian 32-bit integers. Sequence ids
    tell the partition in their upper bits.
    """
    common.scratch(docs.sparkSession)
    content = vocab.read(tokenizer_path)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(content)
        first = TaskContext.get().partitionId() << 33
        names: list[int | None] = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, waiting, first
            rows = pack(np.array([len(x) for x in held]), sequence, linear, quadratic)
            doc, start, length, number, offset = rows.T
            views = [memoryview(held[d])[s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            columns = [pa.array([names[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array([zlib.crc32(v) for v in views], pa.int64()), pa.array([len(held[d]) for d in doc], pa.int64()), pa.array(number + first), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([v.tobytes() for v in views], pa.binary()))
            first += int(number.max()) + 1
            names, held, waiting = [], [], 0
            return pa.RecordBatch.from_arrays(columns, fields)

        for batch in common.parts(batches, "text"):
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                names.append(name)
                held.append(ids_of(coder, text, end))
                waiting += len(held[-1])
                if waiting >= window:
                    yield flush()
        if held:
            yield flush()

    fields = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


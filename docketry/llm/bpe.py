"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch, sorted by their bytes, are the paths of a trie
in depth-first order: each word leaves the path of the word before at their
common prefix. At every node the last token of the encoding of the bytes so
far is kept, so the states of a shared prefix are computed once.

The state of a node follows from states above it. A sequence of tokens is what
the merges produce exactly if each two neighbours are what they produce from
those two tokens' bytes. So the last token at a node is the one token that ends
there and goes with the last token of the node where it begins; the encoding
of a word is read off by following last tokens back to the root. Which tokens
end at a node, the longest first, is what an automaton over all tokens tells
with one step a byte, however long the word.

Defined cases: a null text counts as empty and has no ids; special tokens of
the vocabulary are found in texts first, as the tokenizers library does;
repeated rows are encoded as rows of their own; a null id stays null; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common, vocab

#: Words whose encodings a worker keeps between batches, their letters at most, and pairs of tokens it has judged.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 600_000, 64, 1_000_000


class TrieEncoder:
    """Encodes words and texts with a byte-level BPE vocabulary."""

    def __init__(self, content: bytes):
        found = vocab.load(content)
        self.bytes_of = [b""] * (1 + max([*found.tokens, *found.special.values()]))
        for n, text in found.tokens.items():
            self.bytes_of[n] = text
        for text, n in found.special.items():
            self.bytes_of[n] = text.encode()
        self.special = found.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(found.special, key=len, reverse=True))) + ")") if found.special else None
        self.words = regex.compile(vocab.PATTERN).findall
        # Tokens are numbered by the order in which merges make them, single bytes first.
        single = sorted(n for n, text in found.tokens.items() if len(text) == 1)
        self.rank = {n: k for k, n in enumerate(single)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.id_of = [*single]
        made = {found.tokens[n]: n for n in found.tokens}
        for a, b in found.merges:
            n = made[found.tokens[a] + found.tokens[b]]
            if n not in self.rank:
                self.rank[n] = len(self.id_of)
                self.id_of.append(n)
                self.halves[self.rank[n]] = (self.rank[a], self.rank[b])
            self.joined.setdefault((self.rank[a], self.rank[b]), self.rank[n])
        self.fits: dict[int, bool] = {}
        self.packed = [np.uint32(n).tobytes() for n in self.id_of]
        self.size = [len(self.bytes_of[n]) for n in self.id_of]
        self._link({found.tokens[n]: k for n, k in self.rank.items() if self._whole(k)})
        self.known: dict[str, bytes] = {}

    def _link(self, tokens: dict[bytes, int]) -> None:
        """The automaton: steps by (state, byte), where a state falls back to, and the longest token that ends there.

        ``shorter`` tells of each token the next longest one that ends it.
        """
        self.step: dict[int, int] = {}
        self.back, self.ends = array("i", [0]), array("i", [-1])
        owner = {}
        for text, k in tokens.items():
            state = 0
            for byte in text:
                key = state << 8 | byte
                state = self.step.get(key)
                if state is None:
                    state = self.step[key] = len(self.ends)
                    self.back.append(0)
                    self.ends.append(-1)
            self.ends[state], owner[state] = k, k
        below: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        for key, state in self.step.items():
            below[key >> 8].append((key & 255, state))
        self.shorter = array("i", [-1]) * len(self.id_of)
        level = [0]
        while level:
            for above in level:
                for byte, state in below[above]:
                    self.back[state] = self._after(self.back[above], byte) if above else 0
                    rest = self.ends[self.back[state]]
                    if state in owner:
                        self.shorter[owner[state]] = rest
                    else:
                        self.ends[state] = rest
            level = [state for above in level for _, state in below[above]]

    def _after(self, state: int, byte: int) -> int:
        """The state that a byte leads to."""
        while True:
            found = self.step.get(state << 8 | byte)
            if found is not None:
                return found
            if not state:
                return 0
            state = self.back[state]

    def _whole(self, k: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        return k not in self.halves or self._goes(*self.halves[k], below=k)

    def _goes(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge crosses the border before both tokens are complete.

        The last merges of both sides are undone in turn, latest first; a merge
        across the border that comes before the one just undone would have
        happened. ``below``: only merges before that one count.
        """
        limit = len(self.id_of) if below is None else below
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            open_left, open_right = left in self.halves, right in self.halves
            if not open_left and not open_right:
                return True
            if open_left and (not open_right or left > right):
                # Equal ranks merge from the left, so what is made on the left stands before.
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: dict[str, bytes] = {}
        fits, packed, size, ends, shorter, step, back = self.fits, self.packed, self.size, self.ends, self.shorter, self.step, self.back
        path = b""
        # Of each node the automaton's state and the last token alone; its encoding is read off by walking back to the root.
        states, last = array("i", [0]), array("i", [-1])
        for raw, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared, len(raw)):
                byte = raw[end]
                found = step.get(state << 8 | byte)
                while found is None and state:
                    state = back[state]
                    found = step.get(state << 8 | byte)
                state = found or 0
                states.append(state)
                token = ends[state]
                while token >= 0:
                    start = end + 1 - size[token]
                    if not start:
                        break
                    before = last[start]
                    key = before << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= KEPT_PAIRS:
                            fits.clear()
                        ok = fits[key] = self._goes(before, token)
                    if ok:
                        break
                    token = shorter[token]
                if token < 0:
                    raise ValueError(f"no token ends at byte {end + 1} of {raw!r}")
                last.append(token)
            path = raw
            tokens, at = [], len(raw)
            while at:
                tokens.append(packed[last[at]])
                at -= size[last[at]]
            out[word] = b"".join(reversed(tokens))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces: list[list[str] | bytes] = []
        spans = [0]
        for text in texts:
            for part in self.cut.split(text) if self.cut else [text]:
                if self.cut and part in self.special:
                    pieces.append(np.uint32(self.special[part]).tobytes())
                elif part:
                    pieces.append(self.words(part))
            spans.append(len(pieces))
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = set()
        for piece in pieces:
            if type(piece) is list:
                new.update(piece)
        new.difference_update(self.known)
        self.known |= self.encode_words(list(new))
        get = self.known.__getitem__
        coded = [piece if type(piece) is bytes else b"".join(map(get, piece)) for piece in pieces]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del self.known[word]
        return [b"".join(coded[a:b]) for a, b in zip(spans, spans[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> TrieEncoder:
    """One encoder for each vocabulary and worker."""
    return TrieEncoder(content)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row; ids as little-endian 32-bit integers.

    ``decode`` adds ``decoded``, the text that those ids stand for.
    """
    common.scratch(docs.sparkSession)
    content = vocab.read(tokenizer)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(content)
        # Larger pieces than elsewhere: the more words, the more beginnings they share.
        for batch in common.parts(batches, "text", 4 << 20):
            ids = coder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["id", "n_tokens", "ids"]
            if decode:
                columns.append(pa.array(map(coder.decode, ids), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary" + ", decoded string" * decode).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of rows with ids as little-endian 32-bit integers."""
    common.scratch(rows.sparkSession)
    content = vocab.read(tokenizer)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(content)
        for batch in common.parts(batches, "ids", 16 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([coder.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded string").withColumnRenamed("id", id_col)

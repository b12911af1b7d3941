"""A byte-level BPE vocabulary as the tokenizers library stores it, ready to ship to workers."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass
from pathlib import Path

import public_tokenizers

#: How byte-level BPE cuts a text into words; fixed by the vocabulary's format.
PATTERN = public_tokenizers.PATTERN


def read(path: str) -> bytes:
    """The tokenizer file as bytes, read once by the driver."""
    return Path(path).read_bytes()


def _printable() -> dict[str, int]:
    """The byte that each character of a stored token stands for.

    Printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes by id, merges as pairs of ids in order of rank, and special tokens."""

    tokens: dict[int, bytes]
    merges: list[tuple[int, int]]
    special: dict[str, int]


@functools.lru_cache(maxsize=4)
def load(content: bytes) -> Vocabulary:
    """The vocabulary in a tokenizer file."""
    stored = json.loads(content)
    model = stored["model"]
    to_byte = _printable()
    special = {t["content"]: t["id"] for t in stored.get("added_tokens", []) if t["id"] is not None}
    ids = {text: n for text, n in model["vocab"].items()}
    tokens = {n: bytes(to_byte[c] for c in text) for text, n in ids.items() if text not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Vocabulary(tokens, [(ids[a], ids[b]) for a, b in pairs], special)

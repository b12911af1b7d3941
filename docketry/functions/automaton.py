"""Many keywords sought at once: one automaton over all of them reads each text once, whatever their number.

An automaton is built once a worker for a list of words. Texts go to it in Arrow
batches, of a few MB each (``session.SETTINGS``); numbers come back. Letters are
put in one case before, in the JVM. A null text gives null.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docketry.session import ship

#: Fixed value: what a whole word may not touch.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


@functools.lru_cache(maxsize=16)
def built(words: tuple[str, ...]):  # noqa: ANN201
    """The automaton of distinct words; a match tells the place of the word in the list and its length."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for place, word in enumerate(words):
        machine.add_word(word, (place, len(word)))
    machine.make_automaton()
    return machine


def places(text: str, words: tuple[str, ...]) -> list[int]:
    """Places, ascending, of the words that occur anywhere in a text."""
    return sorted({place for _, (place, _) in built(words).iter(text)})


def tallies(text: str, words: tuple[str, ...]) -> list[int]:
    """How often each word stands in a text with no ASCII letter, digit or _ of a word at either side; occurrences of one word do not overlap."""
    counts, ended = [0] * len(words), [-1] * len(words)
    last = len(text) - 1
    for end, (place, length) in built(words).iter(text):
        start = end - length + 1
        if start > ended[place] and (start == 0 or text[start - 1] not in LETTERS) and (end == last or text[end + 1] not in LETTERS):
            counts[place] += 1
            ended[place] = end
    return counts


def occurring(text: Column, words: Sequence[str]) -> Column:
    """Which of some words occur anywhere in a text, as their places (array<int>, from 0, ascending). Words are distinct and not empty."""
    ship(SparkSession.active())
    listed = tuple(words)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else places(t, listed))

    return found(text)


def counted(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """How often words of each group stand in a text as whole ASCII words (array<long>, in the order of the groups)."""
    ship(SparkSession.active())
    words = tuple(dict.fromkeys(w for ws in groups.values() for w in ws))
    place = {w: k for k, w in enumerate(words)}
    members = [[place[w] for w in dict.fromkeys(ws)] for ws in groups.values()]

    @F.pandas_udf("array<long>")
    def sums(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[int]:
            n = tallies(text, words)
            return [sum(n[k] for k in group) for group in members]

        return texts.map(lambda t: None if t is None else one(t))

    return sums(text)

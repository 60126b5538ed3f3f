"""Flesch-Kincaid grading of whole texts.

A word starts with an ASCII letter and runs over letters, apostrophes and
hyphens; its syllables are its vowel groups over the letters alone. The three
counts are taken by one Arrow kernel over a batch of texts. An earlier version in
built-in regex passes gave the same counts in about seven times the time.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import constants as C
from .text import strip

_SENTENCE_BREAK = r"(?U)(?<=[.!?])[\s\x1c-\x1f\x{a0}]+"
_COUNTS = StructType([StructField(n, IntegerType()) for n in ("sentences", "words", "syllables")])

_OTHER, _VOWEL, _E, _CONSONANT, _L, _JOINER, _SPACE, _STOP = range(8)
_WINDOW = 4_000_000  # characters handled at once


def _classes() -> np.ndarray:
    """Character class by code point; everything past the table is other."""
    table = np.zeros(0x3002, dtype=np.uint8)
    for code in range(0x3001):
        char = chr(code)
        if char.isascii() and char.isalpha():
            low = char.lower()
            table[code] = {"e": _E, "l": _L}.get(low, _VOWEL if low in "aiouy" else _CONSONANT)
        elif char.isspace():
            table[code] = _SPACE
    table[[ord(c) for c in "'’-"]] = _JOINER
    table[[ord(c) for c in ".!?"]] = _STOP
    return table


def _after(flags: np.ndarray) -> np.ndarray:
    """The flag of the character before each one."""
    return np.concatenate([[False], flags[:-1]])


def _count(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Sentences, words and syllables of each text, as columns."""
    # a zero character after each text keeps words and sentences apart
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = table[np.minimum(codes, 0x3001)]
    row = np.zeros(len(kind), dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    row[ends[:-1]] = 1
    row = np.cumsum(row)
    n = len(texts)

    letter = (kind >= _VOWEL) & (kind <= _L)
    # a sentence is a part between breaks that holds a letter
    breaks = _after(kind == _STOP) & (kind == _SPACE)
    part = np.cumsum(breaks) + row
    held = part[letter]
    first = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, dtype=bool)
    sentences = np.bincount(row[letter][first], minlength=n)

    # joiners inside a word vanish, so its letters stand side by side
    solid = np.maximum.accumulate(np.where(kind != _JOINER, np.arange(len(kind)), 0))
    keep = ~((kind == _JOINER) & letter[solid])
    kind, row, letter = kind[keep], row[keep], letter[keep]
    starts = np.flatnonzero(letter & ~_after(letter))
    stops = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]]))
    words = np.bincount(row[starts], minlength=n)

    vowel = (kind == _VOWEL) | (kind == _E)
    groups = np.cumsum(vowel & ~_after(vowel))
    per_word = groups[stops] - groups[starts] + vowel[starts]
    before = kind[np.maximum(stops - 1, 0)]
    silent = (kind[stops] == _E) & ((before == _VOWEL) | (before == _CONSONANT)) & (per_word > 1)
    syllables = np.bincount(row[starts], weights=np.maximum(per_word - silent, 1), minlength=n)
    return np.column_stack([sentences, words, syllables.astype(np.int64)])


@F.pandas_udf(_COUNTS)
def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    table = _classes()
    for batch in batches:
        texts = batch.fillna("").tolist()
        # rows in windows of bounded size, however long the texts of a batch are
        window = np.cumsum([len(t) for t in texts]) // _WINDOW
        edges = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(texts)]
        found = [_count(texts[a:b], table) for a, b in zip(edges, edges[1:]) if b > a]
        yield pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64), columns=_COUNTS.names)


def reading_counts(text: Column) -> Column:
    """``struct(sentences, words, syllables)`` of a text."""
    return _counts(text)


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), _SENTENCE_BREAK), strip)
    return F.filter(parts, lambda p: p.rlike("[A-Za-z]"))


def grade_of(counts: Column) -> Column:
    """Grade level from the counts; zero for a text without words."""
    value = (
        F.lit(C.FK_WORDS) * (counts["words"] / counts["sentences"])
        + F.lit(C.FK_SYLLABLES) * (counts["syllables"] / counts["words"])
        - F.lit(C.FK_BASE)
    )
    return F.when((counts["sentences"] > 0) & (counts["words"] > 0), value).otherwise(F.lit(0.0))


def grade(text: Column) -> Column:
    return grade_of(reading_counts(text))

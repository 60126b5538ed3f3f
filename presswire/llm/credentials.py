"""Secrets in texts: fixed shapes, and values in a credential's place by what it costs to guess them."""

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import comb, inf, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are taken whole, so a length in the pattern drops the shorter ones alone
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")

# a credential's name, a joint, and a value: whole in quotes, else up to white space
CONTEXT = re.compile(
    r"""(?<![^\W_])(?:pass(?:word|wd|phrase|code|wort|e)?|pwd|secret|token|bearer|credentials?|(?:api|access|private|secret)[_\ -]?key|contraseña|kennwort)(?![^\W\d_])
    ["'`]?[\ \t]*(?:[:=]=?>?|\bis\b|\bist\b|\bes\b|\best\b)[\ \t]*
    (?:(?P<quote>["'`])(?P<quoted>[^"'`\n]+)(?P=quote)|["'`]?(?P<bare>[^\s"'`<>,;]+))""", re.VERBOSE | re.IGNORECASE)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "bearer", "credential", "key", "contraseña", "kennwort")
TAIL = ".!?:)]}"

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 24   # letters of a word
FILTER_BITS = 2**24
LEAST_BITS = log2(10**10)   # guesses from which a value is a secret

CHOICE = log2(5)            # which of the five kinds of span comes next
YEARS = 140
DAY = log2(31 * 12 * YEARS)
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
SPLIT_DATE = re.compile(r"([0-9]{1,4})([-/._])([0-9]{1,2})\2([0-9]{1,4})")
LONGEST_UNIT, MOST_TIMES = 16, 16  # of a repeat; one that goes on longer counts as a whole too

# Letters that signs stand for, and a keyboard's rows, plain and shifted.
SIGNS = [str.maketrans("013457@$!", "oieastasi"), str.maketrans("013457@$!", "oleastasi")]
ROWS = [("`1234567890-=", "~!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", "ASDFGHJKL:\""), ("zxcvbnm,./", "ZXCVBNM<>?")]
INDENT = (0, 1.5, 1.75, 2.25)

KEYS = {c: (x + indent, y, shifted) for y, (pair, indent) in enumerate(zip(ROWS, INDENT)) for shifted, row in enumerate(pair) for x, c in enumerate(row)}
TURN = log2(6)              # neighbours of a key


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, leftmost and without overlap in each kind."""
    low, out = text.lower(), []
    if any(hint in low for hint in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """Where values stand in a credential's place, without closing punctuation."""
    low = text.lower()
    if not any(hint in low for hint in CONTEXT_HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span("quoted") if m["quoted"] else m.span("bare")
        while not m["quoted"] and end > start and text[end - 1] in TAIL:
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def lowered(value: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def readings(value: str) -> list[str]:
    """The value in small letters, signs read as letters, as long as the value."""
    low = lowered(value)
    return list(dict.fromkeys([low, *(low.translate(t) for t in SIGNS)]))


def possible_words(value: str) -> set[str]:
    out = set()
    for text in readings(value):
        for run in WORD.finditer(text):
            start, end = run.span()
            for i in range(start, end - SHORTEST + 1):
                out.update(text[i:j] for j in range(i + SHORTEST, min(end, i + LONGEST) + 1))
    return out


def _char_bits(c: str) -> float:
    return log2(10 if c in "0123456789" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


def _case_bits(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    return 1.0 if upper == len(word) or upper == 1 and word[0].isupper() else log2(1 + comb(len(word), upper))


def _is_date(parts: list[str]) -> bool:
    """Year, month, day in one of the usual orders."""
    for y, m, d in ((0, 1, 2), (2, 1, 0), (2, 0, 1)):
        if len(parts[y]) in (2, 4) and len(parts[m]) <= 2 and len(parts[d]) <= 2 and 1 <= int(parts[m]) <= 12 and 1 <= int(parts[d]) <= 31:
            return True
    return False


def _date_ends(value: str, i: int) -> Iterator[tuple[int, float]]:
    if YEAR.match(value, i):
        yield i + 4, log2(YEARS)
    m = SPLIT_DATE.match(value, i)
    if m and _is_date([m[1], m[3], m[4]]):
        yield m.end(), DAY + 2
    for size, cuts in ((8, ((4, 6), (2, 4))), (6, ((2, 4),))):
        run = value[i:i + size]
        if len(run) == size and run.isascii() and run.isdigit() and any(_is_date([run[:a], run[a:b], run[b:]]) for a, b in cuts):
            yield i + size, DAY + 1


def _walk_ends(value: str, i: int) -> Iterator[tuple[int, float]]:
    """Keys next to each other, three or more; every change of direction or shift costs."""
    at, turns, shifts, heading = KEYS.get(value[i]), 0, 0, None
    shifts = at[2] if at else 0
    for j in range(i + 1, len(value)):
        to = KEYS.get(value[j])
        if not at or not to or not 0 < abs(to[0] - at[0]) + abs(to[1] - at[1]) or abs(to[0] - at[0]) > 1 or abs(to[1] - at[1]) > 1:
            return
        way = to[0] > at[0], to[0] < at[0], to[1] - at[1]
        turns, shifts, heading, at = turns + (way != heading), shifts + (to[2] != at[2]), way, to
        if j - i >= 2:
            yield j + 1, log2(len(KEYS) // 2) + log2(j + 1 - i) + turns * TURN + shifts


def guess_bits(value: str, words: dict[str, float]) -> float:
    """log2 of the guesses for a value, the least over all ways to cut it into words,
    dates, repeats, keyboard walks and spans tried letter by letter. words: log2 of what a word takes."""

    @lru_cache(maxsize=4096)
    def unit_bits(unit: str) -> float:
        return least(unit)

    def least(text: str) -> float:
        n, texts = len(text), readings(text)
        low = texts[0]
        best, tried = [0.0] + [inf] * n, [inf] * (n + 1)  # best at a place; best with a letter by letter span open there
        same = [0] * (LONGEST_UNIT + 1)
        repeats: dict[int, list[tuple[int, int]]] = {}
        for j in range(n):
            for p in range(1, min(j, LONGEST_UNIT) + 1):
                same[p] = same[p] + 1 if text[j] == text[j - p] else 0
                if same[p] >= p:
                    most = same[p] // p + 1
                    repeats.setdefault(j + 1, []).extend((p, times) for times in {*range(2, min(most, MOST_TIMES) + 1), most})
        for i in range(n + 1):
            for p, times in repeats.get(i, ()):
                offered = best[i - p * times] + CHOICE + unit_bits(text[i - p:i]) + log2(times)
                best[i] = min(best[i], offered)
            best[i] = min(best[i], tried[i])
            if i == n:
                break
            tried[i + 1] = min(best[i] + CHOICE, tried[i]) + _char_bits(text[i])
            if "0" <= text[i] <= "9":
                for end, bits in _date_ends(text, i):
                    best[end] = min(best[end], best[i] + CHOICE + bits)
            for end, bits in _walk_ends(text, i):
                best[end] = min(best[end], best[i] + CHOICE + bits)
            for read in texts:
                for end in range(i + SHORTEST, min(n, i + LONGEST) + 1):
                    rank = words.get(read[i:end])
                    if rank is not None:
                        signs = len({(a, b) for a, b in zip(low[i:end], read[i:end]) if a != b})
                        best[end] = min(best[end], best[i] + CHOICE + rank + signs + _case_bits(text[i:end]))
        return best[n]

    return least(value)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    value = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        base, values = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base.append([dict(zip(("start", "kind", "end"), s)) for s in base_spans(text)])
            values.append([{"start": a, "end": b, "value": text[a:b]} for a, b in context_values(text)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(base, span), pa.array(values, value)], ["row", "doc_id", "base", "values"])


def _slots(word: str) -> tuple[int, int]:
    """Where the filter marks a word: the two halves of the hash that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h >> 32 & FILTER_BITS - 1, h & FILTER_BITS - 1


def _counted(marks: bytes):
    """Counts of the words that the filter lets through, and under no word that of all.
    Values are left out, so that one is no word because it stands there itself."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(marks, np.uint64)
        total = 0
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                text, at, parts = text or "", 0, []
                for start, end in context_values(text):
                    parts.append(text[at:start])
                    at = end
                counts.update(WORD.findall(" ".join([*parts, text[at:]]).lower()))
            total += counts.total()
            names = [w for w in counts if all(int(asked[slot >> 6]) >> (slot & 63) & 1 for slot in _slots(w))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[w] for w in names], pa.int64())], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([total], pa.int64())], ["word", "n"])

    return counted


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("value").to_pylist():
            words = sorted(possible_words(value))
            name = hashlib.sha256(value.encode()).digest()
            for start in range(0, len(words), 10_000):
                part = words[start:start + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.binary()), pa.array(part, pa.string())], ["name", "word"])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [guess_bits(value, {w["word"]: w["rank"] for w in words or ()}) for value, words in zip(batch.column("value").to_pylist(), batch.column("words").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(bits, pa.float64())], ["name", "bits"])


def word_costs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n, rank) of those of the distinct words (word) that occur in texts, in small
    letters, outside credential values; rank is log2 of one in how many words of
    all texts is this one. Tasks count only what a filter of the words, a bitmap of
    2 MB however many they are, lets through; the join is exact."""
    h = F.xxhash64("word")
    slots = words.select(F.explode(F.array(F.shiftrightunsigned(h, 32), h)).alias("h")).select(F.col("h").bitwiseAND(FILTER_BITS - 1).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    marked = slots.select(F.shiftright("slot", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2^18 rows at most
    marks = np.zeros(FILTER_BITS // 64, np.int64)
    marks[marked["at"]] = marked["bits"]
    counts = written(docs.select("text").mapInArrow(_counted(marks.tobytes()), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 1
    return counts.join(words, "word").select("word", "n", F.log2(F.lit(float(total)) / F.col("n")).alias("rank"))


def _named(value):
    return F.unhex(F.sha2(F.col(value).cast("binary"), 256)).alias("name")


def value_bits(values: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, bits) of distinct values, by the words of the texts; name is a value's SHA-256."""
    candidates = written(values.select("value").mapInArrow(_candidates, "name binary, word string"), "candidates")
    asked = written(candidates.groupBy("word").agg(F.count(F.lit(1)).alias("times")), "candidates")
    known = written(word_costs(docs, asked.select("word")).join(asked, "word").select("word", "times", "rank"), "candidates")
    total = known.agg(F.sum("times")).first()[0] or 0
    met = join_counted(candidates, known, "word", "times", total).where("rank is not null")
    lists = met.groupBy("name").agg(F.collect_list(F.struct("word", "rank")).alias("words"))
    return values.select(_named("value"), "value").join(lists, "name", "left").select("name", "value", "words").mapInArrow(_costs, "name binary, bits double")


def scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """Secrets in the texts of documents (doc_id, text).

    Fixed shapes are taken as they are. Besides, whatever stands where a credential's
    value does (`password is ..`, `api-key => ..`, in quotes or not) is cut at the least
    cost into words, dates, repeats, keyboard walks and spans tried letter by letter;
    words are those of all texts, by frequency, so a value of usual words is cheap. Values that take `least_bits` or more, and overlap no fixed shape, are spans
    of kind guess. A value's words are found by joining its substrings to the counted
    words, once per distinct value; no list of words is broadcast.

    Returns one row per row of docs: (doc_id, base, added, values): spans as (start,
    kind, end) by start, then kind (an index into KINDS), ends exclusive, in code
    points; values as (start, end, bits). Null texts count as empty. Rows that
    repeat or lack a doc_id are told for themselves; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    span = "array<struct<start: int, kind: int, end: int>>"
    found = written(rows.mapInArrow(_found, f"row long, doc_id long, base {span}, values array<struct<start: int, end: int, value: string>>"), "secrets")
    apart = ~F.exists("base", lambda b: (b["start"] < F.col("v.end")) & (F.col("v.start") < b["end"]))
    values = found.select("row", "base", F.explode("values").alias("v"))
    places = values.select("row", _named("v.value"), "v.start", "v.end", apart.alias("apart"))
    distinct = written(values.groupBy("v.value").agg(F.count(F.lit(1)).alias("n")), "secrets")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    bits = value_bits(distinct.select("value"), docs)
    costed = written(distinct.select(_named("value"), "n").join(bits, "name"), "secrets")
    told = join_counted(places, costed, "name", "n", total)
    added = F.sort_array(F.collect_list(F.when(F.col("apart") & (F.col("bits") >= least_bits), F.struct("start", F.lit(3).alias("kind"), "end"))))
    per_row = told.groupBy("row").agg(added.alias("added"), F.sort_array(F.collect_list(F.struct("start", "end", "bits"))).alias("values"))
    out = found.drop("values").join(per_row, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(span)).alias("added"), F.coalesce("values", F.array().cast("array<struct<start: int, end: int, bits: double>>")).alias("values"))


def joined(spans):
    """`kind:start:end` of spans, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")

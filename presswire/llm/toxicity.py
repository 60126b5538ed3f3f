"""Toxicity by two class-conditional Kneser-Ney models of how words are spelt."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .labelled import fold, held_out, sample, with_labels

WORD = re.compile(r"\w+")
ORDER = 5          # letters an n-gram spans
DISCOUNT = 0.75
START, END = 1, 2  # marks around a word; no letter has these code points
TUNE = (4,)        # fold on which the two scores are weighed, by counts of the others; fold 0 is never read
TUNE_ROWS = 20_000
MEMO_WORDS = 150_000
CLASSES = ("ordinary", "toxic")
TABLES = [*(f"{c} {part}" for c in CLASSES for part in ("count", "total", "kinds")), *(f"{k} {part}" for k in range(1, ORDER) for part in ("count", "total", "kinds"))]


def keys(letters: list) -> np.ndarray:
    """The 64-bit key of an n-gram given as columns of code points."""
    h = np.full(len(letters[0]) if letters else 0, len(letters) + 1, np.uint64)
    for c in letters:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Lookup:
    """Exact values by key, one column per table: sorted keys, and where those of each run of high bits begin."""

    def __init__(self, *tables: tuple[np.ndarray, np.ndarray]):
        self.key = np.unique(np.concatenate([key for key, _ in tables]))
        self.value = np.zeros((len(self.key) + 1, len(tables)), np.float32)  # the last row is that of no key
        for column, (key, value) in enumerate(tables):
            self.value[np.searchsorted(self.key, key), column] = value
        bits = max(1, len(self.key).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.key >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        run = (asked >> self.shift).astype(np.int64)
        at, end = self.first[run], self.first[run + 1]
        place, who = np.full(len(asked), len(self.key)), np.flatnonzero(at < end)
        at, end, asked = at[who], end[who], asked[who]
        while len(who):
            hit = self.key[at] == asked
            place[who[hit]] = at[hit]
            left = ~hit & (at + 1 < end)
            at, end, who, asked = at[left] + 1, end[left], who[left], asked[left]
        return self.value[place]


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of the marked words as a row of code points, and its word's number."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + ORDER)
    line = np.full(int(ends[-1]) if len(words) else 0, START, np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths + ORDER)
    inside = np.arange(len(line)) - (ends - lengths - ORDER)[owner]
    letters = (inside >= ORDER - 1) & (inside < lengths[owner] + ORDER - 1)
    line[letters] = codes
    line[ends - 1] = END
    at = np.flatnonzero(inside >= ORDER - 1)
    return line[at[:, None] + np.arange(1 - ORDER, 1)], owner[at]


def count_words(train: DataFrame) -> DataFrame:
    """(word, ordinary, toxic, ordinary4, toxic4): how often each word occurs in texts of
    either label, and how often of these in texts of the fold that weighs the scores."""
    names = [f"{c}{of}" for of in ("", "4") for c in CLASSES]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {n: Counter() for n in names}
        for batch in batches:
            for text, label, tune in zip(batch["text"], batch["label"], batch["tune"]):
                seen[CLASSES[int(label)] + "4" * bool(tune)].update(WORD.findall(text.lower()))
            if sum(map(len, seen.values())) > MEMO_WORDS:
                yield flush(seen)
        yield flush(seen)

    def flush(seen):
        words = list(set().union(*seen.values()))
        frame = pd.DataFrame({"word": words, **{n: [seen[n][w] for w in words] for n in names}})
        for c in CLASSES:
            frame[c] += frame[f"{c}4"]
        for s in seen.values():
            s.clear()
        return frame.astype({"word": "object", **{n: "int64" for n in names}})

    rows = train.where("label in (0, 1) and text is not null").select("text", "label", "tune")
    parts = rows.mapInPandas(count, "word string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def count_ngrams(words: DataFrame) -> DataFrame:
    """(c1..c5, ordinary, toxic, ordinary4, toxic4): how often each n-gram of letters occurs in either class."""
    names, counts = [f"c{i}" for i in range(1, ORDER + 1)], words.columns[1:]

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows, owner = spelt(list(batch["word"]))
            kinds, which = np.unique(rows, axis=0, return_inverse=True)
            out = pd.DataFrame(kinds, columns=names)
            for c in counts:
                out[c] = np.bincount(which.ravel(), batch[c].to_numpy()[owner], len(kinds)).astype(np.int64)
            yield out

    grams = words.mapInPandas(spell, ", ".join(f"{c} long" for c in [*names, *counts]))
    return grams.groupBy(*names).agg(*[F.sum(c).alias(c) for c in counts])


def count_tables(grams: DataFrame) -> DataFrame:
    """The model's exact count tables as rows (place in TABLES, key, value).

    The longest n-grams are counted per class. Shorter ones are counted once for
    both classes, by the number of different letters that come before them. The n-grams
    are read once, and every row turns into its entries of all tables there.
    """
    names = [f"c{i}" for i in range(1, ORDER + 1)]
    # unused letters are 0, which no letter is
    none = F.lit(0)
    ends = [F.struct(F.lit(k).alias("size"), *[F.col(c).cast("int").alias(c) if i >= ORDER - k else none.alias(c) for i, c in enumerate(names)],
                     *[(F.col(c) if k == ORDER else F.lit(0).cast("long")).alias(c) for c in CLASSES]) for k in range(1, ORDER + 1)]
    level = grams.where("ordinary + toxic > 0").select(F.explode(F.array(*ends)).alias("end")).select("end.*")
    level = level.groupBy("size", *names).agg(*[F.sum(c).alias(c) for c in CLASSES])

    size = F.col("size")
    gram = [F.col(c) for c in names]
    # without its first letter
    tail = [F.when(size > ORDER - i, c).otherwise(none) for i, c in enumerate(gram)]

    def entry(when, place, letters, value):
        return F.when(when, F.struct(place.alias("place"), *[x.alias(c) for x, c in zip(letters, names)], value.cast("double").alias("value")))

    def table(part, k):
        return F.lit(TABLES.index(f"1 {part}")) + 3 * (k - 1)

    entries = [entry(size < ORDER, table("kinds", size), [*gram[:-1], none], F.lit(1)),
               entry(size > 1, table("count", size - 1), tail, F.lit(1)), entry(size > 1, table("total", size - 1), [*tail[:-1], none], F.lit(1))]
    for c in CLASSES:
        for part, letters, value in (("count", gram, F.col(c)), ("total", [*gram[:-1], none], F.col(c)), ("kinds", [*gram[:-1], none], F.lit(1))):
            entries.append(entry((size == ORDER) & (F.col(c) > 0), F.lit(TABLES.index(f"{c} {part}")), letters, value))
    union = level.select(F.explode(F.array_compact(F.array(*entries))).alias("entry")).select("entry.*")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            letters = batch[names].to_numpy()
            key = np.zeros(len(batch), np.uint64)
            # the letters of a table stand together, zeros before and behind
            used = letters > 0
            for start in range(ORDER):
                for end in range(start, ORDER + 1):
                    rows = (used[:, start:end].all(axis=1) & ~used[:, :start].any(axis=1) & ~used[:, end:].any(axis=1)) if end > start else (~used.any(axis=1) if start == 0 else None)
                    if rows is not None and rows.any():
                        key[rows] = keys([letters[rows, i] for i in range(start, end)]) if end > start else np.uint64(1)
            yield pd.DataFrame({"place": batch["place"], "key": key.view(np.int64), "value": batch["value"]})

    counted = union.groupBy("place", *names).agg(F.sum("value").alias("value"))
    return counted.mapInPandas(keyed, "place int, key long, value double")


def collected(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The tables at the driver, 12 bytes for each distinct n-gram of letters and each of its contexts."""
    found = rows.select("place", "key", F.col("value").cast("float")).toArrow()
    place, key, value = (found[c].to_numpy() for c in ("place", "key", "value"))
    return {TABLES[p]: (key[place == p].view(np.uint64), value[place == p]) for p in np.unique(place)}


class Spelling:
    """Log-likelihood ratios of words, toxic against ordinary, from the count tables."""

    def __init__(self, tables):
        none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        of = lambda *names: Lookup(*(tables.get(name, none) for name in names))
        self.counts = {k: of(f"{k} count") for k in range(1, ORDER)} | {ORDER: of(*(f"{c} count" for c in CLASSES))}
        self.contexts = {k: of(f"{k} total", f"{k} kinds") for k in range(1, ORDER)} | {ORDER: of(*(f"{c} {part}" for part in ("total", "kinds") for c in CLASSES))}

    def _step(self, letters, lower):
        """The estimates from n-grams of these letters, a column per table, mixed with those of shorter ones."""
        context = keys(letters[:-1]) if len(letters) > 1 else np.ones(len(letters[0]), np.uint64)
        total, kinds = np.split(self.contexts[len(letters)](context), 2, axis=1)
        seen = np.maximum(self.counts[len(letters)](keys(letters)) - DISCOUNT, 0) + DISCOUNT * kinds * lower
        return np.where(total > 0, seen / np.maximum(total, 1), lower)

    def likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every letter of the words, their ends included: its word's number, and its
        probability after the letters before it, in ordinary and in toxic texts."""
        rows, owner = spelt(words)
        # each kind of n-gram once
        _, first, which = np.unique(keys([rows[:, i] for i in range(ORDER)]), return_index=True, return_inverse=True)
        letters = [rows[first, i] for i in range(ORDER)]
        shared = np.full((len(first), 1), 1 / 65_536)
        for k in range(1, ORDER):
            shared = self._step(letters[-k:], shared)
        ordinary, toxic = self._step(letters, shared).T
        return owner, ordinary[which], toxic[which]

    def ratios(self, words: list[str]) -> np.ndarray:
        """The sum over a word's letters."""
        owner, ordinary, toxic = self.likelihoods(words)
        return np.bincount(owner, np.log(toxic) - np.log(ordinary), len(words))


@dataclass
class Model:
    tables: dict
    weights: tuple[float, float, float]  # of 1, the mean ratio, the highest ratio of a word


def _signals(tables):
    """Text to (mean ratio a letter, highest ratio a letter of a word); 0, 0 without words."""
    spelling, memo = Spelling(tables), {}
    known = np.zeros((0, 2))  # ratio and letters of the words of the memo, by number

    def signals(texts) -> np.ndarray:
        nonlocal known
        out = np.zeros((len(texts), 2))
        split = [WORD.findall(text.lower()) if isinstance(text, str) else [] for text in texts]
        for start in range(0, len(split), 256):
            part = split[start:start + 256]
            words = set().union(*part)
            new = [w for w in words if w not in memo]
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                known, new = known[:0], list(words)
            if new:
                memo.update(zip(new, range(len(memo), len(memo) + len(new))))
                known = np.concatenate([known, np.column_stack([spelling.ratios(new), np.fromiter(map(len, new), np.float64, len(new)) + 1])])
            for i, found in enumerate(part, start):
                if found:
                    mine = known[np.fromiter(map(memo.__getitem__, found), np.int64, len(found))]
                    out[i] = mine[:, 0].sum() / mine[:, 1].sum(), (mine[:, 0] / mine[:, 1]).max()
        return out

    return signals


def signal_column(spark, tables):
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        signals = _signals(shared.value)
        for texts in batches:
            found = signals(texts)
            yield pd.DataFrame({"mean": found[:, 0], "top": found[:, 1]})

    return F.pandas_udf(run, "mean double, top double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a weak ridge; a constant when one class is missing."""
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 2)
        return (float(np.log(p / (1 - p))),) + (0.0,) * x.shape[1]
    spread = x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0] + [1e-2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(float(a) for a in w[1:] / spread))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", tune_rows: int = TUNE_ROWS) -> Model:
    """Count all labelled rows of folds 1 to 4. Mean and top ratio are weighed on at most
    `tune_rows` rows of fold 4, whose ratios come from the counts of the other folds. Rows
    of fold 0 are not read."""
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    learn = with_labels(docs.where(fold(F.col("doc_id")) != 0), marks, label).withColumn("tune", fold(F.col("doc_id")).isin(*TUNE))
    grams = written(count_ngrams(count_words(learn)), "ngrams")
    others = grams.select(*grams.columns[:ORDER], *[(F.col(c) - F.col(f"{c}4")).alias(c) for c in CLASSES])
    tune = sample(marks.where(fold(F.col("doc_id")).isin(*TUNE)), tune_rows)
    apart = collected(count_tables(others))
    rows = with_labels(docs, tune, label).select("label", signal_column(spark, apart)(F.col("text")).alias("s")).select("label", "s.*").toPandas()
    return Model(collected(count_tables(grams)), _logistic(rows[["mean", "top"]].to_numpy(float), rows["label"].to_numpy(float)))


def score_column(spark, model: Model):
    """A function of a text column: the probability of the label, null texts as empty."""
    signal = signal_column(spark, model.tables)
    b, mean, top = model.weights

    def score(text):
        s = signal(text)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(b) + F.lit(mean) * s["mean"] + F.lit(top) * s["top"])))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score whole texts for toxicity.

    Two models of letters given the four before them, one per class, share the
    Kneser-Ney continuation counts of their shorter contexts, so a spelling rare
    in either class falls back on the same estimate. A text's log-likelihoods are
    compared per letter, over the whole text and over its most toxic word; a
    logistic curve turns both into the score. Every count is exact: the tables have an
    entry for each distinct n-gram and context, told apart by 64-bit keys, and every task has
    them all, 12 bytes an entry. That grows with the kinds of spelling, not with the rows.

    Returns (doc_id, held_out, score, predicted). Null and empty texts score as
    texts without evidence; a null doc_id counts as held out; repeated rows get
    equal scores; without labels of both classes every score is the same. Only
    doc_id and text of the documents are read.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", score_column(docs.sparkSession, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score below 0.5. Null and empty texts score as texts
    without evidence, repeated rows are kept or go alike, a row without doc_id is scored
    like others, and an empty table stays empty."""
    return docs.where(score_column(docs.sparkSession, fit(docs, labels))(F.col("text")) < 0.5)

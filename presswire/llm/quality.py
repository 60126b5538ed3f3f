"""Quality by ordinal cumulative-link regression on hashed text features."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, held_out, sample, with_labels

BITS = 16           # hashed features have 2**BITS weights
SAMPLE_ROWS = 6000  # labelled rows the model is fitted on, at most
GRADES = 3
MEMO_WORDS = 150_000

_OTHER = re.compile(r"[\W_]+")
_RUNS = re.compile(r"(.)\1+")


def _hash(kind: str, value) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def token_features(token: str) -> tuple[int, int]:
    """The word without marks, and the token's shape with runs of a kind shortened."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    return _hash("word", _OTHER.sub("", token.lower())), _hash("shape", _RUNS.sub(r"\1", shape))


def text_features(text: str, tokens: list[str]) -> list[int]:
    """Coarse measures of the whole text: length, repetition, line repetition, word length."""
    n = len(tokens)
    if not n:
        return [_hash("empty", 1)]
    lines = text.split("\n")
    return [_hash("length", n.bit_length()), _hash("distinct", round(10 * len(set(tokens)) / n)),
            _hash("lines", round(10 * len(set(lines)) / len(lines))), _hash("letters", min(30, len(text) // n))]


def featurize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: shares of the tokens, and 1 for text measures."""
    tokens = text.split() if isinstance(text, str) else []
    shares = Counter()
    for token, n in Counter(tokens).items():
        for f in token_features(token):
            shares[f] += n / len(tokens)
    whole = Counter(text_features(text or "", tokens))
    found = {f: shares[f] + whole[f] for f in shares.keys() | whole.keys()}
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class Model:
    weights: np.ndarray     # one per feature, shared by all grades
    thresholds: np.ndarray  # ascending, one fewer than grades


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int = GRADES, rounds: int = 250,
                ridge: float = 1e-5, rate: float = 0.1) -> Model:
    """Maximum likelihood of P(grade <= k) = logistic(threshold_k - weights . x), by
    Adam on all rows. Thresholds are a first one and positive gaps, so they stay in
    order; a pull towards gaps of 2 places thresholds of grades that do not occur."""
    size = 1 << BITS
    n = len(rows)
    w, t = np.zeros(size), np.concatenate([[-(levels - 2.0)], np.full(levels - 2, np.log(2.0))])
    if not n:
        return Model(w.astype(np.float32), _thresholds(t))
    lengths = np.array([len(i) for i, _ in rows])
    idx = np.concatenate([i for i, _ in rows])
    val = np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(n), lengths)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for step in range(1, rounds + 1):
        s = np.bincount(row, val * w[idx], n)
        edges = np.concatenate([[-np.inf], _thresholds(t), [np.inf]])
        up, low = logistic(edges[grades + 1] - s), logistic(edges[grades] - s)
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_s = du - dl                                    # of the loss, by s
        g_edge = np.zeros(levels + 1)
        np.add.at(g_edge, grades + 1, -du / n)
        np.add.at(g_edge, grades, dl / n)
        g_edge = g_edge[1:-1]
        g_w = np.bincount(idx, val * g_s[row], size) / n + ridge * w
        g_t = np.cumsum(g_edge[::-1])[::-1] * np.concatenate([[1.0], np.exp(t[1:])]) + 1e-3 * np.concatenate([[0.0], t[1:] - np.log(2.0)])
        for x, g, m, v in ((w, g_w, state[0], state[1]), (t, g_t, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return Model(w.astype(np.float32), _thresholds(t))


def _thresholds(t: np.ndarray) -> np.ndarray:
    return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def grade_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 of low quality, 1 of good quality but toxic, 2 good and not known as toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, levels: int = GRADES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` ratings (doc_id, grade) outside fold 0."""
    chosen = sample(ratings.where(F.col("grade").between(0, levels - 1) & ~(fold(F.col("doc_id")) == 0)), sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [featurize(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["label"], "features": [i for i, _ in found], "values": [v for _, v in found]})

    rows = with_labels(docs, chosen, "grade").mapInPandas(run, "doc_id long, grade int, features array<int>, values array<float>").toPandas()
    # a fixed order of rows gives the same sums wherever the tasks ran
    rows = rows.assign(key=[x.tobytes() for x in map(np.asarray, rows["values"])]).sort_values(["doc_id", "key"])
    return fit_ordinal(list(zip(map(np.asarray, rows["features"]), map(np.asarray, rows["values"]))), rows["grade"].to_numpy(np.int64), levels)


def score_column(spark, model: Model):
    """A function of a text column: struct of expected grade and tail probabilities
    (tail[k - 1] is P(grade >= k))."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value.weights.astype(np.float64), shared.value.thresholds
        memo = {}
        for texts in batches:
            s = np.zeros(len(texts))
            for i, text in enumerate(texts):
                tokens = text.split() if isinstance(text, str) else []
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for token in set(tokens):
                    if token not in memo:
                        memo[token] = sum(weights[f] for f in token_features(token))
                s[i] = sum(weights[f] for f in text_features(text or "", tokens))
                if tokens:
                    s[i] += np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens)).mean()
            tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -35, 35)))
            yield pd.DataFrame({"expected": tail.sum(axis=1), "tail": list(tail)})

    return F.pandas_udf(run, "expected double, tail array<double>")


def score(docs: DataFrame, ratings: DataFrame, grade: int = 1, least: float = 0.5, levels: int = GRADES) -> DataFrame:
    """Expected grade and tail probability of whole texts, and the selection by them.

    Words and token shapes are hashed to weights that all grades share; ordered
    thresholds cut the sum into grades. A document is kept when P(grade >= `grade`)
    is at least `least`.

    Returns (doc_id, held_out, expected_grade, tail_1.., kept). Null texts count
    as empty and are scored on having no tokens; a null doc_id is held out;
    repeated rows get equal scores; without ratings the middle grades are as
    likely either way. Only doc_id and text are read.
    """
    column = score_column(docs.sparkSession, fit(docs, ratings, levels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), column(F.col("text")).alias("s"))
    tails = [F.col("s.tail")[k - 1].alias(f"tail_{k}") for k in range(1, levels)]
    return scored.select("doc_id", "held_out", F.col("s.expected").alias("expected_grade"), *tails, (F.col("s.tail")[grade - 1] >= least).alias("kept"))


def keep_good(docs: DataFrame, ratings: DataFrame, grade: int = 1, least: float = 0.5, levels: int = GRADES) -> DataFrame:
    """The documents, all columns, whose tail probability is at least `least`."""
    column = score_column(docs.sparkSession, fit(docs, ratings, levels))
    return docs.where(column(F.col("text"))["tail"][grade - 1] >= least)

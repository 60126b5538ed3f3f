"""The class-conditional models against probabilities computed from plain dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from presswire.llm import toxicity
from presswire.llm.common import written
from presswire.llm.labelled import fold

ROWS = "text string, label int, tune boolean, doc_id long"
TEXTS = [("banana bandana, cabana", 0, False), ("banal cabal bats", 1, False), ("bats at banks", 0, True), ("banana ban ban", 1, True), ("ünü 中文中文 a", 1, False), (None, 1, False), ("", 0, False)]


def plain(texts):
    """P(letter | four letters before) as a function of class, from all counts."""
    grams = {0: Counter(), 1: Counter()}
    for text, label, _ in texts:
        for word in toxicity.WORD.findall((text or "").lower()):
            line = "\1" * 4 + word + "\2"
            grams[label].update(line[i:i + 5] for i in range(len(word) + 1))
    before = {k: defaultdict(set) for k in range(1, 5)}
    every = {5: set(grams[0]) | set(grams[1])}
    for k in range(4, 0, -1):
        for g in every[k + 1]:
            before[k][g[1:]].add(g)
        every[k] = set(before[k])

    def shared(gram):
        k = len(gram)
        if not k:
            return 1 / 65_536
        lower = shared(gram[1:])
        same = {g: len(x) for g, x in before[k].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        return (max(same.get(gram, 0) - 0.75, 0) + 0.75 * len(same) * lower) / total if total else lower

    def whole(label, gram):
        same = {g: n for g, n in grams[label].items() if g[:-1] == gram[:-1]}
        total, lower = sum(same.values()), shared(gram[1:])
        return (max(same.get(gram, 0) - 0.75, 0) + 0.75 * len(same) * lower) / total if total else lower

    return whole


def tables_of(spark, texts, apart=False):
    rows = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], ROWS)
    grams = toxicity.count_ngrams(toxicity.count_words(rows))
    if apart:
        grams = grams.selectExpr(*grams.columns[:5], "ordinary - ordinary4 as ordinary", "toxic - toxic4 as toxic")
    return toxicity.collected(toxicity.count_tables(grams))


@pytest.mark.parametrize("apart", [False, True])
def test_probabilities(spark, apart):
    model = toxicity.Spelling(tables_of(spark, TEXTS, apart))
    p = plain([t for t in TEXTS if not (apart and t[2])])
    words = ["banana", "bananas", "cat", "zzz", "中文", "ü", "ban"]
    owner, ordinary, toxic = model.likelihoods(words)
    at = 0
    for number, word in enumerate(words):
        line = "\1" * 4 + word + "\2"
        for i in range(len(word) + 1):
            assert owner[at] == number
            assert ordinary[at] == pytest.approx(p(0, line[i:i + 5]), rel=1e-5) and toxic[at] == pytest.approx(p(1, line[i:i + 5]), rel=1e-5)
            at += 1
    assert at == len(owner)


def test_counting_reads_the_ngrams_once(spark):
    rows = spark.createDataFrame([(*t, i) for i, t in enumerate(TEXTS)], ROWS)
    grams = written(toxicity.count_ngrams(toxicity.count_words(rows)), "ngrams")
    plan = toxicity.count_tables(grams)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # tasks are as many as the table's files ask for, not that many for each of 18 tables
    assert plan.count("FileScan") == 1 and plan.count("Union") == 0 and plan.count("Exchange hashpartitioning") == 2


def test_lookups_are_exact():
    draw = np.random.default_rng(1)
    key = np.unique(draw.integers(0, 2**64, 5000, np.uint64))
    value = draw.integers(1, 1000, len(key)).astype(np.float32)
    order = draw.permutation(len(key))
    other = np.concatenate([key[:100], draw.integers(0, 2**64, 50, np.uint64)])
    table = toxicity.Lookup((key[order], value[order]), (other, np.ones(150, np.float32)))
    asked = np.concatenate([key, key + np.uint64(1), other, draw.integers(0, 2**64, 1000, np.uint64)])
    known, more = dict(zip(key.tolist(), value.tolist())), set(other.tolist())
    assert table(asked).tolist() == [[known.get(a, 0.0), float(a in more)] for a in asked.tolist()]
    near = np.arange(300, dtype=np.uint64)  # all in one run
    assert toxicity.Lookup((near, near.astype(np.float32)))(near)[:, 0].tolist() == list(range(300))
    assert toxicity.Lookup((key[:0], value[:0]))(asked[:5]).tolist() == [[0]] * 5


def test_signals_of_texts(spark):
    tables = tables_of(spark, TEXTS)
    model = toxicity.Spelling(tables)
    texts = ["banana cat", None, "", "cat cat zzz banana", "!!"]
    found = toxicity._signals(tables)(texts)
    for text, (mean, top) in zip(texts, found):
        words = toxicity.WORD.findall(text or "")
        ratios = dict(zip(words, model.ratios(words))) if words else {}
        assert mean == pytest.approx(sum(ratios[w] for w in words) / sum(len(w) + 1 for w in words) if words else 0)
        assert top == pytest.approx(max((ratios[w] / (len(w) + 1) for w in words), default=0))


def test_held_out_rows_are_never_read(spark):
    docs = [(i, f"{'vile nasty' if i % 2 else 'kind gentle'} word{i}") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    inside = {r.doc_id for r in frame.where(fold(frame.doc_id) == 0).collect()}
    right = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - i % 2 if i in inside else i % 2) for i, _ in docs], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.score(frame, labels).collect()} for labels in (right, wrong))
    assert a == b and len(inside) > 10 and all((a[i] >= 0.5) == (i % 2 == 1) for i in inside)
    assert all(math.isfinite(x) for x in a.values())

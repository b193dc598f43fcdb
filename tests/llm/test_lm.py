"""Counts and base scores against a plain count; probabilities that add up; learning; held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barscreen.llm import lm
from barscreen.llm.common import stored, table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def split(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*data.split(), None]


def test_query_against_plain_counts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    counts = Counter(w for r in docs if not held[r.doc_id] for w in split(r.text))
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in QUERIES["op5_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words = split(r.text)
        row = got[r.doc_id]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[r.doc_id], len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
        assert row.score < 0
    rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.9


@pytest.fixture(scope="module")
def small(spark):
    rows = [(k, "the cat sat on a mat" if k % 2 else "der hund lag in dem haus") for k in range(400)]
    rows += [(1000 + k, f"the rare{k} cat") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = stored(lm.token_counts(docs), "counts")
    return docs, counts


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 12])
def test_tail_words_are_looked_up_exactly(spark, small, frequent):
    docs, counts = small
    words = lm.learn_words(counts, frequent)
    assert frequent > 100 or len(words.counts) <= 12
    model = lm.LogBilinear.new(words.class_counts)
    odd = [(1, "the rare3 RARE4 unknown rare3"), (2, None), (2, None), (None, ""), (3, "x" * 50_000), (4, "é\tü")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("word", F.lit("w"))
    plain = {r.word and bytes(r.word): r.n for r in counts.collect()}
    total = sum(plain.values())
    got = lm.scored(frame, counts, words, model).collect()
    assert len(got) == 6
    for r in got:
        tokens = lm.tokens((dict((i, t) for i, t in odd)[r.doc_id] or "").encode())
        want = sum(math.log10((plain.get(w, 0) + 1) / (total + len(plain) + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(w in plain for w in tokens))
        assert r.base_score == pytest.approx(want)


def test_tokens_of_a_batch_are_those_of_each_text():
    texts = ["", "  a B ", "a\x1cb\x0bc\x85 d\u3000f", " ", "É\t\nx  É", None, "the rare the"]
    different, every, sizes = lm.batch_tokens(pa.array(texts))
    want = [lm.tokens((t or "").encode()) for t in texts]
    words = different.to_pylist()
    assert [words[k] for k in every] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    real = words.index(b"") if b"" in words else len(words)
    known = lm.Words(0, 0, {}, {lm.END: 0, b"the": 1, b"x": 2})
    at = known.classes_of(different)
    assert all(at[k] == known.class_of(w) for k, w in enumerate(words) if k != real)


def test_a_step_is_that_of_loops():
    """One batch against the slopes of every token and noise word, added up one by one."""
    draw = np.random.default_rng(3)
    counts = draw.integers(1, 50, 12).astype(float)
    share = counts / counts.sum()
    model, plain = lm.LogBilinear.new(counts), lm.LogBilinear.new(counts)
    one, two, word = draw.integers(0, 12, (3, 40))
    lm.Trainer(model, share, seed=5).learn(one, two, word)
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng(5).random(lm.NOISE)), 11)
    log_noise = np.log(share * lm.NOISE)
    slopes = {k: np.zeros(getattr(plain, k).shape) for k in ("context", "target", "near", "far", "bias")}
    backs = []
    for i, j, w in zip(one, two, word):
        predicted = plain.context[i] @ plain.near + plain.context[j] @ plain.far
        back = np.zeros(lm.SIZE)
        for v, real in [(w, 1), *((v, 0) for v in noise)]:
            logit = predicted @ plain.target[v] + plain.bias[v] - log_noise[v]
            off = (1 / (1 + np.exp(-logit)) - real) / len(word)
            back += off * plain.target[v]
            slopes["target"][v] += off * predicted
            slopes["bias"][v] += off
        slopes["near"] += np.outer(plain.context[i], back)
        slopes["far"] += np.outer(plain.context[j], back)
        backs.append(back)

    def step(name):
        weights = getattr(plain, name)
        weights -= lm.RATE * slopes[name] / np.sqrt(1e-2 + slopes[name] ** 2)

    step("near"), step("far")  # before the contexts learn, as the operator does
    for i, j, back in zip(one, two, backs):
        slopes["context"][i] += plain.near @ back
        slopes["context"][j] += plain.far @ back
    step("context"), step("target"), step("bias")
    assert np.allclose(model.flat(), plain.flat(), atol=1e-5)


def test_probabilities_add_up(spark, small):
    docs, counts = small
    words = lm.learn_words(counts)
    model = lm.train(docs, words, rounds=4)
    scorer, n = lm.Scorer(model), words.classes
    for one, two in ((0, 0), (3, 5), (n - 1, 1)):
        logs = scorer.of(np.full(n, one), np.full(n, two), np.arange(n))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    within = Counter()
    for row in counts.collect():
        at = words.class_of(bytes(row.word))
        within[at] += (row.n + 1) / words.class_parts[at] if at >= len(words.own) else 1
    assert all(v <= 1 + 1e-9 for v in within.values())


def test_context_is_learned():
    """After each of two words another word follows, and the normalised probabilities show it."""
    model = lm.LogBilinear.new(np.array([50.0, 40, 40, 40, 40, 1]))
    trainer = lm.Trainer(model, np.full(6, 1 / 6), seed=1)
    one = np.array([1, 2] * 200)
    for _ in range(400):
        trainer.learn(one, np.zeros_like(one), one + 2)
    scorer = lm.Scorer(model)
    got = 10 ** scorer.of(np.array([1, 1, 2, 2]), np.zeros(4, int), np.array([3, 4, 3, 4]))
    assert got[0] > 0.9 > 0.1 > got[1] and got[3] > 0.9 > 0.1 > got[2]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    counts = stored(lm.token_counts(none), "counts")
    words = lm.learn_words(counts)
    model = lm.train(none, words)
    assert lm.scored(none, counts, words, model).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    row = lm.scored(one, counts, words, model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0) and row.base_score == 0.0

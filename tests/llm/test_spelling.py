"""Spelling variants against plain loops over all pairs of words; the trees against all pairs of vectors."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import spelling as sp
from barscreen.llm.urls import LOWER, UPPER


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=10):
    nears = {w: [x for x in counts if near(w, x)] for w in counts}
    forms = {}
    for w, xs in nears.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, len(nears[w]), counts[forms[w]] if forms[w] else None) for w, n in counts.items())


def brute_counts(docs, each=31):
    counts = {}
    for doc, text in docs:
        for run in re.findall(sp.LETTERS + "+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % each == 0 else run
            if len(word) >= 7:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def some_words(n, seed=5):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 9)))
        words.add(w)
        k = rng.randrange(len(w))
        words.add(w[:k] + rng.choice("abÿz") + w[k + rng.randint(0, 1) :])
    return sorted(words)


def got(df, **more):
    out = sp.variants(df, **more)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 20)
    monkeypatch.setattr(sp, "CELLS", 300)
    rng = random.Random(2)
    counts = {w: rng.choice([2, 2, 3, 20, 25, 200, 2500]) for w in some_words(900)}
    # A chain of forms, equal best words, anagrams and a very long word with a variant.
    counts |= {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "xhainbbb": 20_000}
    counts |= {"tiesxaaaa": 2, "tiesyaaaa": 50, "tieszaaaa": 50}
    counts |= {"ab" * 4000: 3, "ab" * 4000 + "c": 30, "ab" * 2000 + "x" + "ab" * 2000: 30}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert got(df, leaf=40) == brute(counts)


def test_counts_from_texts(spark):
    rng = random.Random(9)
    words = ["Straße", "strasses", "STRASSES", "naïvement", "NAÏVEMENT", "naïvemente", "x×÷yabcd", "kurz", "letters"]
    docs = [(i, " 1".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    docs += [(None, "letters letters lettersʼ"), (7, None), (8, ""), docs[0], (9, "y" * 50_000), (10, "y" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as run").repartition(4)
    runs = sp.long_runs(df, 7)
    typed = runs.select(sp.mistyped(F.col("doc_id"), F.col("run"), 31).alias("word"))
    counts = sp.counted(typed, 7, 2)
    assert {r.word: r.n for r in counts.collect()} == brute_counts(docs)
    assert got(counts) == brute(brute_counts(docs))


def test_empty(spark):
    assert got(spark.createDataFrame([], "word string, n long")) == []
    assert got(spark.createDataFrame([("solitary", 5)], "word string, n long")) == [("solitary", None, "solitary", 5, 0, None)]
    with pytest.raises(ValueError):
        sp.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_trees_reach_all_near_vectors_and_prune(spark):
    words = some_words(3000, seed=8)
    by = sp._by_length(words)
    trees = sp.Trees(words, {length: len(rows) for length, rows in by.items()}, leaf=60)
    assert trees.leaves > 60
    v = {length: sp.vectors_of(sp.letters_of([words[i] for i in rows])) for length, rows in by.items()}
    home = {length: dict(zip(*trees.search(length, x, False, False))) for length, x in v.items()}
    visits = 0
    for length in (7, 8):
        for to, down in ((length, True), (length + 1, False)):
            row, leaf = trees.search(length if down else to, v[length], True, down)
            reached = set(zip(row.tolist(), leaf.tolist()))
            assert len(reached) == len(row)
            gap = v[length][:, None].astype(int) - v[to][None]
            close = (gap > 0).sum(2) <= down
            close &= (np.abs(gap).sum(2) <= 1 + down) & (gap.clip(0).sum(2) <= 1)
            assert all((i, home[to][j]) in reached for i, j in zip(*np.nonzero(close)))
            visits += len(row) / (len(v[length]) * len(set(home[to].values())))
    assert visits / 4 < 0.5


def test_letters_are_verified():
    a, b = sp.letters_of(["abcdefg", "abcdefg", "abcdefg"]), sp.letters_of(["abcdefgh", "xabcdefg", "abxcdegf"])
    assert sp.one_inserted(a, b).tolist() == [True, True, False]

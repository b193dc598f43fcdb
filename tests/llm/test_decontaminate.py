"""Leaks against a comparison of every window with every item."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import decontaminate
from barscreen.llm.common import table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def norm(text):
    return [w for w in (x.strip("".join(map(chr, decontaminate.MARKS))).lower() for x in (text or "").split()) if w]


def grams(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Every window that holds any shingle of the item is compared."""
    out = set()
    wanted = [(item, len(w), grams(w)) for item, passage in items if (w := norm(passage))]
    for doc, text in docs:
        words = norm(text)
        runs = {k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(1, 6)}
        for item, n, want in wanted:
            k = min(5, n)
            at = [i for i, run in enumerate(runs[k]) if run in want]
            for i in sorted({s for p in at for s in range(p - n + k, p + 1)}):
                if 0 <= i <= len(words) - n:
                    own = Counter(runs[k][i : i + n - k + 1])
                    if sum((own & want).values()) >= 0.8 * sum((own | want).values()):
                        out.add((doc, item))
                        break
    return out


def test_given_tables_against_every_window(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_edited_passages_and_odd_rows(spark):
    draw = random.Random(8)
    vocab = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(draw.choices(vocab, k=draw.randint(1, 70)))) for k in range(30)] + [(30, None), (31, "..."), (32, "v1 v2")]
    items.append((33, items[5][1]))
    docs = [(0, None), (1, ""), (2, "!!! ."), (3, "v1 V2, v3"), (None, items[7][1])]
    for k in range(4, 60):
        words = items[draw.randrange(30)][1].split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocab)
        words = [w.upper() + "," for w in words]
        docs.append((k, " ".join(draw.choices(vocab, k=draw.randint(0, 40)) + words + draw.choices(vocab, k=5))))
    docs.append((60, " ".join(draw.choices(vocab, k=60_000)) + " " + items[9][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    blocks = decontaminate.leaks(frame, bench, block_bytes=500)
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in rows}
    for r in rows:
        n = len(norm(items[r.item_id][1]))
        assert r.last_word - r.first_word + 1 >= n and r.similarity >= 0.8
    found = {r.doc_id for r in rows}
    left = decontaminate.without_leaks(frame, bench)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - found
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(frame, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("radius", [0, 3, 16])
def test_blocks_miss_none_within_the_radius(radius):
    draw = np.random.default_rng(1)
    items = draw.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 20), replace=False)) for _ in range(400)], np.uint64)
    windows = items[draw.integers(0, 40, 400)] ^ flips
    w, i = decontaminate.within_radius(windows, items, radius)
    want = {(a, b) for a in range(400) for b in range(40) if int(windows[a] ^ items[b]).bit_count() <= radius}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_a_document_shorter_than_the_item(spark):
    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words[:95])), (2, " ".join(words[3:])), (3, " ".join(words[:80])), (4, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.first_word, r.last_word, round(r.similarity, 4)) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {1: (0, 94, round(91 / 96, 4)), 2: (0, 96, round(93 / 96, 4))}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {3, 4}

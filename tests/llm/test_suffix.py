"""Suffix arrays and common prefixes against sorting; removed bytes against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import suffix
from barscreen.llm.common import table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small", [1, 1024])
def test_suffix_array_and_prefixes(monkeypatch, small):
    monkeypatch.setattr(suffix, "SMALL", small)
    draw = random.Random(small)
    for _ in range(150):
        k = draw.choice([1, 2, 3, 6, 400])
        text = [draw.randint(1, k) for _ in range(draw.randint(1, 70))] + [0]
        s = np.array(text)
        order = suffix.suffix_array(s, k + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        got = suffix.common_prefixes(s, order)
        for a, b, n in zip(order, order[1:], got[1:]):
            want = 0
            while max(a, b) + want < len(text) and text[a + want] == text[b + want]:
                want += 1
            assert n == want


@pytest.mark.parametrize("top", [3, 900, 1 << 25])
def test_ranks_of_prefixes_give_the_suffix_array(top):
    """Long repeats, and symbols so large that only two ranks fit one number."""
    draw = random.Random(top)
    for _ in range(30):
        part = [draw.randint(1, top) for _ in range(draw.randint(1, 60))]
        text = part * draw.randint(1, 6) + part[: draw.randint(0, 9)] + [draw.randint(1, top)] + part + [0]
        assert suffix._by_tripling(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_large_alphabets_are_not_induced_one_by_one(monkeypatch):
    draw = random.Random(8)
    text = [draw.randint(1, 255) for _ in range(40_000)] * 2 + [0]
    asked, plain = [], suffix.induce
    monkeypatch.setattr(suffix, "induce", lambda s, small, seeds, symbols: asked.append(symbols) or plain(s, small, seeds, symbols))
    order = suffix.suffix_array(np.array(text), 256)
    assert sorted(order.tolist()) == list(range(len(text))) and max(asked) <= suffix.SMALL
    data = bytes(text)
    assert all(data[a:] < data[b:] for a, b in zip(order[::997].tolist(), order[1::997].tolist()))


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out)


def texts():
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefgé ", k=draw.randint(2, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = [None, "", "x", "ab" * 300, "q" * 500, "q" * 39, "q" * 40, passages[0], passages[0]]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40))) for _ in range(2)]
        cut = draw.randint(0, 40)
        out.append(parts[0] + draw.choice(passages)[cut : draw.randint(cut, 400)] + parts[1])
    return out + [out[12], out[12], passages[1] * 3]


@pytest.mark.parametrize("most, shard", [(2000, 1 << 20), (3, 300)])
def test_removed_bytes(spark, most, shard, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 200)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("owner", F.lit("x"))
    got = suffix.without_repeats(docs.repartition(3), length=40, shard=shard, most=most).drop("doc_id").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == brute([t for _, t in rows], 40)


def test_common_fragments_give_rows_in_proportion_to_their_holders(spark):
    draw = random.Random(4)
    passage = "".join(draw.choices("abcde", k=120))
    counts = []
    for holders in (30, 60):
        rows = [(f"{k}".encode(), 10 * k, 81, 1, 1, True, passage.encode()) for k in range(holders)]
        kind = "key binary, low int, windows int, owner long, copies long, common boolean, bytes binary"
        got = suffix._repeats_by_digest(spark.createDataFrame(rows, kind), 40).collect()
        assert sorted(tuple(r.spans[0]) for r in got) == [(10 * k, 10 * k + 120) for k in range(holders)]
        counts.append(len(got))
    assert counts == [30, 60]


def test_surroundings_lose_no_repeat(spark, monkeypatch):
    """Windows long enough for grams on both sides of an owner."""
    draw = random.Random(3)
    base = "".join(draw.choices("abcde ", k=700))
    rows = [(0, base), (1, "x" * 30 + base[100:420] + "y" * 300), (2, base[380:] + "z"), (3, base[150:349]), (4, "c" * 90 + base[:230])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (100, 200):
        got = suffix.without_repeats(docs, length=length).drop("doc_id").collect()
        assert sorted((*r[:4], bytes(r[4])) for r in got) == brute([t for _, t in rows], length)


def test_given_table(spark):
    rows = table(spark, SF, "documents").select("text").collect()
    got = QUERIES["op6_suffix_array_dedup"](spark, SF).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in brute([r.text for r in rows], 400))
    assert sum(r.n_removed for r in got) > 0


def test_empty(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_repeats_are_not_ordered(monkeypatch):
    """Only fragments that share an owner with others, or occur once, go into the suffix array."""
    asked, plain = [], suffix.repeated_starts

    def repeated_starts(fragments, *rest):
        asked.extend(fragments)
        return plain(fragments, *rest)

    monkeypatch.setattr(suffix, "repeated_starts", repeated_starts)
    alike = {(b"abcdefgh", 5): [1, 3, []], (b"xxbcdefz", 5): [2, 1, []], (b"yybcdefz", 5): [2, 1, []], (b"mnopqrst", 5): [3, 1, []]}
    got = suffix.repeats_of(alike, 4)
    assert {f[0]: starts.tolist() for f, starts in got.items()} == {
        b"abcdefgh": [0, 1, 2, 3, 4], b"xxbcdefz": [2, 3, 4], b"yybcdefz": [2, 3, 4], b"mnopqrst": []}
    assert asked == [b"xxbcdefz", b"yybcdefz", b"mnopqrst"]

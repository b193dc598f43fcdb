"""Hard negatives against plain loops: clustered rows, copies, ties and odd rows; bounds of the tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    whole = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if all(abs(x) * 256 <= hn.LARGEST for x in vec):
            whole.append((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vec)))
    out = []
    for anchor, label, vec in {r for r in whole if r[0] % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), i, y == label) for i, y, v in whole if i != anchor)
        for s, positive, _ in [x for x in scored if x[2]][:positives]:
            fits = [(i, t) for t, i, same in scored if not same and 30 * -s <= -100 * t <= 90 * -s]
            out += [(anchor, positive, n + 1, i, -s, -t) for n, (i, t) in enumerate(fits[:negatives])]
    return sorted(out)


def clustered(n, dim=8, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    of = rng.integers(0, clusters, n)
    x = centres[of] + 0.15 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third are copies
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]


ODD = [
    (None, [1.0] * 8, 1), (5001, None, 1), (5002, [1.0] * 8, None), (5003, [1.0, None] + [0.0] * 6, 1),
    (5004, [float("nan")] * 8, 1), (5005, [float("inf")] * 8, 1), (5006, [1e30] * 8, 1), (5007, [], 1), (5100, [0.5], 2),
    (5008, [0.0] * 8, 2), (5200, [0.0] * 8, 2), (-100, [-0.3] * 8, 3), (5008, [0.25] * 8, 2),
]


def mined(df, **more):
    whole = hn.whole_vectors(df)
    got = hn.mined(whole, whole.where("vec_id % 100 = 0"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 150)
    monkeypatch.setattr(hn, "CHUNK_ROWS", 3)
    rows = clustered(900) + ODD
    rows += [rows[200], rows[17]]  # an anchor and another row repeated
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    clash = df.selectExpr("*", "1 as leaf", "'x' as tag", "2 as vec", "3 as anchor_id", "vec_id as twin")
    assert mined(clash, leaf_rows=60, fan=4) == brute(rows)


def test_empty_and_small(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [], 1)], SCHEMA)) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 1.0], 3)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != []


@pytest.mark.parametrize("percent, up", [(30, True), (90, False)])
def test_shares_are_rounded_to_the_inside(spark, percent, up):
    scores = [-101, -100, -7, -1, 0, 1, 7, 99, 100, 101, 65536]
    df = spark.createDataFrame([(s,) for s in scores], "s long").select(hn.share(F.col("s"), percent, up).alias("x"))
    want = [-(-percent * s // 100) if up else percent * s // 100 for s in scores]
    assert [r.x for r in df.collect()] == want


def test_bounds_hold_and_save_visits(spark):
    df = hn.whole_vectors(spark.createDataFrame(clustered(3000), SCHEMA).repartition(4))
    index = hn.Index(df, leaf_rows=60, fan=6)
    rows = index.rows.toPandas()
    x, leaf = np.stack(rows.vec).astype(np.float64), rows.leaf.to_numpy()
    assert index.tree.leaves > 20 and len(index.tree.nodes) > 3
    assert (index.tree.leaf_of(x.astype(np.int32)) == leaf).all()
    q = x[::50]
    scores = q @ x.T
    low = np.sort(scores, axis=1)[:, -20]
    query, found = index.tree.bounds(q.astype(np.int32), low, np.full(len(q), 1e18))
    needed = {(i, leaf[j]) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
    visited = set(zip(query.tolist(), found.tolist()))
    assert needed <= visited and len(visited) < 0.4 * len(q) * len(set(leaf))
    # An annulus that is closed from inside leaves out the nearest leaves too.
    high = np.quantile(scores, 0.1, axis=1)
    query, found = index.tree.bounds(q.astype(np.int32), np.full(len(q), -1e18), high)
    needed = {(i, leaf[j]) for i, j in zip(*np.nonzero(scores <= high[:, None]))}
    visited = set(zip(query.tolist(), found.tolist()))
    assert needed <= visited and len(visited) < 0.9 * len(q) * len(set(leaf))


def test_exact_types():
    assert hn.exact_type(200, 64) is np.float32
    assert hn.exact_type(60_000, 64) is np.float64
    assert hn.exact_type(hn.LARGEST, 64) is np.int64

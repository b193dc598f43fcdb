"""The machine's margin against all pairs, its gradient steps, odd rows, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import quality
from barscreen.llm.common import table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_margin_equals_the_sum_over_pairs():
    machine = quality.Machine.new(3)
    machine.linear = np.random.default_rng(2).normal(size=len(machine.linear))
    machine.bias = 0.3
    docs = [quality.features(t, {"n": 3}) for t in (b"a b c b", b"", b"xx " * 50 + b"Y.")]
    at, value = (np.concatenate(x) for x in zip(*docs))
    got, _ = machine.margins(at, value, np.array([len(a) for a, _ in docs]))
    for (a, v), margin in zip(docs, got):
        want = machine.bias + sum(machine.linear[i] * x for i, x in zip(a, v))
        for i in range(len(a)):
            for j in range(i):
                want += machine.factors[a[i]] @ machine.factors[a[j]] * v[i] * v[j]
        assert margin == pytest.approx(want)


def test_interactions_are_learned():
    """Neither word decides alone: only pairs tell the classes apart."""
    texts = [b"red round", b"blue square", b"red square", b"blue round"] * 60
    labels = np.array([1.0, 1.0, 0.0, 0.0] * 60)
    machine = quality.Machine.new()
    docs = [quality.features(t, {}) for t in texts]
    machine.fit(docs, labels, epochs=60)
    at, value = (np.concatenate(x) for x in zip(*docs))
    margin, _ = machine.margins(at, value, np.array([len(a) for a, _ in docs]))
    assert ((margin > 0) == (labels == 1)).all()


def test_held_out(spark):
    rows = QUERIES["op10_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # The prediction itself, not only the order: of either label most are told right.
    for quality in (0, 1):
        assert np.mean([r.predicted == quality for r in held if r.quality == quality]) >= 0.75


def test_calibration_gives_log_odds():
    """Margins whose odds are known, stretched and shifted, come back; parted labels give a finite slope."""
    draw = np.random.default_rng(4)
    odds = draw.normal(0.5, 1.5, 20_000)
    labels = (draw.random(20_000) < quality.expit(odds)).astype(float)
    slope, shift = quality.calibration(odds / 3 + 7, labels)
    assert np.abs(quality.expit(slope * (odds / 3 + 7) + shift) - quality.expit(odds)).max() < 0.03
    slope, shift = quality.calibration(np.array([-1.0, -2, 1, 2]), np.array([0.0, 0, 1, 1]))
    assert 0 < slope < 10 and abs(shift) < 1
    assert quality.calibration(np.array([1.0, -1, 1, -1]), np.array([0.0, 1, 0, 1]))[0] == 0


def test_rescaling_changes_margins_alone():
    machine = quality.Machine.new(3)
    docs = [quality.features(t, {}) for t in (b"a b c", b"d e", b"")]
    before = machine.of(docs)
    machine.rescale(2.5, -1)
    assert np.allclose(machine.of(docs), 2.5 * before - 1)


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, None), (2, "", 5), (3, "w " * 100_000, 1), (None, "x", 2), (4, "a\x00b é", -7), (4, "a\x00b é", -7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("label", F.lit("x")).withColumn("m0", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    machine = quality.learn(docs, labels)
    got = quality.scored(docs, machine).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), machine).count() == 0

"""Document quality by a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its distinct words hashed to buckets (damped counts, scaled to unit
length), statistics of its structure cut into steps, and metadata columns as fields of their own. The score
is `bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)`: all pairwise interactions
in time linear in the number of features. Learning goes on until the loss on a share of the labelled documents kept aside no longer
falls; then the scores are calibrated on that share, so that a threshold on them means a probability.

Edge cases: a null text counts as empty and has structure features only, so it gets a score; null
metadata is a value of its own; labels other than 0 and 1 and null labels are not learned from; a
document labelled twice with both values is learned from twice; without labels every score is 0.5; where the share
kept aside lacks one of the labels, learning takes a fixed number of rounds and no calibration;
repeated rows score alike; columns other than those named are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import text_batches

BUCKETS = 1 << 16
#: Buckets after those of the words, for structure and metadata.
EXTRA = 1 << 10
FACTORS = 8
#: Labelled documents learned from, about: a bounded sample chosen by a hash of the id.
SAMPLE = 8000
#: Rounds at most; learning stops when the loss on the share kept aside has not fallen by this part for so many rounds.
EPOCHS = 120
GAIN = 0.05
PATIENCE = 2
#: One in so many labelled documents is kept aside to end learning and to calibrate.
ASIDE = 5
BATCH = 64
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _step(value: float, edges: list[float]) -> int:
    return sum(value > e for e in edges)


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[tuple[str, int]]:
    """(statistic, step) pairs of a text's form."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = text.split(b"\n")
    upper = sum(1 for w in words if w.isupper())
    digits = len(text) - len(text.translate(None, b"0123456789"))
    marks = len(text) - len(text.translate(None, MARKS))
    tenths = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]
    return [
        ("words", _step(len(words), [0, 2, 5, 10, 20, 50, 100, 300, 1000, 5000])),
        ("distinct", _step(len(counts) / n, tenths)),
        ("commonest", _step(max(counts.values(), default=0) / n, tenths)),
        ("marks", _step(marks / size, tenths)),
        ("digits", _step(digits / size, tenths)),
        ("upper", _step(upper / n, tenths)),
        ("word length", _step(len(text) / n, [2, 3, 4, 5, 6, 7, 8, 10, 14, 20])),
        ("lines", _step(len(lines), [1, 2, 4, 8, 16, 64, 256])),
        ("repeated lines", _step(1 - len(set(lines)) / len(lines), tenths)),
    ]


def features(text: bytes, metadata: dict[str, object]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document."""
    words = text.split()
    counts = Counter(words)
    crc = zlib.crc32
    at = [crc(w) & BUCKETS - 1 for w in counts]
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(value):
        value /= math.sqrt(float((value**2).sum()))
    fields = [*structure(text, words, counts), *metadata.items()]
    more = [BUCKETS + crc(f"{name}={part}".encode()) % EXTRA for name, part in fields]
    return np.array(at + more, np.int64), np.concatenate([value, np.full(len(more), 0.3)])


def metadata_steps(batch: pa.RecordBatch, columns: list[str]) -> list[dict[str, object]]:
    """Metadata of each row: numbers by their order of magnitude, anything else as it is."""
    out: list[dict[str, object]] = [{} for _ in range(batch.num_rows)]
    for name in columns:
        for row, value in zip(out, batch.column(name).to_pylist()):
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            row[name] = round(2 * math.log2(1 + abs(value))) if number else value
    return out


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def new(cls, seed: int = 1) -> Machine:
        size = BUCKETS + EXTRA
        return cls(0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, FACTORS)))

    def margins(self, at: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each document, and its factor sums; every document has at least one feature."""
        begin = np.cumsum(sizes) - sizes
        weighted = self.factors[at] * value[:, None]
        sums = np.add.reduceat(weighted, begin)
        squares = np.add.reduceat((weighted**2).sum(1), begin)
        linear = np.add.reduceat(self.linear[at] * value, begin)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> None:
        """Learn from all but a share, which tells when to stop and how to calibrate."""
        aside = np.arange(len(docs)) % ASIDE == ASIDE - 1
        own, tests = [d for d, a in zip(docs, aside) if not a], [d for d, a in zip(docs, aside) if a]
        if len(set(labels[aside])) < 2:
            for _ in self.rounds(docs, labels, min(epochs, 4 * ASIDE), seed):
                pass
            return
        best, goal, kept, since = math.inf, math.inf, self.copy(), 0
        for _ in self.rounds(own, labels[~aside], epochs, seed):
            loss = log_loss(self.of(tests), labels[aside])
            since += 1
            if loss < best:
                best, kept = loss, self.copy()
            if loss < goal:
                goal, since = loss * (1 - GAIN), 0
            if since == PATIENCE:
                break
        self.bias, self.linear, self.factors = kept.bias, kept.linear, kept.factors
        self.rescale(*calibration(self.of(tests), labels[aside]))

    def copy(self) -> Machine:
        return Machine(self.bias, self.linear.copy(), self.factors.copy())

    def of(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Margins of documents."""
        at, value = (np.concatenate(x) for x in zip(*docs))
        return self.margins(at, value, np.array([len(a) for a, _ in docs]))[0]

    def rescale(self, slope: float, shift: float) -> None:
        """Make every margin m into slope * m + shift."""
        self.bias = slope * self.bias + shift
        self.linear = slope * self.linear
        self.factors = math.sqrt(slope) * self.factors

    def rounds(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 1) -> Iterator[int]:
        """Logistic loss, minimised by AdaGrad over shuffled batches; stops after each round."""
        draw = np.random.default_rng(seed)
        sums_w, sums_v = np.full(len(self.linear), 1e-3), np.full(self.factors.shape, 1e-3)
        rate = float(labels.mean())
        self.bias = math.log((rate + 1e-3) / (1 - rate + 1e-3))
        for epoch in range(epochs):
            order = draw.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                at, value = (np.concatenate(x) for x in zip(*(docs[i] for i in own)))
                sizes = np.array([len(docs[i][0]) for i in own])
                margin, sums = self.margins(at, value, sizes)
                off = (expit(margin) - labels[own]) / len(own)
                error = np.repeat(off, sizes)
                slope_w = error * value
                slope_v = slope_w[:, None] * (np.repeat(sums, sizes, axis=0) - self.factors[at] * value[:, None])
                used, place = np.unique(at, return_inverse=True)
                by_w = np.bincount(place, slope_w) + 1e-6 * self.linear[used]
                by_v = np.stack([np.bincount(place, slope_v[:, f]) for f in range(FACTORS)], 1) + 1e-5 * self.factors[used]
                sums_w[used] += by_w**2
                sums_v[used] += by_v**2
                self.linear[used] -= 0.2 * by_w / np.sqrt(sums_w[used])
                self.factors[used] -= 0.05 * by_v / np.sqrt(sums_v[used])
                self.bias -= 0.05 * float(off.sum())
            yield epoch


def log_loss(margins: np.ndarray, labels: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(labels == 1, -margins, margins)).mean())


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins log odds: least logistic loss against labels drawn towards each other.

    The targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) for n1 and n0 labels, so the slope is finite where the margins part the
    labels; it is never negative.
    """
    ones = float((labels == 1).sum())
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    # Scaled to deviation one, which the steps are made for.
    middle, scale = float(margins.mean()), max(float(margins.std()), 1e-6)
    x = np.stack([(margins - middle) / scale, np.ones(len(margins))], 1)
    weights = np.zeros(2)
    for _ in range(50):
        p = expit(x @ weights)
        slope = x.T @ (p - target) + 1e-6 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
    gradient = max(float(weights[0]), 0.0) / scale
    return gradient, float(weights[1]) - gradient * middle


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    metadata: tuple[str, ...] = ("n_chars",),
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Machine:
    """A machine fitted to about `sample` of the labelled documents, in one task."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("label")).where("label in (0, 1)")
    total = max(1, known.count())
    # About `sample` rows are left, so the broadcast is bounded and the texts stay where they are.
    known = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < min(1.0, sample / total) * float(1 << 30))
    fields = [F.col(c).alias(f"m{k}") for k, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), *fields).join(F.broadcast(known), "i")
    names = [f"m{k}" for k in range(len(metadata))]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = [features(t, m) for t, m in zip(texts, metadata_steps(batch, names))]
            yield pa.RecordBatch.from_pydict({
                "i": batch.column("i").cast(pa.string()), "label": batch.column("label"),
                "at": pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()),
                "value": pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, marks = [], []
        for batch in batches:
            marks += batch.column("label").to_pylist()
            found += [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64))
                      for a, v in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist())]
        if found:
            machine = Machine.new()
            machine.fit(found, np.array(marks))
            weights = np.concatenate([[machine.bias], machine.linear, machine.factors.ravel()]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary())})

    small = rows.mapInArrow(featured, "i string, label double, at binary, value binary")
    fitted = small.repartition(1).sortWithinPartitions("i", "label", "at").mapInArrow(fit, "weights binary").first()
    if fitted is None:
        return Machine(0.0, np.zeros(BUCKETS + EXTRA), np.zeros((BUCKETS + EXTRA, FACTORS)))
    weights = np.frombuffer(fitted.weights, np.float32)
    size = BUCKETS + EXTRA
    return Machine(float(weights[0]), weights[1 : size + 1], weights[size + 1 :].reshape(size, FACTORS))


def scored(
    docs: DataFrame,
    machine: Machine,
    metadata: tuple[str, ...] = ("n_chars",),
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [f"m{k}" for k in range(len(metadata))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch, texts in text_batches(batches):
            found = [features(t, m) for t, m in zip(texts, metadata_steps(batch, names))]
            at, value = (np.concatenate(x) for x in zip(*found))
            margin, _ = machine.margins(at, value, np.array([len(a) for a, _ in found]))
            score = expit(margin.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    fields = [F.col(c).alias(n) for n, c in zip(names, metadata)]
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *fields)
    return wanted.mapInArrow(run, "doc_id long, score double, predicted int")

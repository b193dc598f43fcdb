"""Scores of texts under a log-bilinear language model trained with noise-contrastive estimation.

Spark counts every token of the training texts. The most frequent words and the end of a text are
classes of their own; every other word belongs to one of a few classes by its ending. The model
predicts a token's class from the two classes before it: the context vectors, each multiplied by a
matrix of its position, add up to a prediction whose dot product with each class vector, plus a bias,
is a logit. Each task trains on all tokens of its share, starting from the same weights, against noise
drawn from the class frequencies; the tasks' weights are averaged by their number of tokens, and that is
repeated. Scoring normalises exactly over all classes; within a class a word has the add-one share of
its count, with one part left for unknown words. So the probabilities of all words add up to one.

Counts of the `frequent` most frequent words (a fixed bound) are sent to the tasks; the words of a text
beyond these meet their counts in a join.

Edge cases: null counts as empty, which is the end alone; without training texts all words share one
class distribution of equal parts; equal texts get equal scores, so repeated rows do too; a null id
counts as empty text in the choice of held-out rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import kept, stored, text_batches

#: The end of a text; no word holds a space.
END = b" "
#: Words that are classes of their own, and classes of the other words.
OWN, OTHER = 1000, 23
SIZE = 24
NOISE = 100
BATCH = 1024
ROUNDS = 2
RATE = 0.1
FREQUENT = 1 << 19
#: Distinct words a task counts before it hands them on.
HELD = 300_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def batch_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different tokens of `texts`, `END` last; the place there of every token in text order; tokens of each text.

    The same as `tokens` of each text; Arrow splits them and tells the different ones.
    """
    low = pa.compute.ascii_lower(pa.compute.fill_null(texts, ""))
    split = pa.compute.ascii_split_whitespace(low)
    found = split.flatten().dictionary_encode()
    words, at = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at either end of a text leaves an empty word there.
    empty = pa.compute.index(words, b"").as_py()
    if empty >= 0:
        real = at != empty
        sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(sizes)])])
        at = at[real]
    every = np.full(len(at) + len(sizes), len(words), np.int64)
    inside = np.ones(len(every), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    every[inside] = at
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), every, sizes + 1


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, the end of each included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch, _ in text_batches(batches):
            words, at, _ = batch_tokens(batch.column("text"))
            n = np.bincount(at, minlength=len(words))
            held.append(pa.table({"word": words, "n": n}).filter(pa.array(n > 0)))
            if sum(map(len, held)) > HELD:
                held = [_added_up(held)]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from _added_up(held).to_batches()

    rows = docs.select(F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added_up(counts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return summed.select(["word", "n_sum"]).rename_columns(["word", "n"])


@cache
def ending_classes() -> np.ndarray:
    """Class of a word by its last byte and the one before it, 256 for none, counted from the first class of several words."""
    pairs = [bytes([a, b]) if a < 256 else bytes([b]) for a in range(257) for b in range(256)]
    return np.array([zlib.crc32(p) % OTHER for p in pairs]).reshape(257, 256)


@dataclass
class Words:
    """Counts and classes of words; classes 0 to `own` - 1 are single words, the others follow."""

    total: int
    distinct: int
    counts: dict[bytes, int]  # of the frequent words
    own: dict[bytes, int] = field(default_factory=dict)
    class_counts: np.ndarray | None = None  # tokens of each class
    class_parts: np.ndarray | None = None  # tokens, distinct words and one, of each class of several words

    @property
    def classes(self) -> int:
        return len(self.own) + OTHER

    def class_of(self, word: bytes) -> int:
        number = self.own.get(word)
        return len(self.own) + zlib.crc32(word[-2:]) % OTHER if number is None else number

    def classes_of(self, words: pa.Array) -> np.ndarray:
        """Class of each word, none of them empty, in a short type."""
        short = np.min_scalar_type(self.classes)
        own = pa.compute.index_in(words, value_set=pa.array(list(self.own), pa.binary()))
        numbers = np.array(list(self.own.values()), short)
        known = own.is_valid().to_numpy(zero_copy_only=False)
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)
        ends = np.where(known, data.size and 1, bounds[1:])  # an own word is not looked at
        last, before = data[ends - 1].astype(np.int64), data[np.maximum(ends - 2, 0)].astype(np.int64)
        found = (len(self.own) + ending_classes()[np.where(np.diff(bounds) > 1, before, 256), last]).astype(short)
        found[known] = numbers[own.drop_null().to_numpy()]
        return found


def learn_words(counts: DataFrame, frequent: int = FREQUENT) -> Words:
    """From a stored table of counts. What reaches the driver is bounded by `frequent`."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, held = 1 << 62, 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):  # at most eight steps for each power of two
        held += row.words
        if held > frequent:
            break
        least = row.least
    rows = counts.where(F.col("n") >= least).toArrow()
    known = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
    words = Words(int(total[0] or 0), int(total[1]), known)
    ranked = sorted(known, key=lambda w: (-known[w], w))[:OWN]
    words.own = {w: k for k, w in enumerate(dict.fromkeys([END, *ranked]))}

    shared = Words(0, 0, {}, words.own)  # the tasks need the classes only

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = np.zeros(shared.classes, np.int64), np.zeros(shared.classes, np.int64)
        for batch in batches:
            at = np.array([shared.class_of(w) for w in batch.column("word").to_pylist()], np.int64)
            np.add.at(n, at, batch.column("n").to_numpy())
            np.add.at(parts, at, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shared.classes), pa.int32()), pa.array(n), pa.array(parts)], ["class", "n", "words"])

    sums = counts.mapInArrow(classed, "class int, n long, words long").groupBy("class").agg(F.sum("n"), F.sum("words")).collect()
    words.class_counts, words.class_parts = np.zeros(words.classes), np.ones(words.classes)
    for number, n, several in sums:
        words.class_counts[number] = n
        words.class_parts[number] = n + several + 1
    return words


@dataclass
class LogBilinear:
    """Weights of the model: word vectors as context and as target, a matrix per position, biases."""

    context: np.ndarray
    target: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, class_counts: np.ndarray, seed: int = 7) -> LogBilinear:
        draw, n = np.random.default_rng(seed), len(class_counts)
        part = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        share = (class_counts + 1) / (class_counts + 1).sum()
        eye = np.eye(SIZE, dtype=np.float32)
        return cls(part(n, SIZE), part(n, SIZE), eye * np.float32(0.7), eye * np.float32(0.5), np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.near, self.far, self.bias)]).astype(np.float64)

    def with_weights(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for x in (self.context, self.target, self.near, self.far, self.bias):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*parts)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every class after each class at the near and at the far position, biases in the first."""
        near = (self.context @ self.near) @ self.target.T + self.bias
        return near.astype(np.float32), ((self.context @ self.far) @ self.target.T).astype(np.float32)


def contexts(classes: np.ndarray, counts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before each token; before a text stands the end."""
    first = np.cumsum(counts) - counts
    one, two = np.full_like(classes, end), np.full_like(classes, end)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[first] = two[first] = end
    second = first[counts > 1] + 1
    two[second] = end
    return one, two


class Trainer:
    """Noise-contrastive estimation by AdaGrad; `model` is changed in place."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int):
        self.model, self.log_noise = model, np.log(noise * NOISE).astype(np.float32)
        self.edges, self.draw = np.cumsum(noise), np.random.default_rng(seed)
        # What takes the same step stands side by side: target vectors and biases (a last column stays 0 and makes
        # rows even), and the two matrices.
        self.targets = np.concatenate([model.target, model.bias[:, None], np.zeros_like(model.bias)[:, None]], 1)
        model.target, model.bias = self.targets[:, :SIZE], self.targets[:, SIZE]
        self.places = np.concatenate([model.near, model.far])
        model.near, model.far = self.places[:SIZE], self.places[SIZE:]
        self.short = np.min_scalar_type(len(noise))
        self.sums = [np.full(x.shape, 1e-2, np.float32) for x in (model.context, self.targets, self.places)]

    def _step_rows(self, k: int, weights: np.ndarray, slope: np.ndarray, rows: np.ndarray) -> None:
        """A step on some rows of `weights`; slopes of the same row add up."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        used = rows[first]
        # Two floats are added at a time where they are seen as one complex number.
        total = np.add.reduceat(slope[order].view(np.complex64), first, axis=0).view(np.float32)
        sums = self.sums[k][used] + total**2
        self.sums[k][used] = sums
        weights[used] -= np.float32(RATE) * total / np.sqrt(sums)

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        n = len(word)
        noise = np.minimum(np.searchsorted(self.edges, self.draw.random(NOISE)), len(self.edges) - 1)
        # Short integers are sorted by their digits.
        before, after = (np.stack([one, two], 1).ravel().astype(self.short), np.concatenate([word, noise]).astype(self.short))
        both = self.model.context[before].reshape(n, 2 * SIZE)
        predicted = np.zeros((n, SIZE + 2), np.float32)
        predicted[:, :SIZE] = both @ self.places
        predicted[:, SIZE] = 1
        targets = self.targets[after]
        targets[:, SIZE] -= self.log_noise[after]
        own, theirs = targets[:n], targets[n:]
        part = np.float32(1 / n)
        with np.errstate(over="ignore"):  # one by infinity is 0
            real = -part / (1 + np.exp(np.einsum("ij,ij->i", predicted, own)))
            false = predicted @ -theirs.T
            np.exp(false, out=false)
        false += 1
        np.divide(part, false, out=false)
        back = false @ theirs[:, :SIZE]
        back += real[:, None] * own[:, :SIZE]
        slope = both.T @ back
        self.sums[2] += slope**2
        self.places -= np.float32(RATE) * slope / np.sqrt(self.sums[2])
        self._step_rows(0, self.model.context, (back @ self.places.T).reshape(2 * n, SIZE), before)
        self._step_rows(1, self.targets, np.concatenate([real[:, None] * predicted, false.T @ predicted]), after)


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS, text_col: str = "text") -> LogBilinear:
    """A model trained on all tokens of `docs`."""
    spark = docs.sparkSession
    noise = (words.class_counts + 1) / (words.class_counts + 1).sum()
    model = LogBilinear.new(words.class_counts)
    rows = docs.select(F.col(text_col).alias("text"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((Words(0, 0, {}, words.own), model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            words, start = shared.value
            trainer = Trainer(start.with_weights(start.flat()), noise, turn)
            seen = 0
            for batch, _ in text_batches(batches):
                different, at, counts = batch_tokens(batch.column("text"))
                at = words.classes_of(different)[at]
                order = trainer.draw.permutation(len(at))
                one, two, at = (x[order] for x in (*contexts(at, counts), at))
                for k in range(0, len(at), BATCH):
                    trainer.learn(one[k : k + BATCH], two[k : k + BATCH], at[k : k + BATCH])
                seen += len(at)
            if seen:
                weights = trainer.model.flat()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(weights), dtype=np.int32)), pa.array(weights * seen), pa.array(np.full(len(weights), seen))],
                    ["at", "weight", "seen"])

        summed = rows.mapInArrow(run, "at int, weight double, seen long").groupBy("at").agg(F.sum("weight").alias("w"), F.sum("seen").alias("s"))
        found = summed.toArrow()
        if found.num_rows:
            flat = np.zeros(found.num_rows)
            flat[found.column("at").to_numpy()] = found.column("w").to_numpy() / found.column("s").to_numpy()
            model = model.with_weights(flat)
    return model


class Scorer:
    """Normalised log10 probabilities of classes; the sums over all classes are kept by context."""

    def __init__(self, model: LogBilinear):
        self.near, self.far = model.tables()
        self.sums = np.full((len(self.near), len(self.near)), np.nan, np.float32)

    def of(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        n = len(self.near)
        missing = np.flatnonzero(np.isnan(self.sums[one, two]))
        missing = np.unique(one[missing].astype(np.int64) * n + two[missing])
        for k in range(0, len(missing), 256):  # about 1 MB of logits
            a, b = np.divmod(missing[k : k + 256], n)
            logits = self.near[a] + self.far[b]
            top = logits.max(1)
            self.sums[a, b] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        return (self.near[one, word] + self.far[two, word] - self.sums[one, two]).astype(np.float64) / math.log(10)


def scored(docs: DataFrame, counts: DataFrame, words: Words, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model))
    base, mark = math.log10(words.total + words.distinct + 1), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        ends = len(words.own)
        parts = np.log10(words.class_parts)
        scorer = kept(mark, lambda: Scorer(model))
        for batch, texts in text_batches(batches, most=2 << 20):
            different, every, sizes = batch_tokens(batch.column("text"))
            classes, different = words.classes_of(different), different.to_numpy(zero_copy_only=False)
            known = np.fromiter(map(words.counts.get, different, repeat(-1)), np.int64, len(different))  # -1 must be looked up
            logs_of = np.log10(np.maximum(known, 0) + 1.0)
            inside = np.where(classes >= ends, logs_of - parts[classes], 0)
            at, n, here = classes[every], known[every], logs_of[every]
            logs = scorer.of(*contexts(at, sizes), at) + inside[every]
            begin = np.cumsum(sizes) - sizes
            rest: list[list[tuple[bytes, int]]] = [[] for _ in texts]
            missing = np.flatnonzero(n < 0)
            docs_of = np.searchsorted(begin, missing, "right") - 1
            for (doc, word), times in Counter(zip(docs_of.tolist(), (different[k] for k in every[missing].tolist()))).items():
                rest[doc].append((word, times))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((n > 0).astype(np.int64), begin)),
                    pa.array(np.add.reduceat(here, begin)),
                    pa.array(np.add.reduceat(logs, begin)),
                    pa.array([[{"word": w, "times": k} for w, k in r] for r in rest], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))),
                ],
                names,
            )

    names = ["doc_id", "digest", "n_tokens", "n_known", "base", "score", "rest"]
    kind = "doc_id long, digest binary, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,times:int>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = stored(rows.mapInArrow(run, kind), "scores")
    rest = part.select("digest", F.explode("rest").alias("r")).select("digest", "r.word", "r.times").distinct()
    found = rest.join(counts, "word").groupBy("digest").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    whole = part.drop("rest").join(found, "digest", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

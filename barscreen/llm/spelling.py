"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word is its vector of letter counts in `DIMENSIONS` dimensions. One inserted, deleted or replaced letter moves
the vector by at most one step up in one dimension and at most one step down in another. For each length
a k-d tree splits the words; a word searches the tree of its own length with a step up and a step down to
spend, and that of the next length with a step up. Crossing a split plane spends a step, and boxes out of reach
are pruned. In a leaf all vectors are compared by one matrix product, and what is near enough is verified
letter by letter, so exactly the pairs of one edit are found.

The trees are fitted to a bounded sample (`SAMPLE` words, those of the least hashes), which decides only where the planes
lie; every word is in a leaf. Lengths above `LONGEST` and lengths with few words have one leaf each. A leaf with more than `BLOCK`
words is dealt into blocks by a hash of the word, and its searches go to every block, so no number of anagrams
fills one task. Two words of one length are compared in the leaf of the later one only. A task sends
one row per word and leaf: how many near words it found, and the best of them. Only the sample and the number of words by length reach the driver.

The occurrences are counted by built-in functions, so a word with a third of all occurrences is one row
per task. Roots are found by doubling the steps along forms; since a form is at least `ratio` times as
frequent as its word, chains are at most log(n) long.

Odd rows. A null or empty text has no words. A null `doc_id` counts as an empty one. Repeated rows count
again. Of near words with equal counts the first in code-point order is the form. Very long texts and runs are taken whole.
Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import stored
from barscreen.llm.urls import plain_lower

#: Fixed value: the letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]"
DIMENSIONS = 32
LEAF, BLOCK, LONGEST = 512, 4096, 64
SAMPLE, LEAST_SAMPLE = 65_536, 8
CELLS = 1 << 22


def long_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run) of every maximal run of at least `least` letters, A to Z lower-cased."""
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", plain_lower(F.col("run")))


def mistyped(doc_id: Column, run: Column, each: int) -> Column:
    """The run without one letter where `each` divides its hash; the hash says which letter."""
    place = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(place.cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(each)) == 0, cut).otherwise(run)


def counted(words: DataFrame, least_letters: int, least_count: int) -> DataFrame:
    """(word, n) of the words of enough letters and occurrences."""
    counts = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def vectors_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts: a dimension for each of a to z, six for all other letters."""
    others = np.array([0, 27, 28, 29, 30, 31])
    latin = (letters >= 97) & (letters <= 122)
    dimension = np.where(latin, letters - 96, others[letters % 6]).astype(np.int64)
    place = np.arange(len(letters))[:, None] * DIMENSIONS + dimension
    return np.bincount(place.ravel(), minlength=len(letters) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


class Trees:
    """A k-d tree for every length that has one; leaves are numbered over all trees, `-length` is the leaf of a length without."""

    def __init__(self, sample: list[str], counts: dict[int, int], leaf: int = LEAF):
        self.roots: dict[int, int] = {}
        #: Dimension and threshold of inner nodes, with both children; a leaf has dimension -1 and its number.
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        for length, words in sorted(by_length.items()):
            if counts.get(length, 0) > leaf:
                self.roots[length] = self._grown(vectors_of(letters_of(words)), counts[length] / len(words), leaf)
        self.table = np.array(self.nodes or [(-1, 0, 0, 0)], np.int64)

    def _grown(self, v: np.ndarray, each: float, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append((-1, self.leaves, 0, 0))
        if len(v) * each > leaf and len(v) >= 2 * LEAST_SAMPLE:
            below = np.stack([(v <= t).mean(0) for t in range(int(v.max()))])
            even = np.abs(below - 0.5)
            threshold, dimension = np.unravel_index(np.argmin(even), even.shape)
            left = v[:, dimension] <= threshold
            if min(left.sum(), (~left).sum()) >= LEAST_SAMPLE:
                a = self._grown(v[left], each, leaf)
                b = self._grown(v[~left], each, leaf)
                self.nodes[number] = (int(dimension), int(threshold), a, b)
                return number
        self.leaves += 1
        return number

    def search(self, length: int, v: np.ndarray, up: bool, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves of `length` that hold vectors within a step up and a step down of the row."""
        if length not in self.roots:
            return np.arange(len(v)), np.full(len(v), -length)
        row = np.arange(len(v))
        node = np.full(len(v), self.roots[length])
        free = -1
        # Dimension in which the step up (down) was spent; a step that there is none of is spent outside.
        rise, fall = (np.full(len(v), free if may else DIMENSIONS) for may in (up, down))
        found = []
        while len(row):
            dimension, threshold, left, right = self.table[node].T
            ends = dimension < 0
            if ends.any():
                found.append((row[ends], threshold[ends]))
                keep = ~ends
                row, rise, fall = row[keep], rise[keep], fall[keep]
                dimension, threshold, left, right = dimension[keep], threshold[keep], left[keep], right[keep]
            value = v[row, dimension] + (rise == dimension) - (fall == dimension)
            is_left = value <= threshold
            climbs = (value == threshold) & (rise == free) & (fall != dimension)
            drops = (value == threshold + 1) & (fall == free) & (rise != dimension)
            node = np.concatenate([np.where(is_left, left, right), right[climbs], left[drops]])
            rise = np.concatenate([rise, dimension[climbs], rise[drops]])
            fall = np.concatenate([fall, fall[climbs], dimension[drops]])
            row = np.concatenate([row, row[climbs], row[drops]])
        if not found:
            return row, row
        return tuple(np.concatenate(x) for x in zip(*found))


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {length: np.flatnonzero(lengths == length) for length in np.unique(lengths).tolist()}


def at_home(trees: Trees):
    """(word, n) with the word's leaf."""

    def homes(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            leaf = np.zeros(len(words), np.int64)
            for length, rows in _by_length(words).items():
                v = vectors_of(letters_of([words[i] for i in rows]))
                row, found = trees.search(length, v, False, False)
                leaf[rows[row]] = found
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(leaf)], ["word", "n", "leaf"])

    return homes


def reached(trees: Trees, most: int = 4096):
    """(word, n, leaf, own): the leaves in which a word looks for near ones, of its own length or the next."""

    def reach(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, most):
                batch = whole.slice(begin, most)
                words, home = batch.column("word").to_pylist(), batch.column("leaf").to_numpy()
                taken, leaves = [], []
                for length, rows in _by_length(words).items():
                    v = vectors_of(letters_of([words[i] for i in rows]))
                    row, leaf = trees.search(length, v, True, True)
                    later = leaf >= home[rows[row]]
                    taken.append(rows[row[later]])
                    leaves.append(leaf[later])
                    row, leaf = trees.search(length + 1, v, True, False)
                    taken.append(rows[row])
                    leaves.append(leaf)
                row, leaf = np.concatenate(taken), np.concatenate(leaves)
                found = batch.select(["word", "n"]).take(pa.array(row))
                own = pa.array(leaf == home[row])
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(leaf), own], ["word", "n", "leaf", "own"])

    return reach


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the longer `b` is `a` with one letter put in."""
    before, after = a == b[:, :-1], a == b[:, 1:]
    n = a.shape[1]
    prefix = np.where(before.all(1), n, before.argmin(1))
    suffix = np.where(after.all(1), n, after[:, ::-1].argmin(1))
    return prefix + suffix >= n


def near_pairs(known: list[str], asked: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in asked, place in known) of words one edit apart; `known` has one length, `asked` that or one less.

    Where `own`, the asked word is among `known` and meets the later ones only.
    """
    letters = letters_of(known)
    v = vectors_of(letters).astype(np.float32)
    size = (v * v).sum(1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for length, rows in _by_length(asked).items():
        same = length == letters.shape[1]
        others = letters_of([asked[i] for i in rows])
        w = vectors_of(others).astype(np.float32)
        most = 2 if same else 1
        check = one_replaced if same else one_inserted
        step = max(1, CELLS // len(known))
        for begin in range(0, len(rows), step):
            part = w[begin : begin + step]
            gap = (part * part).sum(1)[:, None] + size - 2 * (part @ v.T)
            r, c = np.nonzero(gap <= most)
            r += begin
            each = max(1, CELLS // letters.shape[1])
            for at in range(0, len(r), each):
                i, j = r[at : at + each], c[at : at + each]
                good = check(others[i], letters[j])
                i, j = rows[i[good]], j[good]
                if same:
                    later = np.fromiter((not own[x] or asked[x] < known[y] for x, y in zip(i, j)), bool, len(i))
                    i, j = i[later], j[later]
                found.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*found))


def compared(known: pa.Table, asked: pa.Table) -> pa.Table:
    """(word, near, best_n, best): of each word that is near another in this leaf, how many it is near to and the best of them."""
    names, kinds = ["word", "near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
    if not known.num_rows or not asked.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    words = known.column("word").to_pylist()
    others = asked.column("word").to_pylist()
    i, j = near_pairs(words, others, asked.column("own").to_numpy(zero_copy_only=False))
    n = np.concatenate([known.column("n").to_numpy(), asked.column("n").to_numpy()])
    every = words + others
    involved, back = np.unique(np.concatenate([j, i + len(words)]), return_inverse=True)
    order = sorted(range(len(involved)), key=lambda x: every[involved[x]])
    rank = np.empty(len(involved), np.int64)
    rank[order] = np.arange(len(order))
    right, left = back[: len(j)], back[len(j) :]
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    best = np.lexsort((rank[target], -n[involved[target]], source))
    source, target = source[best], target[best]
    first = np.flatnonzero(np.diff(source, prepend=-1))
    near = np.diff(np.append(first, len(source)))
    named = [[every[k] for k in involved[x[first]].tolist()] for x in (source, target)]
    columns = [named[0], near, n[involved[target[first]]], named[1]]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def fitted(words: DataFrame, leaf: int = LEAF) -> Trees:
    """Trees over a sample of `words`."""
    length = F.length("word").alias("length")
    short = words.where(F.length("word") <= LONGEST)
    counts = dict(map(tuple, short.groupBy(length).count().collect()))
    sample = short.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).toArrow()
    return Trees(sample.column("word").to_pylist(), counts, leaf)


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, n, n_near, best, best_n) of every row (word, n) of `words`, which are distinct."""
    trees = fitted(words, leaf)
    homes = stored(words.mapInArrow(at_home(trees), "word string, n long, leaf long"), "word-leaves")
    asked = homes.mapInArrow(reached(trees), "word string, n long, leaf long, own boolean")
    crowded = homes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("word"), blocks).alias("block")
    known = homes.join(crowded, "leaf", "left").select("word", "n", "leaf", block)
    block = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    asked = asked.join(crowded, "leaf", "left").select("word", "n", "leaf", "own", block)
    met = known.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block"))
    found = met.applyInArrow(compared, "word string, near long, best_n long, best string")
    every = words.selectExpr("word", "n", "0L as near", "cast(null as long) as best_n", "cast(null as string) as best")
    every = every.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("found")
    summed = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best)
    return summed.select("word", "n", "n_near", F.col("found.best").alias("best"), (-F.col("found.less")).alias("best_n"))


def variants(words: DataFrame, ratio: int = 10, leaf: int = LEAF) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row (word, n) of `words`, which are distinct."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = stored(words, "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = near_words(words, leaf).select(
        "word",
        "n",
        "n_near",
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    found = stored(found, "forms")
    least, most = words.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / least, ratio) + 1e-9) + 1 if most else 1
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots = stored(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Passages of benchmark items inside documents.

For every benchmark item of n words, the document's windows of n words are its possible copies; a
document with fewer words is one window. A
window's SimHash fingerprint over five-word shingles is looked up among the fingerprints of the items
of its length by multi-index Hamming blocks: 64 bits are cut into `radius + 1` blocks, and two
fingerprints within the radius agree in one block at least, so none is missed. Candidates are verified
exactly: the weighted Jaccard similarity of the two shingle multisets must reach `least`.

A window that reaches it holds at least that share of the item's shingles, so windows with fewer known
shingles are left out before a fingerprint is made; nothing is lost by this. Items are a given set of
queries: they are processed in blocks of bounded size, each sent to all tasks, however many there are.

Words are compared in lower case without the marks around them. Edge cases: null and empty texts and
items match nothing; an item with fewer than five words is one shingle; equal items are reported each;
of several windows of one document that match an item the most similar, then the first, is reported;
repeated rows are reported alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import Numbered, kept, text_batches

SHINGLE = 5
RADIUS = 16
LEAST = 0.8
#: Bytes of item text that are sent to the tasks at once, about.
BLOCK_BYTES = 8 << 20
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes], first: bool = False) -> np.ndarray:
    """A 64-bit hash of each word in lower case without marks around it; 0 where nothing is left."""
    found = []
    for word in words:
        core = (word.decode("utf-8", "replace").lower().encode() if not word.isascii() else word.lower()).strip(MARKS)
        found.append(xxhash.xxh64_intdigest(core) | 1 if core else 0)
    return np.array(found, np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums over `hashes` of each bit as +1 or -1, starting with zeros."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two multisets."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(place[: len(a)], minlength=len(values))
    right = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


def within_radius(windows: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (window, item) pairs of fingerprints within `radius` bits, by radius + 1 blocks."""
    bounds = np.linspace(0, 64, radius + 2).astype(int)
    found = []
    for low, high in zip(bounds, bounds[1:]):
        mask = np.uint64((1 << int(high - low)) - 1)
        asked, held = (x >> np.uint64(low) & mask for x in (windows, items))
        order = np.argsort(held, kind="stable")
        first = np.searchsorted(held[order], asked, "left")
        counts = np.searchsorted(held[order], asked, "right") - first
        w = np.repeat(np.arange(len(windows)), counts)
        i = order[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        near = np.bitwise_count(windows[w] ^ items[i]) <= radius
        found.append(w[near] * len(items) + i[near])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(items)), pairs % max(1, len(items))


class Items:
    """A block of benchmark items, by number of words."""

    def __init__(self, rows: list[tuple[object, bytes]], shingle: int, radius: int, least: float):
        self.radius, self.least = radius, least
        by_length = defaultdict(list)
        for item, text in rows:
            hashes = word_hashes(text.split())
            hashes = hashes[hashes > 0]
            if len(hashes):
                by_length[len(hashes)].append((item, shingles(hashes, min(shingle, len(hashes)))))
        self.groups = []
        for n, items in sorted(by_length.items()):
            own = [s for _, s in items]
            marks = np.concatenate([prints(bit_sums(s)[-1:]) for s in own])
            self.groups.append((n, min(shingle, n), [i for i, _ in items], own, marks, np.unique(np.concatenate(own))))
        self.known = {
            size: np.unique(np.concatenate([g[5] for g in self.groups if g[1] == size])) for size in {g[1] for g in self.groups}
        }

    def matches(self, hashes: np.ndarray) -> list[tuple[object, int, int, float]]:
        """(item, first word, last word, similarity) of the items found in a document's words."""
        out = []
        for size, known in self.known.items():
            own = shingles(hashes, size)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            if not (known[place] == own).any():
                continue
            sums = None
            for n, k, items, theirs, marks, group_known in self.groups:
                m = n - k + 1
                enough = math.ceil(self.least * m - 1e-9)
                if k != size or len(own) < enough:
                    continue
                m = min(m, len(own))
                place = np.minimum(np.searchsorted(group_known, own), len(group_known) - 1)
                held = np.concatenate([[0], np.cumsum(group_known[place] == own)])
                starts = np.flatnonzero(held[m:] - held[:-m] >= enough)
                if not len(starts):
                    continue
                sums = bit_sums(own) if sums is None else sums
                w, i = within_radius(prints(sums[starts + m] - sums[starts]), marks, self.radius)
                best: dict[int, tuple[float, int]] = {}
                for start, item in zip(starts[w].tolist(), i.tolist()):
                    like = weighted_similarity(own[start : start + m], theirs[item])
                    if like >= self.least and like > best.get(item, (0.0, 0))[0]:
                        best[item] = (like, start)
                out += [(items[item], start, start + m + k - 2, like) for item, (like, start) in best.items()]
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about `block_bytes`, by a hash of their id; blocks without items are left out."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        found = [(r.id, r.text.encode()) for r in part.collect() if r.text]
        if found:
            yield found


def _hashed(texts: list[bytes], words: Numbered) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the hashes of its words and their places among all white-space separated words."""
    split = [t.split() for t in texts]
    hashes = words.values[at] if len(at := words.of([w for s in split for w in s])) else np.zeros(0, np.uint64)
    end = 0
    for s in split:
        own = hashes[end : end + len(s)]
        end += len(s)
        place = np.flatnonzero(own)
        yield own[place], place


def leaks(
    docs: DataFrame,
    items: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first_word, last_word, similarity.

    Words are numbered from 0 among the text's white-space separated ones.
    """
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, first_word int, last_word int, similarity double"
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for rows in _blocks(items, item_col, item_text_col, block_bytes):
        shared, mark = docs.sparkSession.sparkContext.broadcast(Items(rows, shingle, radius, least)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, mark=mark) -> Iterator[pa.RecordBatch]:
            found, words = shared.value, kept(mark, lambda: Numbered(word_hashes))
            for batch, texts in text_batches(batches):
                rows = []
                for doc, (hashes, place) in zip(batch.column("doc_id").to_pylist(), _hashed(texts, words)):
                    rows += [(doc, i, int(place[a]), int(place[b]), like) for i, a, b, like in found.matches(hashes)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "first_word", "last_word", "similarity"), r)) for r in rows],
                    arrow)

        arrow = pa.schema([
            ("doc_id", pa.int64()), ("item_id", _arrow_type(kind)), ("first_word", pa.int32()), ("last_word", pa.int32()), ("similarity", pa.float64())])
        part = wanted.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    least: float = LEAST,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item."""
    at = docs.columns.index(text_col)
    for rows in _blocks(items, item_col, item_text_col, block_bytes):
        shared, mark = docs.sparkSession.sparkContext.broadcast(Items(rows, shingle, radius, least)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, mark=mark) -> Iterator[pa.RecordBatch]:
            found, words = shared.value, kept(mark, lambda: Numbered(word_hashes))
            for batch, texts in text_batches(batches, at):
                clean = [not found.matches(hashes) for hashes, _ in _hashed(texts, words)]
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

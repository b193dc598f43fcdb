"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint of `bits` bits (a multiple of 64) is cut into segments. Every fingerprint is entered in
a table under each of its segments; every fingerprint looks up, for each segment, the keys of a small
Hamming ball around its own segment, and the matches are verified on their complete distance. With
`segments` segments and a ball of radius `ball`, no pair within `segments * (ball + 1) - 1` bits is
missed. Equal fingerprints are collapsed first, so copies cost nothing in the search; a fingerprint has
a bounded number of distinct others within a small radius, however many documents hold them.

Edge cases: null counts as empty; a text with fewer words than a shingle is one shingle; a text
without words has fingerprint zero and is linked like any other; ids are unique by contract, a repeated
row shares its fingerprint and so its component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import components, kept, stored, text_batches

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `size` words joined by a space; of all of them where they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where more than half of `hashes` have them set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        octets = hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes, made from `hashes`."""
    out = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return out ^ out >> np.uint64(31)


def fingerprints(
    docs: DataFrame, shingle: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False
) -> DataFrame:
    """(doc_id, fingerprint): one row per document, the fingerprint an array of 64-bit longs.

    The first 64 bits come from the shingles' hashes, further ones from these hashes mixed anew. A
    repeated shingle counts each time or, if `distinct`, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("fingerprints", lambda: None)  # frees what an earlier job left in this worker
        for batch, texts in text_batches(batches):
            prints = []
            for text in texts:
                words = words_of(text)
                hashes = shingle_hashes(words, shingle)
                hashes = np.unique(hashes) if distinct else hashes
                parts = [majority(hashes if k == 0 else mixed(hashes, k)) for k in range(bits // 64)]
                prints.append([p - (1 << 64) if p >> 63 else p for p in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, fingerprint array<long>")


def distance(a: str, b: str, bits: int) -> Column:
    """Differing bits of two fingerprint columns."""
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(bits // 64))


def ball_masks(width: int, radius: int) -> list[int]:
    """All numbers of `width` bits with at most `radius` of them set."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(width), r)]


def links(prints: DataFrame, radius: int, segments: int, ball: int, bits: int = 64, first: int = 64) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within `radius` bits, smaller node first.

    `prints`: (node, fingerprint), the fingerprints distinct. Complete where `radius` is less than
    `segments * (ball + 1)`; beyond that, pairs are found that have a segment within the ball. The
    search carries the first 64 bits, which must be within `first` bits; longer fingerprints are
    fetched for the pairs that are, and compared as a whole.
    """
    width, rest = divmod(bits, segments)
    if rest or 64 % width:
        raise ValueError(f"{segments} equal segments of {bits} bits must each lie within one long")
    keys = []
    for s in range(segments):
        word, shift = divmod(s * width, 64)
        key = F.shiftrightunsigned(F.col("fingerprint")[word], shift)
        keys.append(F.struct(F.lit(s).alias("segment"), key.bitwiseAND(F.lit((1 << width) - 1)).alias("key")))
    entries = prints.select("node", F.col("fingerprint")[0].alias("print"), F.inline(F.array(*keys)))
    # The segment's number goes above its key, where they fit into one number.
    above = 1 << width if width <= 48 else 0
    at = [(F.col("segment").cast("long") * above + F.col("key")).alias("at")] if above else ["segment", "key"]
    names = ["at"] if above else ["segment", "key"]
    held = entries.select(*at, F.col("node").alias("b"), F.col("print").alias("print_b"))
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(width, ball)])
    asked = entries.withColumn("mask", F.explode(masks)).withColumn("key", F.col("key").bitwiseXOR(F.col("mask")))
    asked = asked.select(*at, F.col("node").alias("a"), F.col("print").alias("print_a"))
    apart = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b")))
    near = (F.col("a") < F.col("b")) & (apart <= min(first, radius))
    # Spark takes an exploded table to be as small as the table was before, and would broadcast all its rows.
    pairs = asked.hint("merge").join(held, names).where(near).select("a", "b").distinct()
    if bits == 64:
        return pairs
    whole = [prints.select(F.col("node").alias(c), F.col("fingerprint").alias(f"print_{c}")) for c in "ab"]
    return pairs.join(whole[0], "a").join(whole[1], "b").where(distance("print_a", "print_b", bits) <= radius).select("a", "b")


def near_groups(
    docs: DataFrame,
    shingle: int = 3,
    bits: int = 64,
    radius: int = 2,
    segments: int = 2,
    ball: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex), component_id."""
    prints = stored(fingerprints(docs, shingle, bits, id_col, text_col), "fingerprints")
    nodes = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    found = components(links(nodes, radius, segments, ball, bits))
    labelled = nodes.join(found, "node", "left")
    labelled = labelled.select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    text = F.concat(*[F.lpad(F.lower(F.hex(F.col("fingerprint")[k])), 16, "0") for k in range(bits // 64)])
    return prints.join(labelled, "fingerprint", "left").select(
        "doc_id", text.alias("fingerprint"), "component_id")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The `pairs` (a, b) whose texts' shingle sets have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}  # a text of many pairs is cut once

        def shingles(text: bytes) -> np.ndarray:
            if text not in held:
                if len(held) > 200:
                    held.clear()
                held[text] = np.unique(shingle_hashes(words_of(text), shingle))
            return held[text]

        for batch in batches:
            likes = []
            for x, y in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))):
                sets = [shingles(t or b"") for t in (x, y)]
                both = len(np.intersect1d(*sets, assume_unique=True))
                whole = len(sets[0]) + len(sets[1]) - both
                likes.append(both >= least * whole)  # two texts without words are alike
            yield batch.select(["a", "b"]).filter(pa.array(likes, pa.bool_()))

    a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_links(
    docs: DataFrame,
    shingle: int = 5,
    least: float = 0.8,
    bits: int = 192,
    radius: int = 45,
    segments: int = 12,
    ball: int = 1,
    first: int = 18,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Links (a, b) between ids whose texts' sets of `shingle`-word runs are alike by `least` or more.

    Fingerprints are those of the sets: a repeated run counts once. Candidates are fingerprints within
    `radius` bits that agree in a segment up to `ball` bits, and ids with equal fingerprints, each with
    the first of them; all are verified on their texts. Those that are not alike the first are compared
    with the first of themselves, and so on, so every id is alike a first one of its fingerprint; where
    the first ones of two fingerprints are not alike, all ids of both are compared. Two
    texts at a similarity of exactly 0.8 differ in 29 of 192 bits on average. Every pair within
    `segments * (ball + 1) - 1` bits is a candidate (23 here), and of those further apart most: 98 in
    100 at 29 bits. A fingerprint meets `segments * (width + 1) * n / 2 ** width` others of n by
    chance, so beyond some tens of millions of texts take wider segments of longer fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    prints = stored(fingerprints(rows, shingle, bits, distinct=True).distinct(), "fingerprints")

    def alike(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = rows.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return stored(verified(pairs, stored(texts, "candidate-texts"), shingle, least), "alike")

    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "nodes")
    found = members = None
    firsts, left = nodes, prints
    while True:
        equal = left.join(firsts, "fingerprint").where("doc_id > node")
        equal = stored(equal.select("fingerprint", F.col("node").alias("a"), F.col("doc_id").alias("b")), "equal")
        if not equal.head(1):
            break
        good = alike(equal.select("a", "b"))
        found = good if found is None else found.union(good)
        members = equal if members is None else members.union(equal)
        left = equal.join(good, ["a", "b"], "left_anti").select(F.col("b").alias("doc_id"), "fingerprint")
        firsts = left.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
        nodes = nodes.union(firsts)
    pairs = stored(links(nodes, radius, segments, ball, bits, first), "candidates")
    good = alike(pairs)
    if members is None:
        return good
    # All ids of two fingerprints whose first ones are not alike.
    of = members.join(found, ["a", "b"], "left_semi").select(F.col("a").alias("node"), F.col("b").alias("doc_id"))
    of = of.union(nodes.select("node", F.col("node").alias("doc_id")))
    more = pairs.join(good, ["a", "b"], "left_anti")
    for side in "ab":
        more = more.join(of.select(F.col("node").alias(side), F.col("doc_id").alias(f"{side}_own")), side)
    more = more.where("a <> a_own or b <> b_own").select(F.least("a_own", "b_own").alias("a"), F.greatest("a_own", "b_own").alias("b"))
    return found.union(good).union(alike(stored(more.distinct(), "further")))

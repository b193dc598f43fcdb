"""Documents as token sequences of a fixed length, filled by bounded-space online best fit.

Tokens come from a public tokenizer file; ids of a white-space separated chunk are computed once per
worker and reused, since the tokenizer never looks across white space. Packing looks at lengths only:
every task packs its own pieces, holding `open_bins` bins at most in a bitset keyed by free space.
The next piece goes to the open bin with the least room that still fits; where none does and the
limit is reached, the fullest bin closes first. Pieces reach a task in the order of a hash, so that at any time
its open bins meet pieces of all lengths; sorted by length, long pieces would close the bins before short
ones could fill them. The number of tasks follows from the size of the texts alone, not from the session.

Edge cases: null and empty texts have the end token alone; a text longer than a sequence is cut, its
last piece may be shorter; rows repeated with the same id are packed once each; an empty table gives
an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import Numbered, kept, stored, text_batches

SEQUENCE = 4096
END = 1
#: Least number of sequences for which a task of its own is made.
SEQUENCES_A_TASK = 4096
#: Bins a task holds open at once.
OPEN_BINS = 1024
#: Marks around a word that end it for the tokenizer; the apostrophe can be a part of it.
AROUND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Words of Latin letters, and the marks before and after them.
PARTS = (
    "^(?P<before>[{0}]*)(?P<word>[a-z\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]+)(?P<after>[{0}]*)$"
).format("".join("\\" + c for c in AROUND))
LATIN = re.compile("[a-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+")
#: Words that are tokenized as one text.
TOGETHER = 1024


def parts_of(chunks: pa.Array) -> list[pa.Array]:
    """For each chunk the marks before a word, the word and the marks after it, or else the chunk between two empty texts."""
    found = pa.compute.extract_regex(chunks, pattern=PARTS)
    before, word, after = (pa.compute.struct_field(found, name) for name in ("before", "word", "after"))
    return [pa.compute.fill_null(before, ""), pa.compute.coalesce(word, chunks), pa.compute.fill_null(after, "")]


class ChunkTokens:
    """Token ids of texts; `path` names a tokenizer file that drops white space between chunks.

    A chunk that is a word of Latin letters between punctuation is tokenized in these parts, which the
    tokenizer separates too; the same word in other surroundings or in capitals is then known already. Arrow splits a
    batch into chunks and numbers the different ones, so only these are looked up. Unknown words are tokenized many
    at a time, as one text: where the tokenizer marks the end of a word, the marks part their ids. What a worker keeps
    are the ids of at most `most` parts, of `most_bytes` together.
    """

    def __init__(self, path: str, most: int = 300_000, most_bytes: int = 1 << 23):
        # Tasks are spread by Spark; threads of the tokenizer's own would contend for the same cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.known = Numbered(self._extend, most, most_bytes)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _extend(self, parts: list[bytes], first: bool) -> np.ndarray:
        """Appends the parts' ids to the flat store; (start, length) of each."""
        if first:
            self.used = 0
        texts = [p.decode("utf-8", "replace") for p in parts]
        word = np.fromiter((LATIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        lengths, starts = np.zeros((2, len(texts)), np.int64)
        found = []
        for kind, encode in ((word, self._words), (~word, self._each)):
            new, lengths[kind] = encode([texts[k] for k in np.flatnonzero(kind).tolist()])
            starts[kind] = self.used + sum(map(len, found)) + np.cumsum(lengths[kind]) - lengths[kind]
            found.append(new)
        new = np.concatenate(found)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(new), self.used), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        return np.stack([starts, lengths], 1)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters. Every word has an end or more, so as many ends as words part them rightly."""
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for group, text in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(text.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            alike = len(ends) == len(group) and ends[-1] == len(ids)
            found.append((ids, np.diff(ends, prepend=0)) if alike else self._each(group))
        return tuple(np.concatenate(x) for x in zip(*found))

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        # The tokenizer lower-cases too; done first, fewer chunks differ.
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
        chunks = split.flatten().dictionary_encode()
        parts = pa.concat_arrays([x.cast(pa.string()) for x in parts_of(chunks.dictionary)]).dictionary_encode()
        rows = self.known.of(parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        if not len(rows):
            return [np.zeros(0, np.uint32)] * len(texts)
        three = rows[parts.indices.to_numpy()].reshape(3, -1).T.ravel()
        starts, lengths = self.known.values[three].T
        ids, ends = _laid_out(self.flat, starts, lengths)
        # The ids of each different chunk, then of every chunk.
        lengths = lengths.reshape(-1, 3).sum(1)
        at = chunks.indices.to_numpy()
        ids, ends = _laid_out(ids, (np.cumsum(lengths) - lengths)[at], lengths[at])
        of_text = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of_text)])]
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def _laid_out(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `flat` one after another, and where each ends."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def tokenized(
    docs: DataFrame,
    tokenizer_path: str,
    sequence: int = SEQUENCE,
    end: int = END,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, unless `keep_ids` is off, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    mark = f"tokens {tokenizer_path} {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(mark, lambda: ChunkTokens(tokenizer_path))
        for batch, _ in text_batches(batches, most=1 << 20):
            out = defaultdict(list)
            texts = batch.column("text").fill_null("")
            for doc, found in zip(batch.column("doc_id").to_pylist(), tokens.of(texts)):
                ids = np.append(found, np.uint32(end)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), sequence)):
                    part = ids[start : start + sequence]
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        out["ids"].append(part)
            arrays = [
                pa.array(out["doc_id"], pa.int64()),
                pa.array(out["piece"], pa.int32()),
                pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int64()),
                pa.array(out["ids_crc32"], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                ends = np.cumsum([0, *out["length"]]).astype(np.int32)
                flat = np.concatenate([*out["ids"], np.zeros(0, np.uint32)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, schema)


class BestFit:
    """Bounded-space best fit over lengths up to `capacity`: the open bins are in `free`, a bitset by room."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.held = self.count = 0

    def _take(self, room: int) -> int:
        at = self.bins[room]
        number = at.pop()
        if not at:
            self.free &= ~(1 << room)
        self.held -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `length`."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.held >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            room, number = self.capacity, self.count
            self.count += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.held += 1
        return number, self.capacity - room


def tasks_for(docs: DataFrame, sequence: int = SEQUENCE, text_col: str = "text") -> int:
    """Tasks of `SEQUENCES_A_TASK` sequences or more each, if a token has four bytes at most on average."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, size // (4 * sequence * SEQUENCES_A_TASK))


def packed(pieces: DataFrame, tasks: int, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset.

    Each of `tasks` partitions fills its own sequences; at most one of them per task stays far from
    full, so keep a task's pieces to many sequences, as `tasks_for` does. Pieces with ids are written to the
    shared folder first; only their row numbers and lengths are packed, and meet them again in a join.
    """
    if "ids" not in pieces.columns:
        key = ["doc_id", "piece", "start", "ids_crc32"]
        return placed(pieces, key, tasks, sequence, open_bins)
    whole = pieces.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole"))
    whole = stored(whole, "pieces")
    places = placed(whole.select("row", "whole.length"), ["row"], tasks, sequence, open_bins).drop("length")
    return whole.join(places, "row").select("whole.*", "sequence_id", "offset")


def placed(pieces: DataFrame, key: list[str], tasks: int, sequence: int, open_bins: int) -> DataFrame:
    """`pieces` with their places, dealt to tasks and ordered by a hash of `key`."""
    dealt = pieces.repartition(tasks, *key).sortWithinPartitions(F.xxhash64(*key), *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing", lambda: None)  # frees the tokenizer's cache in this worker
        fit = BestFit(sequence, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [fit.place(n) for n in batch.column("length").to_pylist()]
            places = [pa.array([base + n for n, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")

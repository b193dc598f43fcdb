"""Language of mixed-language texts: script ranges, per-word scores, and Viterbi with a switching penalty.

A model holds, for each language, log-probabilities of hashed letter pairs and triples (word bounds
included) and the scripts its letters are written in. A word's script leaves the languages written in
it as candidates, its letters give each of them a score, and the best path over a text's words, where
changing the language costs `penalty`, labels the spans. The language of a document is the one that
labels most of its letters, the score their share.

Edge cases: null, empty and letterless texts are `und` with score 0; equal shares go to the first
language in alphabetical order; words of a script no language has count for none and lower the score, so
a text of nothing else has the first language with score 0; rows repeated are labelled alike; very long texts are taken whole; without any labelled row every text is `und`; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import kept, text_batches

#: First and last code point of scripts, as in Unicode's block chart.
SCRIPTS = {
    "latin": [(0x0041, 0x02AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "thai": [(0x0E00, 0x0E7F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS) + 1
BUCKETS = 1 << 16
UNKNOWN = "und"
#: A language is written in a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Labelled documents that a language's counts are made from, about.
SAMPLE = 4000
PENALTY = 8.0


@cache
def script_table() -> np.ndarray:
    """Script number of every code point, 0 for what is no letter."""
    table = np.full(0x110000, OTHER, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            table[low : high + 1] = number
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, table, 0).astype(np.uint8)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Letters:
    """Words and letter features of several texts laid end to end."""

    starts: np.ndarray  # first letter of each word, as a place in `codes`
    ends: np.ndarray  # place after its last letter
    words: np.ndarray  # number of words of each text
    offsets: np.ndarray  # place where each text begins
    scripts: np.ndarray  # script of each word's first letter
    at: np.ndarray  # places that have features: a word's letters and the place after it
    pairs: np.ndarray  # hashed features at these places
    triples: np.ndarray


def letters_of(texts: list[bytes]) -> Letters:
    decoded = [_lower(t.decode("utf-8", "replace")) for t in texts]
    codes = np.frombuffer("\n".join([*decoded, ""]).encode("utf-32-le", "replace"), np.uint32)
    script = script_table()[codes]
    letter = script > 0
    before = np.concatenate([[False], letter[:-1]])
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(before & ~letter)
    offsets = np.cumsum([0, *(len(t) + 1 for t in decoded)])
    words = np.diff(np.searchsorted(starts, offsets))
    at = np.flatnonzero(letter | before)
    here = np.where(letter, codes, 0).astype(np.uint64)
    one = np.concatenate([[0], here])[at].astype(np.uint64)
    two = np.where(one > 0, np.concatenate([[0, 0], here])[at], 0).astype(np.uint64)
    here = here[at]
    pairs = here * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)
    triples = (pairs ^ (two + np.uint64(1)) * np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15)
    pairs *= np.uint64(0xD6E8FEB86659FD93)
    top = np.uint64(48)
    return Letters(starts, ends, words, offsets, script[starts], at,
                   (pairs >> top).astype(np.int64), (triples >> top).astype(np.int64))


@dataclass
class Model:
    languages: list[str]
    pairs: np.ndarray  # (bucket, language) log-probabilities
    triples: np.ndarray
    written: np.ndarray  # (script, language): whether the language uses the script

    def word_scores(self, found: Letters) -> np.ndarray:
        """(word, language) scores; a language that doesn't use the word's script is out of reach."""
        if not len(found.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        each = self.pairs[found.pairs]
        each += self.triples[found.triples]
        scores = np.add.reduceat(each, np.searchsorted(found.at, found.starts), axis=0)
        can = self.written[found.scripts]
        neutral = ~can.any(1)
        scores[~can] = -1e6
        scores[neutral] = 0
        return scores


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; `counts` words belong to each text, whose paths are found side by side."""
    languages = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    back = np.zeros(scores.shape, np.int16)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts that have more than so many words
    own = np.arange(languages, dtype=np.int16)
    best = np.zeros((len(sizes), languages), np.float64)
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        if t == 0:
            best[:n] = scores[at]
            continue
        now = best[:n]
        top = now.argmax(1)
        moved = now[np.arange(n), top][:, None] - penalty
        stays = now >= moved
        back[at] = np.where(stays, own, top[:, None])
        best[:n] = np.where(stays, now, moved) + scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows of `docs`.

    The rows of each language are counted; about `sample` of them, chosen by a hash of the id, give
    the letter counts. Counts are summed by Spark; what reaches the driver is one row per language
    and bucket that occurs.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / sizes[lang])).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("languages", lambda: None)
        total: dict[str, list[np.ndarray]] = {}
        for batch, texts in text_batches(batches, most=1 << 20):
            langs = np.array(batch.column("lang").to_pylist())
            for lang in set(langs.tolist()):
                found = letters_of([texts[k] for k in np.flatnonzero(langs == lang)])
                sums = total.setdefault(lang, [np.zeros(n, np.int64) for n in (BUCKETS, BUCKETS, OTHER + 1)])
                sums[0] += np.bincount(found.pairs, minlength=BUCKETS)
                sums[1] += np.bincount(found.triples, minlength=BUCKETS)
                sums[2] += np.bincount(found.scripts, minlength=OTHER + 1)
        for lang, sums in total.items():
            for kind, values in enumerate(sums):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(at)), "kind": pa.array([kind] * len(at), pa.int32()),
                    "bucket": pa.array(at, pa.int32()), "n": pa.array(values[at], pa.int64())})

    counted = chosen.mapInArrow(count, "lang string, kind int, bucket int, n long")
    summed = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    number = {lang: k for k, lang in enumerate(languages)}
    for kind, size in enumerate((BUCKETS, BUCKETS, OTHER + 1)):
        part = summed[summed["kind"] == kind]
        values = np.zeros((size, len(languages)))
        values[part["bucket"], part["lang"].map(number).astype(int)] = part["n"]
        tables.append(values)
    logs = [np.log((t + 0.1) / (t.sum(0) + 0.1 * BUCKETS)).astype(np.float32) for t in tables[:2]]
    written = tables[2] >= SCRIPT_SHARE * np.maximum(1, tables[2].sum(0))
    return Model(languages, *logs, written)


def labelled(model: Model, texts: list[bytes], penalty: float) -> tuple:
    """(language numbers, scores, shares, letters, text number and language number of each word).

    The number after the last language stands for an unknown one. Words of a script that no language is
    written in have no say; the score is the best language's share of all letters, the share that of all languages.
    """
    found = letters_of(texts)
    docs_of = np.repeat(np.arange(len(texts)), found.words)
    shares = np.zeros((len(texts), len(model.languages) + 1))
    labels = None
    if model.languages:
        labels = viterbi(model.word_scores(found), found.words, penalty)
        legible = model.written[found.scripts].any(1)
        np.add.at(shares, (docs_of, labels), np.where(legible, found.ends - found.starts, 0))
    total = np.bincount(docs_of, found.ends - found.starts, len(texts)) if model.languages else np.zeros(len(texts))
    best = np.where(total > 0, shares.argmax(1), len(model.languages))
    total = np.maximum(total, 1)
    return best, shares.max(1) / total, shares.sum(1) / total, found, docs_of, labels


def identified(
    docs: DataFrame,
    model: Model,
    penalty: float = PENALTY,
    spans: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score and, unless turned off, the labelled spans.

    A span is (begin, end, lang): code points of the text from a first word to the end of the last one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<begin:int,end:int,lang:string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("languages", lambda: None)  # frees what an earlier job left in this worker
        model = shared.value
        names = np.array([*model.languages, UNKNOWN])
        for batch, texts in text_batches(batches, most=1 << 20):
            best, score, _, found, docs_of, labels = labelled(model, texts, penalty)
            out = [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if spans:
                out.append(_spans(found, docs_of, labels, names, len(texts)))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, schema)


def _spans(found: Letters, docs_of: np.ndarray, labels: np.ndarray | None, names: np.ndarray, texts: int) -> pa.Array:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    out: list[list[dict]] = [[] for _ in range(texts)]
    if labels is not None and len(labels):
        new = np.concatenate([[True], (labels[1:] != labels[:-1]) | (docs_of[1:] != docs_of[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(labels)]]) - 1
        for a, b in zip(first.tolist(), last.tolist()):
            doc = int(docs_of[a])
            base = int(found.offsets[doc])
            out[doc].append({"begin": int(found.starts[a]) - base, "end": int(found.ends[b]) - base, "lang": str(names[labels[a]])})
    return pa.array(out, kind)


def in_known_languages(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = PENALTY, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which known languages, one or several, label at least the share `least` of the letters."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("languages", lambda: None)
        for batch, texts in text_batches(batches, at, most=1 << 20):
            best, _, share, *_ = labelled(shared.value, texts, penalty)
            yield batch.filter(pa.array((best < len(shared.value.languages)) & (share >= least)))

    return docs.mapInArrow(run, docs.schema)

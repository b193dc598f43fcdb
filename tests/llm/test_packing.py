"""Packing: tokens equal the plain tokenizer's, places are gapless, sequences are nearly as few as can be."""

import random
import zlib
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barscreen.llm import packing
from barscreen.llm.queries import op3_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, it's fine.", None, "", "  \n", "É́ ǅ naïve ́x a b\x1cc \x85d", "<|endoftext|> <|startoftext|>x",
    "y" * 5000 + " tail", "word " * 6000, "日本語 テスト 😀", "z" * 65 + " a " + "q" * 64, "a b 'S 'll",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, "no id")], "doc_id long, text string")


@cache
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def plain(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("sequence", [16, 4096])
def test_pieces_are_the_tokenizers(docs, sequence):
    rows = packing.tokenized(docs.where("doc_id > 0"), PATH, sequence).collect()
    for doc, text in enumerate(TEXTS):
        if not doc:
            continue
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        ids = plain(text)
        assert [i for r in own for i in r.ids] == ids
        assert all(r.length == len(r.ids) <= sequence and r.start == r.piece * sequence for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert [r.piece for r in own] == list(range(len(own)))


def test_parts_of_words_are_the_tokenizers_too():
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 300").fetchall()]
    texts += ["(Don't) 'said ''s x's' THE!! İstanbul ΣΑΣ straße, ÀÉ... a-b c.d -x- 'tis e\u0301. n\u0303a", "$$ ... 3rd 4,5 #tag"]
    tokens = packing.ChunkTokens(PATH, most=500)
    got = [ids for k in range(0, len(texts), 7) for ids in tokens.of(pa.array(texts[k : k + 7]))]
    assert [[*ids, 1] for ids in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("odd", ["", "İstanbul", "İ İ xİx"])
def test_words_tokenized_together_are_parted(odd, monkeypatch):
    """Unknown words go to the tokenizer as one text; a word that it parts itself is not counted as several."""
    words = [f"{a}{b}é{c}" for a in ("ba", "straß", "x") for b in ("ner", "tiö") for c in ("", "ly", "ss")] + odd.split()
    tokens = packing.ChunkTokens(PATH)
    sizes = []

    class Seen:
        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return tokenizer().encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokens, "tokenizer", Seen())
    got = tokens.of(pa.array([" ".join(words), *words, "İ"]))
    assert [[*ids, 1] for ids in got] == [plain(t) for t in (" ".join(words), *words, "İ")]
    monkeypatch.setattr(packing, "LATIN", packing.re.compile("[a-zé]+"))
    tokens.known = packing.Numbered(tokens._extend)
    sizes.clear()
    assert [[*ids, 1] for ids in tokens.of(pa.array(["one two", "three, one"]))] == [plain("one two"), plain("three, one")]
    assert 1 in sizes  # three words as one text


def test_places_are_gapless_and_few(docs):
    pieces = packing.tokenized(docs, PATH, 64).withColumn("sequence", F.lit("x")).withColumn("base", F.lit(1))
    rows = packing.packed(pieces, 2, 64).collect()
    assert len(rows) == pieces.count()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= sum(r.length for r in rows) / 64 + 2 + 1


@pytest.mark.parametrize("kind", ["texts", "even"])
def test_many_pieces_of_a_task_take_few_sequences(kind):
    rng = np.random.default_rng(7)
    if kind == "even":
        lengths = rng.integers(200, 3900, 100_000)
    else:
        whole = np.maximum(1, rng.lognormal(5.5, 1.6, 90_000)).astype(int)
        lengths = rng.permutation(np.concatenate([np.full(int((whole // 4096).sum()), 4096), whole % 4096 + 1]))
    fit = packing.BestFit(4097)
    for n in lengths.tolist():
        fit.place(n)
    assert fit.count <= 1.01 * lengths.sum() / 4097 + 1


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_sequences_do_not_depend_on_the_session(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = op3_best_fit_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_ties_and_repeated_rows_keep_their_places(spark):
    pieces = spark.createDataFrame([(i % 5, 0, 0, 20, 7) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(pieces, 1, 64).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
    assert len({r.sequence_id for r in rows}) == 17


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 5, 7, 4, 5)] == [(0, 0), (1, 0), (2, 0), (1, 5), (3, 0)]
    # 7 fits nowhere: of two open bins, 0 (room 4) closes; 4 goes to bin 1, which the last 5 closes
    assert fit.held <= 2


def test_best_fit_against_a_scan():
    draw = random.Random(5)
    fit, bins = packing.BestFit(50, open_bins=10**9), []
    for _ in range(3000):
        n = draw.randint(1, 50)
        fits = [room for room in bins if room >= n]
        if fits:
            bins.remove(min(fits))
        room = min(fits, default=50)
        bins.append(room - n)
        assert fit.place(n)[1] == 50 - room
    assert fit.count == len(bins)


def test_empty(docs):
    assert packing.packed(packing.tokenized(docs.limit(0), PATH), packing.tasks_for(docs.limit(0))).count() == 0

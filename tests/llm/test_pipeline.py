"""The stages in their order against plain definitions, and their behaviour on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barscreen.llm.common import table
from barscreen.llm.simhash import words_of
from tests.llm.test_decontaminate import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        out[name] = (before, [r.asDict() for r in docs.collect()])
    return out


def sets(text):
    words = words_of((text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_language_keeps_prose(stages):
    before, after = stages["language"]
    kept = {r["doc_id"] for r in after}
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in after)
    assert len(kept) >= 0.95 * len(before) and after[0].keys() == before[0].keys()


def test_exact_and_near(stages):
    before, after = stages["exact copies"]
    contents = {re.sub(r"[\x20\x09-\x0d]+", " ", r["text"]): None for r in before}
    assert len(after) == len(contents)
    before, after = stages["near copies"]
    shingles = {r["doc_id"]: sets(r["text"]) for r in before}
    kept = sorted(r["doc_id"] for r in after)
    assert all(like(shingles[a], shingles[b]) < 0.8 for a in kept for b in kept if a < b)
    for gone in set(shingles) - set(kept):
        assert max(like(shingles[gone], shingles[o]) for o in shingles if o != gone) >= 0.8


def test_leaks_and_sequences(spark, stages):
    before, after = stages["benchmark leaks"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    found = {d for d, _ in brute([(r["doc_id"], r["text"]) for r in before], items)}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - found
    before, after = stages["sequences"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert all(r["length"] == len(r["ids"]) for r in after)


def test_run_gives_the_last_stage(spark, stages):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["sequences"][1]}


def test_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen " * 4
    rows = [(1, None, "en"), (2, "", "en"), (3, "?!", None), (4, base, "en"), (4, base, "en"), (5, base, None),
            (None, base, "en"), (6, base + "fourteen", "en"), (7, "z " * 100_000, "en"), (8, "un deux trois " * 9, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_sha", F.lit(1)).withColumn("a", F.lit("b")).withColumn("_gone", F.lit(0))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    left = [r.doc_id for r in docs.collect()]
    assert sorted(left) == [4, 7, 8]
    assert corpus_pipeline.sequences(spark, docs, SF).count() >= 3


def test_near_copies_without_an_id_go(spark):
    """Near copies leave one document, be it one with an id or not; texts of one id are compared each."""
    draw = random.Random(3)
    base, other, third = ([f"x{draw.getrandbits(40)}" for _ in range(80)] for _ in range(3))
    rows = [(None, " ".join(base)), (7, " ".join([*base, "y"])), (None, " ".join([*base, "z"])),
            (None, " ".join(other)), (None, " ".join([*other, "y"])), (None, None),
            (9, " ".join(third)), (9, " ".join(third[::-1])), (8, " ".join([*third, "y"])), (None, " ".join([*third[::-1], "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [7, 8]
    texts = [r.text for r in left if r.doc_id is None]
    assert len(texts) == 2 and None in texts and any(t and t.startswith(other[0]) for t in texts)

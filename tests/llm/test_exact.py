"""Exact duplicates against a dictionary of contents, on the cases the docstring lists."""

import re

import pytest
from pyspark.sql import functions as F

from barscreen.llm import exact

TEXTS = ["a b", "a\t b", None, "", "  ", " ", "x" * 200_000, "a b", "é b", "a b", "x" * 200_000 + "y"]


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(doc)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.fixture
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (None, "only"), (7, "a b")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.length(c).cast("string")])
def test_groups(docs, digest):
    got = exact.exact_groups(docs, salts=2, digest=digest).drop("text_sha256").collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted([tuple(r) for r in got], key=str) == want


def test_drop_keeps_one_of_each_and_all_columns(spark, docs):
    wide = docs.withColumn("_sha", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("digest", F.lit(None).cast("int"))
    out = exact.drop_exact(wide)
    assert out.columns == wide.columns
    got = out.collect()
    contents = [re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "") for r in got]
    assert len(contents) == len(set(contents)) == 8
    assert {r.doc_id for r in got} == {0, 2, 4, 6, 8, 9, 10, None}


def test_empty(docs):
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert exact.drop_exact(docs.limit(0)).count() == 0


def test_main_path_has_no_python(docs):
    plan = exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

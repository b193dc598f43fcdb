"""Language identification: Viterbi against all paths, spans of mixed texts, held-out accuracy."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscreen.llm import langid
from barscreen.llm.common import remainder, table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    more = spark.createDataFrame([(-k, "привет мир как дела сегодня " * 5, "ru") for k in range(1, 6)], "doc_id long, text string, lang string")
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").union(more)
    return langid.learn(docs.where(remainder("doc_id", 4) != 2))


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(4)
    for _ in range(30):
        counts = draw.integers(0, 6, 7)
        scores = draw.normal(size=(counts.sum(), 3))
        labels, at = langid.viterbi(scores, counts, 0.8), 0
        for n in counts:
            part = scores[at : at + n]

            def value(path):
                return sum(part[k, p] for k, p in enumerate(path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:]))

            assert value(labels[at : at + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))
            at += n


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 1000


def test_odd_texts_and_spans(spark, model):
    en = "the reation of the thing and that was for the inering of this "
    fr = "les queaux de la tionment pour avec une éreeau que des mentaux "
    rows = [(0, None), (1, ""), (2, "123 !? |"), (3, en * 3 + fr * 3), (4, en), (5, "привет как дела"), (5, "привет как дела"),
            (6, "日本"), (None, en), (7, en * 3000), (8, "İ " + en)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(0)).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    assert [(got[k].lang_pred, got[k].score, got[k].spans) for k in (0, 1, 2)] == [("und", 0.0, [])] * 3
    assert got[4].lang_pred == got[7].lang_pred == got[None].lang_pred == got[8].lang_pred == "en"
    assert got[5].lang_pred == "ru"
    assert (got[6].lang_pred, got[6].score) == (model.languages[0], 0.0)
    assert [s.lang for s in got[3].spans] == ["en", "fr"]
    assert abs(got[3].spans[1].begin - len(en) * 3) <= 8
    assert got[3].spans[1].end == len((en * 3 + fr * 3).rstrip())


def test_unknown_scripts_go_and_mixtures_stay(spark, model):
    en = "the reation of the thing and that was for the inering of this "
    fr = "les queaux de la tionment pour avec une éreeau que des mentaux "
    ru = "привет мир как дела сегодня "
    rows = [(1, "日本語のテキストです。"), (2, "שלום עולם"), (3, en + "中文字" * 5), (4, en * 2 + fr * 2 + ru * 4), (5, "中文字" * 99 + en), (6, "12"), (7, en), (7, en)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    kept = langid.in_known_languages(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 7]
    scores = {r.doc_id: r.score for r in langid.identified(docs, model, spans=False).collect()}
    assert scores[1] == scores[2] == 0 and 0 < scores[5] < 0.3 and scores[4] < 0.5 < scores[3] < 1 == scores[7]


def test_no_labels(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty = langid.learn(none)
    assert langid.identified(none, model).count() == 0
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identified(docs, empty).collect()] == [(1, "und", 0.0, [])]

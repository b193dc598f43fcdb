"""Surrogates: form, distinctness, coreference, and texts left alone."""

import re

import pytest
from pyspark.sql import functions as F

from barscreen.llm import pii
from barscreen.llm.common import table
from barscreen.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "Mr. John Smith met Mr. Smith, Mrs. JANE Smith; call +1 (017) 555-7713 or +10175557713"),
    (2, "Herr Müller und Господин Иван Петров, 4111 1111 1111 1111 / 4111111111111111 123-45-6789"),
    (3, None), (4, ""), (5, "a@b.com A@B.com x@b.com 1.2.3.4 1.2.3.4.5 2024-01-05 12:30"),
    (6, "nothing here"), (6, "nothing here"), (None, "a@b.com"), (7, "a@b.com"), (7, "a@b.com"),
    (8, "x@b.com " * 3000 + "é ü 日本"), (9, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
]


@pytest.fixture(scope="module")
def got(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("mentions", "digest", "kind"):
        docs = docs.withColumn(name, F.lit(7))
    return pii.pseudonymised(docs, "k").collect()


def of(got, doc):
    return next(r for r in got if r.doc_id == doc)


def test_names_keep_gender_script_capitals_and_reference(got):
    m = re.fullmatch(r"Mr\. (\w+n) (\w+r) met Mr\. (\w+r), Mrs\. ([A-Z]+A) (\w+r); call (\S+ \S+ \S+) or (\S+)", of(got, 1).text)
    assert m[2] == m[3] == m[5] and m[2] != "Smith"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", m[6])
    assert re.sub(r"\D", "", m[6]) == re.sub(r"\D", "", m[7]) != "10175557713"
    assert re.search(r"Господин [А-Я][а-я]+н [А-Я][а-я]+р,", of(got, 2).text)


def test_cards_keep_layout_and_check_digit(got):
    spaced, plain = re.search(r"(\d{4} \d{4} \d{4} \d{4}) / (\d{16}) \d{3}-\d\d-\d{4}$", of(got, 2).text).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111"
    digits = [int(c) for c in plain][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_left_alone(got):
    texts = dict(ROWS)
    assert len(got) == len(ROWS)
    assert all(r.text == texts[r.doc_id] and r.n_mentions == 0 for r in got if r.doc_id in (3, 4, 6))
    a, b, c, ip, *rest = of(got, 5).text.split()
    assert a == b != c and "@" in a and a.split("@")[1] == c.split("@")[1] and re.fullmatch(r"10(\.\d+){3}", ip)
    assert rest == ["1.2.3.4.5", "2024-01-05", "12:30"]
    assert of(got, None).text == of(got, 7).text == a
    assert of(got, 8).text == f"{c} " * 3000 + "é ü 日本"
    assert re.fullmatch(r'token = "(?!04dbe)[0-9a-f]{40}"', of(got, 9).text)


def test_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("surname", f"name{k}") for k in range(3000)], "kind string, canon string")
    rows = pii.surrogates(entities, "k").collect()
    assert len({r.surrogate for r in rows}) == 3000 == len({r.canon for r in rows})
    assert any(len(r.surrogate) > 7 for r in rows)  # three syllables did not suffice for all


def test_given_table(spark):
    before = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op2_pii_surrogates"](spark, SF).collect()
    assert len(rows) == len(before)
    secret = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\b\d{16}\b|\b[0-9a-f]{40}\b|\+\d+ \(\d+\) \d+-\d+")
    for r in rows:
        found = secret.findall(before[r.doc_id])
        assert not any(m in r.text for m in found)
        if not found and not re.search(r"\d", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_native_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = pii.pseudonymised(docs, "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymised(docs.limit(0), "k").count() == 0

"""Fingerprints, links and components against all pairs on small tables."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from barscreen.llm import simhash
from barscreen.llm.common import components

VOCAB = [f"w{i}" for i in range(300)]


def texts(seed=3, n=120):
    draw = random.Random(seed)
    bases = [[draw.choice(VOCAB) for _ in range(draw.randint(1, 60))] for _ in range(n // 4)]
    out = [None, "", " \t", "One", "one", "two WORDS", "É x y z", "long " * 3000]
    while len(out) < n:
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(VOCAB)
        out.append(" ".join(words))
    return out


def brute_print(text, size=3):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = data.split()
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def test_query_form_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    label = brute_components(prints, 2)
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i, _ in rows}
    assert len(set(label.values())) < len(rows)


@pytest.mark.parametrize("segments, ball, radius", [(2, 1, 2), (4, 1, 7), (2, 0, 1), (2, 2, 5)])
def test_links_lose_nothing_within_the_guarantee(spark, segments, ball, radius):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 5))) for b in base for _ in range(25)})
    rows = [(i, [v - (1 << 64) if v >> 63 else v]) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "node long, fingerprint array<long>")
    got = {tuple(r) for r in simhash.links(prints, radius, segments, ball).collect()}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if (values[i] ^ values[j]).bit_count() <= radius}
    assert got == want and want


def test_links_broadcast_no_exploded_table(spark):
    """Spark knows how large this table is, but not that each of its rows becomes 66."""
    prints = spark.range(1000).select(F.col("id").alias("node"), F.array(F.xxhash64("id")).alias("fingerprint"))
    found = simhash.links(prints, radius=2, segments=2, ball=1)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(pairs)
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100} | {k: 100 for k in range(101, 160)} | {k: 200 for k in (200, 201, 202)}


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(odd).collect()} == {(None, 4), (4, 4)}


def test_near_links_count_repeats_once(spark):
    draw = random.Random(4)
    line = " ".join(f"l{k}" for k in range(24))
    rows = []
    for k in range(12):
        own = " ".join(f"x{draw.getrandbits(40)}" for _ in range(200))
        rows += [(2 * k, f"{own} " + f"{line} " * 2), (2 * k + 1, f"{own} " + f"{line} " * 20)]
    got = {tuple(r) for r in simhash.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(12)}


def test_near_links_behind_a_first_one_that_is_not_alike(spark):
    """Every fingerprint stands for four texts: three copies of two kinds, and one of a third kind."""
    draw = random.Random(6)
    words = lambda n: [f"x{draw.getrandbits(40)}" for _ in range(n)]
    first, other, third = words(60), words(60), words(60)
    near = [*other, *words(2)]
    texts = dict(enumerate([first, other, near, third, [*first, *words(1)], [*third, *words(2)]]))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    plain = simhash.fingerprints
    try:
        same = F.array(*[F.lit(0).cast("long")] * 3)
        far = F.array(F.lit(1).cast("long"), *[F.lit(0).cast("long")] * 2)
        simhash.fingerprints = lambda *a, **b: plain(*a, **b).withColumn("fingerprint", F.when(F.col("doc_id") == 5, far).otherwise(same))
        got = {tuple(r) for r in simhash.near_links(docs).collect()}
    finally:
        simhash.fingerprints = plain
    assert got == {(0, 4), (1, 2), (3, 5)}

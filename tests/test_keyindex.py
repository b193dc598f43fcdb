"""The index of seen keys against a plain set, over many batches, repeats, refinements and a lost index."""

import os
import random

from barscreen.sources import keyindex
from barscreen.sources.storage import committed_versions, delete_path, version_path

KEY = ["link", "title"]
SCHEMA = "link string, title string"


def land(spark, rows, table, index, batch, **options):
    polled = spark.createDataFrame(rows, SCHEMA).distinct()
    new = keyindex.unseen(polled, KEY, table, index, batch, **options)
    new.coalesce(1).write.mode("overwrite").parquet(version_path(table, batch))
    return sorted(tuple(r) for r in spark.read.parquet(version_path(table, batch)).collect())


def manifest(spark, index, before):
    return keyindex._manifest(spark, index, before)


def test_every_key_is_new_once(spark, tmp_path):
    table, index = f"{tmp_path}/table", f"{tmp_path}/table/_keys"
    draw, seen, options = random.Random(5), set(), {"merge_every": 3, "bucket_keys": 4}
    for batch in range(11):
        rows = [(f"l{draw.randrange(120)}", draw.choice(["a", ""])) for _ in range(0 if batch == 4 else 30)]
        want = sorted(set(rows) - seen)
        assert land(spark, rows, table, index, batch, **options) == want
        # A batch that is done again, as after a crash, gives the same.
        if batch in (6, 7):
            assert land(spark, rows, table, index, batch, **options) == want
        seen |= set(rows)
    merged, bits, held = manifest(spark, index, 11)
    assert merged == 8 and bits > keyindex.FIRST_BITS and held.agg({"n_keys": "sum"}).first()[0] <= len(seen)
    assert max(r.n_keys for r in held.collect()) <= 4 * options["bucket_keys"]
    # Nothing but the last two merges is kept, and the table itself is read without the index.
    assert len(committed_versions(spark, f"{index}/manifest")) == 2
    assert spark.read.parquet(table).count() == len(seen)

    delete_path(spark, index)
    assert land(spark, sorted(seen)[:20] + [("new", "")], table, index, 11, **options) == [("new", "")]
    assert manifest(spark, index, 11)[0] == 10


def test_a_merge_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    table, index = f"{tmp_path}/table", f"{tmp_path}/keys"
    land(spark, [(f"l{i}", "a") for i in range(200)], table, index, 0, merge_every=1)
    land(spark, [("x", "a")], table, index, 1, merge_every=1)
    before = {r.bucket: r.version for r in manifest(spark, index, 1)[2].collect()}
    land(spark, [("y", "a")], table, index, 2, merge_every=1)
    after = {r.bucket: r.version for r in manifest(spark, index, 2)[2].collect()}
    assert len(before) == 16 and sum(after[b] != before[b] for b in before) == 1
    assert len(os.listdir(version_path(f"{index}/keys", 1))) <= 3


def test_what_a_batch_opens_does_not_grow(spark, tmp_path, monkeypatch):
    """Batches of one key each: what is read beside the batch is bounded by the merges, not by the batches before."""
    table, index, opened = f"{tmp_path}/table", f"{tmp_path}/keys", []
    asked = keyindex._batches
    monkeypatch.setattr(keyindex, "_batches", lambda *a: opened.append(a[3] - a[2] - 1) or asked(*a))
    for batch in range(12):
        land(spark, [(f"l{batch}", "a")], table, index, batch, merge_every=4)
    assert max(opened) == 4

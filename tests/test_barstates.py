"""Bar states: any split of the ticks, late ticks, repeated landings and compaction give the bars of all ticks."""

import os
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from barscreen.operators import barstates as bs
from barscreen.operators import candles as cd
from barscreen.sources import barstates as table
from barscreen.sources import sinks
from barscreen.sources.candles import read_candles
from barscreen.sources.storage import committed_versions, version_path
from barscreen.streaming.bars import start_bar_state_stream
from tests.helpers import START
from tests.test_candles import TICKS


def tick_rows(n=600, seed=4):
    """Many ticks of one instant, whose order is their number alone, and a symbol with most ticks."""
    rng = random.Random(seed)
    return [
        (rng.choice("AAAB"), START + timedelta(minutes=30 * rng.randrange(6 * 48)), i, float(rng.randrange(50)), rng.randrange(9))
        for i in range(n)
    ]


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame(tick_rows(), TICKS)


def part(ticks, k, n=4):
    return ticks.where(F.pmod(F.xxhash64("seq"), F.lit(n)) == k)


def test_any_split_merges_to_the_bars_of_all_ticks(ticks):
    parts = [bs.bar_states(part(ticks, k), 240) for k in (2, 0, 3, 1)]
    first = bs.merge_states(parts[0].unionByName(parts[1]))
    second = bs.merge_states(parts[2].unionByName(parts[3]))
    merged = bs.merge_states(first.unionByName(second))
    assert same(bs.bars_of(merged), cd.resample_ticks(ticks, 240))
    assert same(bs.bars_of(bs.rollup_states(merged, 1440, fine=(240, 0))), cd.resample_ticks(ticks, 1440))
    with pytest.raises(ValueError):
        bs.rollup_states(merged, 300, fine=(240, 0))


def test_landings_repeats_and_compaction(spark, ticks, tmp_path):
    root = f"{tmp_path}/states"
    for k in range(4):
        table.land_ticks(part(ticks, k), root, k, 1440)
        table.land_ticks(part(ticks, k), root, k, 1440)
        if k == 2:
            table.compact(spark, root, up_to=1)
            assert committed_versions(spark, f"{root}/landed") == [2]
            # A repeat of what the base holds changes nothing.
            table.land_ticks(part(ticks, 0), root, 0, 1440)
    want = cd.resample_ticks(ticks, 1440)
    assert same(bs.bars_of(table.read_states(spark, root)), want)
    table.land_ticks(ticks.limit(0), root, 4, 1440)
    table.compact(spark, root, up_to=4)
    assert committed_versions(spark, f"{root}/base") == [4] and committed_versions(spark, f"{root}/landed") == []
    assert same(bs.bars_of(table.read_states(spark, root)), want)
    # A write that did not end has no mark and is not read.
    table.land_ticks(ticks, root, 5, 1440)
    os.remove(f"{version_path(f'{root}/landed', 5)}/_SUCCESS")
    assert same(bs.bars_of(table.read_states(spark, root)), want)
    assert table.touched_states(spark, root, after=4) is None


def test_late_ticks_touch_their_bars_only(spark, tmp_path):
    rows = tick_rows()
    late = [r for r in rows if r[0] == "B" and r[1] < START + timedelta(days=1)][:5]
    early = [r for r in rows if r not in late]
    root, candles = f"{tmp_path}/states", f"{tmp_path}/candles"
    for version, landed in enumerate((early, late)):
        frame = spark.createDataFrame(landed, TICKS).coalesce(1)
        frame.write.parquet(f"{tmp_path}/ticks{version}")
        landed = spark.read.parquet(f"{tmp_path}/ticks{version}")
        states = bs.bar_states(landed, 240)
        assert states._jdf.queryExecution().toString().count("FileScan") == 1
        table.land_ticks(landed, root, version, 240)
        touched = table.touched_states(spark, root, after=version - 1)
        sinks.write_candles(touched, candles)
    bars = {(r.symbol, r.ts) for r in touched.collect()}
    assert bars == {(r.symbol, r.ts) for r in cd.resample_ticks(spark.createDataFrame(late, TICKS), 240).collect()}
    plan = touched._jdf.queryExecution().toString()
    assert all("day#" in filters for filters in re.findall(r"PartitionFilters: \[(.*?)\]", plan))
    found = read_candles(spark, candles, [(240, 400)], START + timedelta(days=30)).select(*cd.KEYS, *cd.VALUES)
    assert same(found, cd.resample_ticks(spark.createDataFrame(rows, TICKS), 240))


def test_stream_with_ticks_of_any_lateness(spark, ticks, tmp_path):
    for k in range(4):
        part(ticks, k).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        for name in os.listdir(f"{tmp_path}/in{k}"):
            os.utime(f"{tmp_path}/in{k}/{name}", (1000 + k, 1000 + k))
    root, checkpoint = f"{tmp_path}/states", f"{tmp_path}/checkpoint"

    def run():
        stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
        start_bar_state_stream(stream, root, checkpoint, 240).awaitTermination()

    run()
    assert committed_versions(spark, f"{root}/landed") == [0, 1, 2, 3]
    for name in ("3", ".3.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert same(bs.bars_of(table.read_states(spark, root)), cd.resample_ticks(ticks, 240))


def test_nothing_landed(spark, tmp_path):
    with pytest.raises(ValueError, match="no ticks"):
        table.read_states(spark, f"{tmp_path}/states")

"""Landed responses as a stream: each parsed once, later ones restate, a repeated batch changes nothing."""

import json
import os
from datetime import timedelta

from barscreen.operators import signals
from barscreen.operators.candles import KEYS, VALUES
from barscreen.sources import history
from barscreen.streaming.responses import (
    read_bad_series,
    read_rejects,
    start_response_stream,
    stream_responses,
)
from tests.helpers import START

EPOCH = int(START.timestamp())


def response(symbol, first, last, shift=0.0):
    candles = [[EPOCH + 86400 * d, 1.0 + d % 3, 4.0 + d % 2, 0.5, 2.0 + d % 3 + shift, 10 + d] for d in range(first, last)]
    return json.dumps({"symbol": symbol, "interval_min": 1440, "candles": candles})


def land(folder, number, lines):
    os.makedirs(f"{folder}/in", exist_ok=True)
    path = f"{folder}/in/poll{number}.json"
    with open(path, "w") as file:
        file.write("\n".join(lines) + "\n")
    os.utime(path, (1000 + number, 1000 + number))


def run(spark, folder):
    landed = stream_responses(spark, f"{folder}/in", files_per_trigger=1)
    start_response_stream(
        landed, f"{folder}/candles", str(folder), f"{folder}/checkpoint", history=f"{folder}/history"
    ).awaitTermination()


def result(spark, folder):
    bars = spark.read.parquet(f"{folder}/candles").select(*KEYS, *VALUES)
    return sorted(map(tuple, bars.collect())), bars


def test_polls_restate_and_repeat(spark, tmp_path):
    cut = response("C", 0, 3)[:40]
    land(tmp_path, 0, [response("A", 0, 6), response("B", 0, 4), cut, json.dumps({"symbol": "D", "interval_min": 1440, "candles": [[1, 2]]})])
    # Both in one poll: the later line stands.
    land(tmp_path, 1, [response("A", 4, 9, 0.25), response("A", 5, 6, 0.5), response("E", 0, 1)])
    run(spark, tmp_path)
    rows, _ = result(spark, tmp_path)
    closes = {(r[0], (r[2] - START) // timedelta(days=1)): r[6] for r in rows}
    assert len(rows) == 9 + 4 + 1
    assert [closes["A", d] for d in (3, 4, 5, 6)] == [2.0, 3.25, 4.5, 2.25]
    land(tmp_path, 2, [response("B", 2, 6)])
    run(spark, tmp_path)
    rows, bars = result(spark, tmp_path)
    assert len(rows) == 9 + 6 + 1
    assert [(r.file.rsplit("/", 1)[1], r.record) for r in read_rejects(spark, str(tmp_path)).collect()] == [("poll0.json", cut)]
    assert {r.symbol for r in read_bad_series(spark, str(tmp_path)).collect()} == {"D"}

    kept = history.signals_of(spark.read.parquet(f"{tmp_path}/history"))
    want = signals.history(bars)
    assert kept.exceptAll(want).isEmpty() and want.exceptAll(kept).isEmpty()

    for name in ("2", ".2.crc"):
        os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    run(spark, tmp_path)
    again, bars = result(spark, tmp_path)
    assert again == rows
    want = signals.history(bars)
    assert read_rejects(spark, str(tmp_path)).count() == 1
    kept = history.signals_of(spark.read.parquet(f"{tmp_path}/history"))
    assert kept.count() == len(rows) and kept.exceptAll(want).isEmpty()

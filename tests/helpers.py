"""Fixtures by hand and slow per-series re-computations to compare with."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from barscreen.schemas import CANDLE

START = datetime(2024, 1, 1)


def bars_frame(spark, series: dict, interval_min: int = 1440, shuffle: bool = False):
    """`{symbol: [(open, high, low, close), ...]}`, oldest first, to a candle table."""
    rows = [
        (symbol, interval_min, START + timedelta(minutes=interval_min * i),
         *[None if v is None else float(v) for v in bar], 1)
        for symbol, bars in series.items()
        for i, bar in enumerate(bars)
    ]
    if shuffle:
        random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, CANDLE)


def day(i: int, interval_min: int = 1440) -> datetime:
    return START + timedelta(minutes=interval_min * i)


def random_series(seed: int, length: int, nulls: bool = False):
    """Small integer prices, so that ties and equal bars are common; low may exceed open."""
    rng = random.Random(seed)

    def price():
        return None if nulls and rng.random() < 0.15 else rng.randint(1, 9)

    return [(price(), price(), price(), price()) for _ in range(length)]


def less(a, b):
    return a is not None and b is not None and a < b


def known(values):
    return [v for v in values if v is not None]


def expected_signals(bars):
    """Signals at the last of the given bars, straight from their definitions."""
    high = [b[1] for b in bars]
    low = [b[2] for b in bars]
    close = [b[3] for b in bars]
    n = len(bars)
    if n < 2:
        direction = None
    elif less(high[-2], high[-1]) and less(low[-2], low[-1]):
        direction = "Bullish"
    elif less(high[-1], high[-2]) and less(low[-1], low[-2]):
        direction = "Bearish"
    else:
        direction = "Neutral"
    before_high, before_low = known(high[max(0, n - 6): n - 1]), known(low[max(0, n - 6): n - 1])
    up = bool(before_high) and less(max(before_high), close[-1])
    down = bool(before_low) and less(close[-1], min(before_low))
    flip = False
    if n >= 3:
        if n >= 4:
            prior = low[-4]
        else:
            prior = None if low[0] is None else min(known(low))
        flip = less(close[-2], prior) and less(high[-3], close[-1])
    return direction, up, down, flip


def expected_blocks(bars):
    found = []
    for i, (this, following) in enumerate(zip(bars, bars[1:], strict=False)):
        red, green = less(this[3], this[0]), less(this[0], this[3])
        next_red, next_green = less(following[3], following[0]), less(following[0], following[3])
        if red and next_green:
            found.append((i, "bullish", this[2], this[1]))
        elif green and next_red:
            found.append((i, "bearish", this[2], this[1]))
    return found


def expected_gaps(bars):
    found = []
    for i in range(max(0, len(bars) - 2)):
        this, following = bars[i], bars[i + 1]
        if less(this[1], following[2]):
            found.append((i, "up", this[1], following[2]))
        if less(following[1], this[2]):
            found.append((i, "down", following[1], this[2]))
    return found

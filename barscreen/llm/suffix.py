"""Suffix arrays by induced sorting, and the removal of strings that occur more than once in a corpus.

Equal strings must meet, so the corpus is not cut into shards by place but by content. Every window of
`length` bytes is owned by the k-gram with the smallest hash in it: equal windows have equal owners, at
equal places. Owners that occur once own no repeated window. The windows of the others go, as
fragments, to the shard of their owner's hash. A shard's fragments are laid end to end; their suffix
array is built by induced sorting (suffixes are classified, those of the leftmost-smaller substrings sorted
recursively or by the ranks of their prefixes, the rest induced from them), common prefixes are computed in text order, and neighbours
that share `length` bytes are one class. Windows in a class of more than one occurrence are removed.

An owner held by more than `most` texts would make one shard too large; its windows are compared as
whole strings by a digest instead, counted by Spark, which gives the same result.

Edge cases: null counts as empty; texts shorter than `length` have nothing to remove; rows repeated
with the same text are copies, so all of it goes if it is long enough; ids play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import stored, text_batches

LENGTH = 400
GRAM = 32
#: Symbols of a shard whose suffix array is built at once, about.
SHARD = 1 << 20
#: What a fragment that equals another one adds to the symbols of its shard, for its place.
PLACE = 32
#: Distinct texts that may share an owner within a shard: about 3 MB of fragments, 300 MB of arrays.
MOST = 5000
#: Bytes of text whose windows are found at once.
BLOCK = 1 << 19
#: Alphabets up to this size are induced bucket by bucket, larger ones are ordered by the ranks of their prefixes.
SMALL = 1024


# --- suffix arrays -------------------------------------------------------------------------------


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next one; the last one, a unique least symbol, is."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    less = np.append(s[:-1] < s[1:], True)
    return less[at]


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in the order of `seeds`."""
    sizes = np.bincount(s, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.full(len(s), -1, np.int64)
    head = s[seeds]
    by_head = seeds[np.argsort(head, kind="stable")]
    seed_counts = np.bincount(head, minlength=symbols)
    seed_ends = np.cumsum(seed_counts)

    def sources(block: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = block[block > 0] - 1
        before = before[small[before] == wanted]
        heads = s[before]
        place = np.argsort(heads, kind="stable")
        counts = np.bincount(heads, minlength=symbols)
        heads = heads[place]
        return before[place], heads, counts

    filled = starts.copy()
    for c in range(symbols):
        low = starts[c]
        pending = True
        while pending:
            high = filled[c]
            block = order[low:high]
            pending = high > low
            if not pending:
                block = by_head[seed_ends[c] - seed_counts[c] : seed_ends[c]]
            low = high
            if len(block):
                before, heads, counts = sources(block, False)
                rank = np.arange(len(before)) - (np.cumsum(counts) - counts)[heads]
                order[filled[heads] + rank] = before
                filled += counts
    left = ends.copy()
    order[0] = len(s) - 1
    left[0] = 0
    for c in range(symbols - 1, -1, -1):
        high = ends[c]
        pending = True
        while pending:
            low = left[c]
            block = order[low:high][::-1]
            pending = high > low
            if not pending:
                block = order[starts[c] : filled[c]][::-1]
            high = low
            if len(block):
                before, heads, counts = sources(block, True)
                rank = np.arange(len(before)) - (np.cumsum(counts) - counts)[heads]
                order[left[heads] - 1 - rank] = before
                left -= counts
    return order


def _by_tripling(s: np.ndarray) -> np.ndarray:
    """Suffix array of `s`, by ranks of ever longer prefixes; only suffixes whose rank is not their own yet are looked at again.

    Three ranks at a time, or two where three are too long for one number.
    """
    n = len(s)
    rank = np.append(s, 0).astype(np.int64)  # what is beyond the end does not count, as the last symbol is unique
    bits = max(int(s.max()), n).bit_length()
    times = 3 if 3 * bits < 64 else 2
    order = slots = np.arange(n)
    step = 1
    while len(slots):
        at = order[slots]
        key = rank[at]
        for k in range(1, times):
            key = key << bits | rank[np.minimum(at + k * step, n)]
        place = np.argsort(key)
        at, key = at[place], key[place]
        new = np.append(True, key[1:] != key[:-1])
        if step == 1:
            order = at
        else:
            order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        step *= times
    return order


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of `s`, whose last symbol is 0 and occurs once."""
    small = smaller_than_next(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) < 2:
        return induce(s, small, leftmost, symbols)
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    order = induce(s, small, leftmost, symbols)
    ordered = order[is_leftmost[order]]
    names, distinct = _names(s, leftmost, ordered)
    if distinct < len(leftmost):
        inner = suffix_array(names[leftmost], distinct) if distinct <= SMALL else _by_tripling(names[leftmost])
        ordered = leftmost[inner]
    return induce(s, small, ordered, symbols)


def _names(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, equal for equal ones, in their order."""
    length = np.zeros(len(s), np.int64)
    length[leftmost] = np.append(np.diff(leftmost) + 1, 1)
    sizes = length[ordered]
    same = sizes[1:] == sizes[:-1]
    pair = np.flatnonzero(same)
    if len(pair):
        n = sizes[pair]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        equal = s[np.repeat(ordered[pair], n) + step] == s[np.repeat(ordered[pair + 1], n) + step]
        same[pair] = np.logical_and.reduceat(equal, first)
    names = np.zeros(len(s), np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names, int((~same).sum()) + 1


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix in `order` shares with the one before it.

    In text order, a suffix whose preceding symbol equals its neighbour's shares one symbol less than
    the suffix before it; only the others are compared, all side by side.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    at = np.arange(n)
    known = before >= 0
    own = ~known | (at == 0) | (before == 0)
    own[~own] = s[at[~own] - 1] != s[before[~own] - 1]
    found = np.zeros(n, np.int64)
    active = np.flatnonzero(own & known)
    wide = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    x, y = active.copy(), before[active]
    count = np.zeros(len(active), np.int64)
    running = np.arange(len(active))
    while len(running):
        more = np.maximum(x, y) + 4 <= n
        more[more] = four[x[more]] == four[y[more]]
        running, x, y = running[more], x[more] + 4, y[more] + 4
        count[running] += 4
    x, y = active + count, before[active] + count
    running = np.arange(len(active))
    while len(running):
        more = np.maximum(x, y) < n
        more[more] = s[x[more]] == s[y[more]]
        running, x, y = running[more], x[more] + 1, y[more] + 1
        count[running] += 1
    found[active] = count
    last = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(found[last] - (at - last), 0)[order]


def repeated_starts(fragments: list[bytes], owned: list[int], weights: list[int], length: int) -> list[np.ndarray]:
    """For each fragment, the starts below `owned` whose string of `length` bytes occurs more than once.

    A fragment stands for `weights` occurrences. Only owned starts count as occurrences.
    """
    sizes = np.array([len(f) + 1 for f in fragments])
    s = np.frombuffer(b"\0".join([*fragments, b""]), np.uint8).astype(np.int64) + 2
    begin = np.cumsum(sizes) - sizes
    s[begin + sizes - 1] = 1
    s = np.append(s, 0)
    weight = np.zeros(len(s), np.int64)
    for b, n, w in zip(begin.tolist(), owned, weights):
        weight[b : b + n] = w
    order = suffix_array(s, 258)
    group = np.cumsum(common_prefixes(s, order) < length)
    total = np.bincount(group, weights=weight[order])
    again = np.zeros(len(s), bool)
    again[order] = total[group] > 1
    again &= weight > 0
    return [np.flatnonzero(again[b : b + n]) for b, n in zip(begin.tolist(), owned)]


def repeats_of(alike: dict[tuple[bytes, int], list], length: int) -> dict[tuple[bytes, int], np.ndarray]:
    """For each of a shard's fragments (bytes, windows), with owner and copies, the starts of its repeated windows.

    A fragment that occurs more than once and shares its owner with no other one is repeated as a whole;
    only the others need an order.
    """
    kinds = Counter(owner for owner, *_ in alike.values())
    again = {f: np.arange(f[1]) for f in alike}
    ordered = [f for f, (owner, copies, *_) in alike.items() if kinds[owner] > 1 or copies < 2]
    if ordered:
        found = repeated_starts([b for b, _ in ordered], [n for _, n in ordered], [alike[f][1] for f in ordered], length)
        again.update(zip(ordered, found))
    return again


# --- windows and their owners --------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every `gram` bytes, a multiple of 8."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[: len(x) - step] | x[step:] << np.uint64(8 * step)
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        out = (out ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def window_owners(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place of the owner of every window of `length` bytes, the rightmost least gram; all grams' hashes."""
    hashes = gram_hashes(data, gram)
    width, n = length - gram + 1, len(hashes)
    low = np.uint64((1 << 20) - 1)
    keys = hashes & ~low | low - np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    least = np.minimum(behind[starts], ahead[starts + width - 1])
    place = (low - (least & low)).astype(np.int64)
    return place, hashes


def surroundings(
    hashes: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each owner with the `steps` grams before and after it; 0 where the text has fewer.

    `hashes` are those of texts one after another; that of an owner lies between its `low` and `high`.
    """
    out, end = [], len(hashes) - 1
    for way in (-1, 1):
        mark, reach = hashes[place] ^ np.uint64(way + 2), place + way * gram * steps
        for k in range(1, steps + 1):
            mark = (mark ^ hashes[np.clip(place + way * gram * k, 0, end)]) * np.uint64(0x9E3779B97F4A7C15)
            mark ^= mark >> np.uint64(32)
        out.append(np.where((reach >= low) & (reach + gram <= high), mark | np.uint64(1), 0))
    return out[0], out[1]


def owner_runs(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, first window, last window, owner, before, after) of each run of windows.

    The last three are hashes, as longs, of the owner by itself and with what surrounds it.
    """
    steps = (length - GRAM) // 2 // GRAM
    pieces = [
        (k, at, t[at : at + BLOCK + length - 1])
        for k, t in enumerate(texts)
        for at in range(0, max(0, len(t) - length + 1), BLOCK)
    ]
    while pieces:
        part, size = [], 0
        while pieces and (not part or size + len(pieces[-1][2]) <= BLOCK):
            part.append(pieces.pop())
            size += len(part[-1][2])
        data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        place, hashes = window_owners(data, length)
        found, begin = [], 0
        for number, at, piece in part:
            own = place[begin : begin + len(piece) - length + 1]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            last = np.concatenate([first[1:], [len(own)]]) - 1
            end = begin + len(piece)
            found.append((first + at, last + at, own[first], *(np.full(len(first), x) for x in (number, begin, end))))
            begin = end
        first, last, owner, number, low, high = map(np.concatenate, zip(*found))
        marks = [hashes[owner], *surroundings(hashes, owner, low, high, steps)]
        yield from zip(number.tolist(), first.tolist(), last.tolist(), *(m.view(np.int64).tolist() for m in marks))


# --- on Spark ------------------------------------------------------------------------------------


def _runs(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = list(owner_runs(texts, length))
            number, low, high, *marks = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(number, pa.int64())), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                 *[pa.array(m, pa.int64()) for m in marks]],
                ["key", "low", "high", "owner", "before", "after"])

    return rows.select("key", "text").mapInArrow(run, "key binary, low int, high int, owner long, before long, after long")


def _fragments(held: DataFrame, length: int) -> DataFrame:
    """`held`: (key, text, runs); one row per run with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            rows = [
                (key, r["low"], r["high"] - r["low"] + 1, r["owner"], r["copies"], r["common"], text[r["low"] : r["high"] + length])
                for key, text, runs in zip(batch.column("key").to_pylist(), texts, batch.column("runs").to_pylist())
                for r in runs
            ]
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["key", "low", "windows", "owner", "copies", "common", "bytes"]
    return held.mapInArrow(run, "key binary, low int, windows int, owner long, copies long, common boolean, bytes binary")


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that strings at `starts` (ascending) cover, as (begin, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first, last = np.append(starts[:1], starts[cut + 1]), np.append(starts[cut], starts[-1:])
    return list(zip(first.tolist(), (last + length).tolist()))


def _span_rows(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    key, begin, end = zip(*rows) if rows else ((), (), ())
    arrays = [pa.array(key, pa.binary()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "begin", "end"])


def _repeats_in_shards(fragments: DataFrame, length: int, shard: int) -> DataFrame:
    """(key, begin, end): covered bytes, by the suffix arrays of shards of whole owners."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[bytes, int], list]]:
        """Different fragments (bytes, windows) with the owner, the copies and the (key, low) of those equal to each."""
        alike: dict[tuple[bytes, int], list] = {}  # equal fragments stand for one another
        size, owner = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= shard and row["owner"] != owner:
                    yield alike
                    alike, size = {}, 0
                owner = row["owner"]
                held = alike.get((row["bytes"], row["windows"]))
                if held is None:
                    held = alike[row["bytes"], row["windows"]] = [owner, 0, []]
                    size += len(row["bytes"])
                held[1] += row["copies"]
                held[2].append((row["key"], row["low"]))
                size += PLACE
        if alike:
            yield alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alike in shards(batches):
            again = repeats_of(alike, length)
            out = [
                (key, low + a, low + b)
                for f, (_, _, places) in alike.items()
                for a, b in _spans(again[f], length)
                for key, low in places
            ]
            yield _span_rows(out)

    dealt = fragments.repartition("owner").sortWithinPartitions("owner", "key", "low")
    return dealt.mapInArrow(run, "key binary, begin int, end int")


def _repeats_by_digest(fragments: DataFrame, length: int) -> DataFrame:
    """(key, spans), the same for owners that too many texts hold: their windows are compared one by one.

    Equal fragments are combined first, so what all the texts share is looked at once.
    """
    alike = fragments.groupBy("bytes", "windows").agg(F.sum("copies").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, n = row["bytes"], row["windows"]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([hashlib.sha256(data).digest()] * n, pa.binary()), "windows": pa.array([n] * n, pa.int32()),
                    "start": pa.array(range(n), pa.int32()), "copies": pa.array([row["copies"]] * n, pa.int64()),
                    "digest": pa.array([hashlib.sha256(data[k : k + length]).digest() for k in range(n)], pa.binary())})

    windows = alike.mapInArrow(run, "part binary, windows int, start int, copies long, digest binary")
    again = windows.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1").select("digest")
    starts = windows.join(again, "digest").groupBy("part", "windows").agg(F.collect_list("start").alias("starts"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_spans(np.sort(np.array(x)), length) for x in batch.column("starts").to_pylist()]
            found = [[{"begin": a, "end": b} for a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("windows"), pa.array(found, kind)], ["part", "windows", "spans"])

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    # The spans of a fragment are made once; every text that holds it adds its own place.
    found = starts.mapInArrow(spans, "part binary, windows int, spans array<struct<begin:int,end:int>>")
    owned = fragments.select("key", "low", "windows", F.unhex(F.sha2("bytes", 256)).alias("part"))
    placed = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("low")).alias("begin"), (x["end"] + F.col("low")).alias("end")))
    return owned.join(found, ["part", "windows"]).select("key", placed.alias("spans"))


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    shard: int = SHARD,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    long = rows.where(F.octet_length("text") >= length)
    runs = _runs(long, length).groupBy("key", "low", "high", "owner", "before", "after")
    runs = stored(runs.agg(F.count("*").alias("copies")), "runs")
    # A window holds its owner with all that stands on one side of it within half a window, so equal
    # windows agree in what is before or after the owner; other runs cannot hold a repeated window.
    marked = runs.select("*", F.explode(F.array_remove(F.array("before", "after"), 0)).alias("mark"))
    marks = marked.groupBy("mark").agg(F.sum("copies").alias("held")).where("held > 1").select("mark")
    runs = stored(marked.join(marks, "mark").select("key", "low", "high", "owner", "copies").distinct(), "candidates")
    owners = runs.groupBy("owner").agg((F.count("*") > most).alias("common"))
    by_text = runs.join(owners, "owner").groupBy("key").agg(
        F.collect_list(F.struct("low", "high", "owner", "copies", "common")).alias("runs"))
    # Copies of a text have the same runs, so one of them is looked at.
    one = long.groupBy("key").agg(F.min("doc_id").alias("one"))
    asked = by_text.join(one, "key")
    held = long.join(asked, "key").where(F.col("doc_id").eqNullSafe(F.col("one"))).select("key", "text", "runs")
    fragments = stored(_fragments(held, length), "fragments")
    found = _repeats_in_shards(fragments.where("not common"), length, shard)
    found = found.select("key", F.array(F.struct("begin", "end")).alias("spans"))
    found = found.union(_repeats_by_digest(fragments.where("common"), length))
    spans = stored(found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for data, spans in zip(texts, batch.column("spans").to_pylist()):
                kept, end, removed, count = [], 0, 0, 0
                for a, b in sorted((s["begin"], s["end"]) for s in spans or []):
                    if a > end or not count:
                        kept.append(data[end:a])
                        count += 1
                    removed += max(0, b - max(a, end))
                    end = max(end, b)
                kept.append(data[end:])
                left = b"".join(kept)
                out.append((len(data), removed, count, hashlib.sha256(left).hexdigest(), left))
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kind = docs.schema[id_col].dataType.simpleString()
    whole = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

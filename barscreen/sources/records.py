"""Records of CSV files whose cells may hold line breaks, read in splits of any size.

A reader of such files must know whether a line begins inside quotes, which depends on all lines before
it, so Spark's `multiLine` reads a file as one task. Here the physical lines are read in splits, and a line
tells two things about itself: the state (inside quotes or not) after it if it begins outside, and if it
begins inside. These pairs compose, first along the lines of a block (one split), then along the blocks of
a file, of which there is one row each (a small stored table). Then every line knows its record. A task reads
the lines of its blocks in order, so no line is shuffled or sorted; they are read twice. A record that crosses
blocks gets the first lines of the later ones; only these lines travel, by a stored table. No task holds more
than a record and the lines with which a block begins. This takes several times the work of the reader that
has one task per file.

Lines end with a line feed; a carriage return before it is dropped, within cells too. A quote opens a cell at its beginning only,
two quotes within a quoted cell stand for one, and what follows a closing quote belongs to the cell up to
the next comma. Empty lines between records are no records. A cell that is never closed reaches to the end
of its file, in one task. Compressed files have one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barscreen.sources.storage import shared_dir

# Possessive throughout: cells are matched without going back, and without a stack that grows with them.
_REST_QUOTED = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CELL = rf'(?:"{_REST_QUOTED}|[^",][^,]*+)?+'
#: Lines after which no cell is open, if none, or one, was open before.
ENDS_OUTSIDE = rf"^(?:{_CELL},)*+{_CELL}\z"
ENDS_OUTSIDE_IF_INSIDE = rf"^{_REST_QUOTED}(?:,{_CELL})*+\z"

BLOCK = ["file", "block"]


def _states_after(df: DataFrame, ordered: WindowSpec, if_outside: str, if_inside: str) -> DataFrame:
    """Columns `after0` and `after1`: the state after each row if the first one begins outside, inside.

    A row either sets the state, keeps it or turns it over; so it is what the last setting row left,
    turned over as often as rows since then did.
    """
    sets = F.col(if_outside) == F.col(if_inside)
    turns = df.withColumn("_turns", F.sum((F.col(if_outside) > F.col(if_inside)).cast("bigint")).over(ordered))
    last_set = F.last(F.when(sets, F.struct(F.col(if_outside).alias("state"), "_turns")), ignorenulls=True)
    known = turns.withColumn("_set", last_set.over(ordered))

    def after(first: int) -> Column:
        begin = F.coalesce(F.col("_set.state") + F.col("_set._turns"), F.lit(first))
        return ((begin + F.col("_turns")) % 2).cast("int")

    return known.withColumns({"after0": after(0), "after1": after(1)}).drop("_turns", "_set")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their block, and the state after each (1: inside quotes) if it begins outside, inside."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.rtrim("value", F.lit("\r")).alias("line"),
    )
    quoted = F.col("line").contains('"')
    return read.withColumns({
        "f0": F.when(quoted, (~F.col("line").rlike(ENDS_OUTSIDE)).cast("int")).otherwise(0),
        "f1": F.when(quoted, (~F.col("line").rlike(ENDS_OUTSIDE_IF_INSIDE)).cast("int")).otherwise(1),
    })


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that are of one block each, with the block."""
    if not batch.num_rows:
        return
    file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    other = (np.diff(file.indices.to_numpy()) != 0) | (np.diff(block) != 0)
    ends = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    for begin, end in zip(ends, ends[1:]):
        yield (file[begin].as_py(), int(block[begin])), batch.slice(begin, end - begin)


class _Block:
    """What the lines of a block tell so far, under both states at its begin."""

    def __init__(self) -> None:
        self.state, self.begun, self.lead, self.head = [0, 1], [0, 0], [None, None], []

    def add(self, lines: list[str], f0: list[int], f1: list[int]) -> None:
        for line, *after in zip(lines, f0, f1):
            for s in (0, 1):
                if not self.state[s]:
                    self.begun[s] += 1
                if self.lead[s] is None and line and self.begun[s]:
                    self.lead[s] = self.begun[s]
                self.state[s] = after[self.state[s]]
            if not self.begun[1]:
                self.head.append(line)

    def row(self) -> tuple:
        return (*self.state, *self.begun, *self.lead, "\n".join(self.head) if self.head else None)


BLOCKS = "file string, block long, f0 int, f1 int, n0 long, n1 long, lead0 long, lead1 long, head string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    names, types = zip(*(field.split() for field in kind.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types)], list(names))


def _columns(piece: pa.RecordBatch, *names: str) -> list[list]:
    return [piece.column(name).to_pylist() for name in names]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block (`BLOCKS`) from the lines of blocks, each in one row of batches and in order."""
    at, block = None, _Block()
    for batch in batches:
        for found, piece in _pieces(batch):
            if found != at:
                if at is not None:
                    yield _batch([(*at, *block.row())], BLOCKS)
                at, block = found, _Block()
            block.add(*_columns(piece, "line", "f0", "f1"))
    if at is not None:
        yield _batch([(*at, *block.row())], BLOCKS)


RECORDS = "file string, block long, number long, is_header boolean, is_last boolean, text string"


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in each block (`RECORDS`), as far as they are in it, from its lines and what `_chained` tells."""
    at, state, n, held = None, 0, 0, []
    earlier = begun = header = 0

    def done() -> Iterator[tuple]:
        if n:
            yield (*at, earlier + n, earlier + n == header, n == begun, "\n".join(held))

    for batch in batches:
        out = []
        for found, piece in _pieces(batch):
            if found != at:
                out += done()
                state, earlier, begun, header = (piece.column(c)[0].as_py() for c in ("inside", "earlier", "begun", "header"))
                at, n, held = found, 0, []
            for line, *after in zip(*_columns(piece, "line", "f0", "f1")):
                if state:
                    if n:
                        held.append(line)
                else:
                    out += done()
                    n, held = n + 1, [line]
                state = after[state]
        yield _batch(out, RECORDS)
    yield _batch([*done()], RECORDS)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _joined(lines: Column) -> Column:
    """A list of (place, line) as one text."""
    return F.array_join(F.transform(F.array_sort(lines), lambda e: e["line"]), "\n")


def _chained(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per block in which a record begins: its state at the begin, records before and in it; and the rest of its last record."""
    ordered = W.partitionBy("file").orderBy("block")
    blocks = _states_after(blocks, ordered, "f0", "f1").withColumn("inside", F.lag("after0", 1, 0).over(ordered))
    is_inside = F.col("inside") == 1
    blocks = blocks.select(
        *BLOCK, "inside", "head",
        F.when(is_inside, F.col("n1")).otherwise(F.col("n0")).alias("begun"),
        F.when(is_inside, F.col("lead1")).otherwise(F.col("lead0")).alias("lead"),
    )
    begins = (F.col("begun") > 0).cast("bigint")
    blocks = blocks.withColumns({
        "earlier": F.sum("begun").over(ordered) - F.col("begun"),
        "place": F.sum(begins).over(ordered),
    })
    blocks = blocks.withColumn("header", F.min(F.col("earlier") + F.col("lead")).over(W.partitionBy("file")))
    begun = blocks.where("begun > 0")
    # The first lines of a block that begins inside belong to the last block before it in which a record begins.
    heads = blocks.where(is_inside).groupBy("file", (F.col("place") - begins).alias("place")).agg(
        _joined(F.collect_list(F.struct("block", F.col("head").alias("line")))).alias("tail"))
    tails = begun.select(*BLOCK, "place").join(heads, ["file", "place"]).select(*BLOCK, "tail")
    return begun.drop("head", "place", "lead"), tails


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, is_header, record): the records of the files of `path`, numbered within each.

    The header is the first record of a file.
    """
    lines = _lines(spark, path)
    blocks, tails = _chained(_stored(lines.mapInArrow(_block_rows, BLOCKS), "csv-blocks"))
    # A few numbers a block; as a broadcast they leave the lines where they are and in their order.
    found = lines.join(F.broadcast(_stored(blocks, "csv-chained")), BLOCK).mapInArrow(_record_rows, RECORDS)
    tails = _stored(tails.withColumn("is_last", F.lit(True)), "csv-tails")
    whole = found.join(tails, [*BLOCK, "is_last"], "left")
    text = F.concat("text", F.coalesce(F.concat(F.lit("\n"), F.col("tail")), F.lit("")))
    # The mark of the character encoding may stand before the first record of a file.
    text = F.regexp_replace(text, "^\ufeff", "")
    return whole.select("file", "number", "is_header", text.alias("record")).where("record <> ''")

"""Landing of fundamentals CSV files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barscreen.functions.parsing import date_or_null, missing_to_null, number_or_null
from barscreen.functions.text import clean_code
from barscreen.operators.validate import check_headers
from barscreen.schemas import DATE_HEADERS, NUMERIC_HEADERS, REQUIRED_HEADERS, snake
from barscreen.sources.records import read_records
from barscreen.sources.storage import file_order_fields


class Landed(NamedTuple):
    frame: DataFrame
    extra: list[str]


def read_headers(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """The header row as it is spelled; the later of two equal headers gets a number."""
    first = _csv(spark, multi_line).csv(path).first()
    if first is None:
        raise ValueError(f"no header row in {path}")
    seen: dict[str, int] = {}
    headers = []
    for i, cell in enumerate(first):
        header = cell if cell is not None else f"Unnamed: {i}"
        count = seen.get(header, 0)
        seen[header] = count + 1
        headers.append(f"{header}.{count}" if count else header)
    return headers


def read_header_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers) of every CSV file of `path`, whatever its headers; a file without lines is not told.

    Only files' first blocks are kept, and of each the first line that is not blank; a header row has no line breaks.
    """
    lines = spark.read.text(path).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    place = F.monotonically_increasing_id()
    first = lines.select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    first = first.groupBy("file").agg(F.min_by("value", "place").alias("line"))
    # As many cells as commas can part.
    cells = F.split(F.regexp_replace("line", "^\ufeff", ""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return first.select("file", plain.alias("headers"))


CELLS = {"quote": '"', "escape": '"'}


def _csv(spark: SparkSession, multi_line: bool = False):
    return spark.read.options(multiLine=multi_line, **CELLS)


def _split_records(spark: SparkSession, path: str, headers: list[str], plain: bool) -> DataFrame:
    """`ord` and the cells `c0`, `c1`, ... of files whose cells may contain line breaks.

    The place of a row is its number in the file, however the file was split.
    """
    kind = ", ".join(f"c{i} string" for i in range(len(headers)))
    cells = F.from_csv("record", kind, {**CELLS, "multiLine": "true"}).alias("cells")
    place = F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("number").alias("row")).alias("ord")
    rows = read_records(spark, path).select(place, "is_header", cells)
    same = F.array(*[F.col(f"cells.c{i}").eqNullSafe(h) for i, h in enumerate(headers)])
    other = F.raise_error(F.concat(F.lit("CSV header does not conform to that of the first file: "), F.col("ord.file")))
    fits = F.forall(same, lambda x: x) if plain else F.lit(True)
    kept = F.when(F.col("is_header"), F.when(fits, F.lit(False)).otherwise(other.cast("boolean"))).otherwise(F.lit(True))
    return rows.where(kept).select("ord", "cells.*")


def column_names(headers: list[str]) -> list[str]:
    """Required headers in snake case, others as spelled; names that differ only in case apart."""
    names = {h: snake(h) for h in REQUIRED_HEADERS}
    taken = {names[h] for h in headers if h in names} | {"ord", "non_numeric", "unparsed_dates"}
    out = []
    for header in headers:
        name = names.get(header)
        if name is None:
            name = header
            while name.lower() in taken:
                name = f"{name}_extra"
            taken.add(name.lower())
        out.append(name)
    return out


def read_fundamentals(
    spark: SparkSession,
    path: str,
    date_formats: list[str] | None = None,
    multi_line: bool = False,
) -> Landed:
    """Read, check the headers, unify missing values and type the columns.

    All columns are read as text first. `non_numeric` lists the headers of number cells that hold
    other text, `unparsed_dates` those of date cells; those cells become null. With `multi_line` cells may contain line breaks;
    files are split then too, and their lines are read twice (`sources/records.py`).
    """
    headers = read_headers(spark, path, multi_line)
    extra = check_headers(headers)
    names = column_names(headers)
    # Every file's header row is compared with the names of the schema, where they are names.
    plain = len({h.lower() for h in headers}) == len(headers) and not any("Unnamed: " in h for h in headers)
    if multi_line:
        raw = _split_records(spark, path, headers, plain)
    else:
        cells = headers if plain else [f"c{i}" for i in range(len(headers))]
        raw_schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
        reader = _csv(spark).option("header", True).option("enforceSchema", not plain)
        raw = reader.schema(raw_schema).csv(path)
        raw = raw.select(
            F.struct(*file_order_fields()).alias("ord"),
            *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(cells)],
        )

    # Cells, typed columns and the lists of bad cells are separate projections, so that every cell is parsed once although
    # it is referred to twice. Cells of a kind are parsed as one array: written out for every column, a projection's code
    # is too long for the JVM to compile.
    numeric, dated = ([i for i, h in enumerate(headers) if h in kind] for kind in (NUMERIC_HEADERS, DATE_HEADERS))
    listed = {i: F.get("numbers", F.lit(k)) for k, i in enumerate(numeric)} | {i: F.get("dates", F.lit(k)) for k, i in enumerate(dated)}

    def as_array(places: list[int]) -> Column:
        return F.transform(F.array(*[F.col(f"c{i}") for i in places]), missing_to_null)

    cells = raw.select(
        "ord",
        *[missing_to_null(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(headers)) if i not in listed],
        as_array(numeric).alias("number_cells"),
        as_array(dated).alias("date_cells"),
    )

    def typed(i: int, header: str) -> Column:
        if i in listed:
            return listed[i]
        return clean_code(F.col(f"c{i}")) if header in ("NSE Code", "BSE Code") else F.col(f"c{i}")

    parsed = cells.select(
        "*",
        F.transform("number_cells", number_or_null).alias("numbers"),
        F.transform("date_cells", lambda x: date_or_null(x, date_formats)).alias("dates"),
    )

    def bad_cells(places: list[int], texts: str, values: str) -> Column:
        spelled = F.array(*[F.lit(headers[i]) for i in places])
        bad = F.transform(texts, lambda x, k: F.when(x.isNotNull() & F.get(values, k).isNull(), F.get(spelled, k)))
        return F.array_compact(bad)

    frame = parsed.select(
        "ord",
        *[typed(i, h).alias(name) for i, (h, name) in enumerate(zip(headers, names))],
        bad_cells(numeric, "number_cells", "numbers").alias("non_numeric"),
        bad_cells(dated, "date_cells", "dates").alias("unparsed_dates"),
    )
    return Landed(frame, extra)


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """The validated table as `sinks.write_validated` stored it."""
    return spark.read.parquet(path)


def date_warnings(fundamentals: DataFrame) -> DataFrame:
    """One row per date cell that could not be read; such a company is never counted as stale."""
    return fundamentals.select(
        F.col("nse_code").alias("symbol"), F.explode("unparsed_dates").alias("header")
    )


def non_numeric_warnings(fundamentals: DataFrame) -> DataFrame:
    """One row per number cell that held other text."""
    return fundamentals.select(
        F.col("nse_code").alias("symbol"), F.explode("non_numeric").alias("header")
    )

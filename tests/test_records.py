"""Records of CSV files with line breaks in cells: the same for splits of any size as in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from barscreen.schemas import REQUIRED_HEADERS
from barscreen.sources.fundamentals import read_fundamentals
from barscreen.sources.records import read_records

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(params=[60, 700, 1 << 27])
def split_bytes(spark, request):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, request.param)
    yield request.param
    spark.conf.set(SPLIT, before)


def cells_of(spark, path):
    """As Spark reads each file in one task."""
    plain = spark.read.options(multiLine=True, quote='"', escape='"').schema("a string, b string, c string")
    return [tuple(r) for r in plain.csv(path).collect()]


def split_cells(spark, path):
    records = read_records(spark, path)
    parsed = F.from_csv("record", "a string, b string, c string", {"quote": '"', "escape": '"', "multiLine": "true"})
    return [tuple(r.cells) for r in records.orderBy("file", "number").select(parsed.alias("cells")).collect()]


def random_text(draw, end):
    pieces = ["a", "é", '""', ",", end, end + end, "long text " * 4, ""]
    lines = []
    for _ in range(120):
        cells = []
        for _ in range(3):
            if draw.random() < 0.4:
                cells.append('"' + "".join(draw.choices(pieces, k=draw.randrange(6))) + '"')
            else:
                cells.append(draw.choice(["", "x", "5\"6", " y z", "12.5"]))
        lines.append(",".join(cells))
        if draw.random() < 0.1:
            lines.append("")
    return end.join(lines) + draw.choice(["", end])


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_task(spark, tmp_path, split_bytes, seed):
    path = tmp_path / "r.csv"
    path.write_bytes(random_text(random.Random(seed), "\n" if seed % 2 else "\r\n").encode())
    want = cells_of(spark, str(path))
    assert len(want) == 120
    assert split_cells(spark, str(path)) == want


def test_record_over_many_splits(spark, tmp_path, split_bytes):
    """A cell far longer than a split, one after another, and the record after them."""
    long = "\n".join(f"line {k}" for k in range(300))
    path = tmp_path / "r.csv"
    path.write_text(f'1,"{long}",x\n2,"{long}""","{long}"\n3,y,z\n')
    assert split_cells(spark, str(path)) == [("1", long, "x"), ("2", long + '"', long), ("3", "y", "z")]


def test_several_files_each_with_a_header(spark, tmp_path, split_bytes):
    for k in range(3):
        rows = ",".join(REQUIRED_HEADERS) + "\n" + "".join(
            f'"Company\n{k}, {i}",C{i}' + "," * (len(REQUIRED_HEADERS) - 2) + "\n" for i in range(5))
        (tmp_path / f"{k}.csv").write_text("\ufeff" * (k == 1) + "\n" * k + rows)
    landed = read_fundamentals(spark, str(tmp_path), multi_line=True).frame
    found = [r[0] for r in landed.orderBy("ord").select(F.col(landed.columns[1 + REQUIRED_HEADERS.index("Name")])).collect()]
    assert len(found) == 15 and all("\n" in name for name in found)
    assert sorted(found) == sorted(f"Company\n{k}, {i}" for k in range(3) for i in range(5))


def test_another_header_is_an_error(spark, tmp_path):
    for k, headers in enumerate((REQUIRED_HEADERS, REQUIRED_HEADERS[::-1])):
        (tmp_path / f"{k}.csv").write_text(",".join(headers) + "\n")
    with pytest.raises(Exception, match="header does not conform.*1.csv"):
        read_fundamentals(spark, str(tmp_path), multi_line=True).frame.collect()


def test_lines_are_shuffled_by_block_and_files_are_split(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("".join(f'{k},"a\nb",c\n' for k in range(2000)))
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, 2000)
    try:
        records = read_records(spark, str(path))
        assert records.count() == 2000
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        records.collect()
        text = records._jdf.queryExecution().executedPlan().toString()
        final = text[: text.index("== Initial Plan ==")]
        # The lines' shuffle by block serves their windows and their records; blocks may come by another or be broadcast.
        assert len(re.findall(r"Exchange hashpartitioning\(file#\d+, block#\d+L, \d+\)", final)) <= 2
        assert final.count("FileScan text") == 1
    finally:
        spark.conf.set(SPLIT, before)


def test_empty_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("")
    assert read_records(spark, str(tmp_path / "r.csv")).count() == 0


def test_lines_are_not_shuffled(spark, tmp_path):
    """Only what crosses blocks travels: a record costs neither an exchange nor a sort."""
    path = tmp_path / "r.csv"
    path.write_text("".join(f'{k},"a\nb",c\n' for k in range(2000)))
    records = read_records(spark, str(path))
    assert records.count() == 2000
    records.collect()
    text = records._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")]
    assert "Exchange hashpartitioning" not in final and "Sort " not in final and "Window" not in final

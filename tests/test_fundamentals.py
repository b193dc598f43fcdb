import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barscreen.functions.parsing import DATE_KINDS, date_or_null
from barscreen.operators import rules, symbols, validate
from barscreen.operators.master import master_key
from barscreen.plans.run import ingest
from barscreen.schemas import MASTER, REQUIRED_HEADERS
from barscreen.sources import sinks
from barscreen.sources.fundamentals import (
    date_warnings,
    non_numeric_warnings,
    read_fundamentals,
    read_header_rows,
)

AS_OF = datetime(2024, 7, 31, 10)


def write_csv(path, rows, headers=None):
    """`rows` are dicts by header; cells not given are empty."""
    headers = headers or REQUIRED_HEADERS

    def cell(text):
        text = str(text)
        return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n') else text

    lines = [",".join(cell(h) for h in headers)]
    lines += [",".join(cell(row.get(h, "")) for h in headers) for row in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def row(name, nse="", isin="", **more):
    return {"Name": name, "NSE Code": nse, "ISIN": isin, **more}


def test_landing_types_and_missing_values(spark, tmp_path):
    path = write_csv(
        tmp_path / "s.csv",
        [
            row('Acme, "the" one', " ACME ", "IN1", **{
                "BSE Code": "500", "Return on Capital Employed": "12.5",
                "Debt to Equity": " 1e-1 ", "Last quarterly result date": "2024-03-31",
                "Last annual result date": "31/12/2023"}),
            row("Beta", "NA", "None", **{
                "BSE Code": "  ", "Return on Capital Employed": "n.m.", "Debt to Equity": "1,5",
                "Altman Z Score": "1d", "Last quarterly result date": "202404",
                "Last annual result date": "soon", "Piotroski score": "nan"}),
        ],
    )
    first, second = sorted(read_fundamentals(spark, path).frame.collect(), key=lambda r: r["ord"])
    assert first["name"] == 'Acme, "the" one'
    assert (first["nse_code"], first["bse_code"], first["isin"]) == ("ACME", "500", "IN1")
    assert (first["return_on_capital_employed"], first["debt_to_equity"]) == (12.5, 0.1)
    assert first["last_quarterly_result_date"] == datetime(2024, 3, 31)
    assert first["last_annual_result_date"] == datetime(2023, 12, 31)
    assert first["non_numeric"] == []
    assert (second["nse_code"], second["bse_code"], second["isin"]) == (None, None, None)
    assert second["last_quarterly_result_date"] == datetime(2024, 4, 1)
    assert second["last_annual_result_date"] is None and second["piotroski_score"] is None
    assert second["non_numeric"] == [
        "Return on Capital Employed", "Debt to Equity", "Altman Z Score"
    ]


def test_cells_of_a_kind_are_parsed_by_one_expression(spark, tmp_path):
    """Code that is written out for every number column is too long to be compiled."""
    path = write_csv(tmp_path / "s.csv", [row("Acme")])
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 5000)
    try:
        plan = read_fundamentals(spark, path).frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    assert plan.lower().count("rlike") < 10


@pytest.mark.parametrize("text", ["2024-03-31", "2023-02-30", "2024-13-01", "pending", "", "31 March", "\u0663-x"])
def test_kinds_of_dates_leave_out_formats_that_cannot_fit(spark, text):
    every = [f for _, some in DATE_KINDS for f in some]
    (pattern, some) = next(k for k in DATE_KINDS if re.search(k[0], text))
    assert len(some) < 3 or "March" in text
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(date_or_null(F.col("t")), F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in every])).first()
    assert got[0] == got[1]


def test_warnings_name_symbol_and_header(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", [row("A", "A", "IN1", **{"Debt to Equity": "x"})])
    found = non_numeric_warnings(read_fundamentals(spark, path).frame).collect()
    assert [tuple(r) for r in found] == [("A", "Debt to Equity")]


def test_missing_headers_are_named_in_order(spark, tmp_path):
    headers = [h for h in REQUIRED_HEADERS if h not in ("Sector", "Altman Z Score", "Name")]
    path = write_csv(tmp_path / "s.csv", [], headers)
    with pytest.raises(ValueError, match=r"\['Name', 'Sector', 'Altman Z Score'\]"):
        read_fundamentals(spark, path)


def test_extra_headers_are_kept_case_and_all(spark, tmp_path):
    headers = [*REQUIRED_HEADERS, "Return on capital employed", "isin", "Note", "Note"]
    path = write_csv(
        tmp_path / "s.csv",
        [{**row("A", "A", "IN1"), "Return on capital employed": "7", "isin": "IN9", "Note": "x",
          "Return on Capital Employed": "20"}],
        headers,
    )
    with pytest.warns(UserWarning, match="extra columns"):
        landed = read_fundamentals(spark, path)
    assert landed.extra == ["Return on capital employed", "isin", "Note", "Note.1"]
    found = landed.frame.first()
    assert found["return_on_capital_employed"] == 20.0
    assert found["Return on capital employed"] == "7"
    assert (found["isin"], found["isin_extra"], found["Note"], found["Note.1"]) == (
        "IN1", "IN9", "x", "x")
    profiles = {m: rules.fundamental_profile(landed.frame, m).first()["roce"]
                for m in ("corrected", "literal")}
    assert profiles == {"corrected": 20.0, "literal": 7.0}


def test_absent_profile_columns_count_as_zero_missing_values_do_not(spark):
    df = spark.createDataFrame([("A", None)], "symbol string, altman_z_score double")
    found = rules.fundamental_profile(df, "literal").first()
    assert (found["roce"], found["de_ratio"], found["altman_z"], found["piotroski_score"]) == (
        0.0, 0.0, None, 0.0)


LANDED = "ord bigint, nse_code string, isin string, last_quarterly_result_date timestamp"


@pytest.mark.parametrize(
    ("as_of", "filed", "stale"),
    [
        (AS_OF, datetime(2024, 3, 31), True),
        (AS_OF, datetime(2024, 3, 31, 10), False),
        (AS_OF, datetime(2024, 4, 1), False),
        (AS_OF, None, False),
        # Four months before the end of June is the end of February, at the same time of day.
        (datetime(2024, 6, 30, 10), datetime(2024, 2, 29), True),
        (datetime(2024, 6, 30), datetime(2024, 2, 29), False),
        (datetime(2024, 6, 30), datetime(2024, 2, 28, 23, 59, 59), True),
        (datetime(2024, 6, 29), datetime(2024, 2, 29), False),
        (datetime(2023, 6, 30), datetime(2023, 2, 28), False),
    ],
)
def test_stale_means_more_than_four_calendar_months(spark, as_of, filed, stale):
    df = spark.createDataFrame([(1, "A", "I", filed)], LANDED)
    assert validate.stale_rows(df, as_of).count() == int(stale)


def test_report_and_dedupe(spark):
    old, new = datetime(2023, 1, 1), datetime(2024, 7, 1)
    rows = [(5, "E", None, old), (1, "A", "I1", old), (4, None, None, new), (2, "B", "I1", new),
            (3, "C", "I2", None)]
    df = spark.createDataFrame(rows, LANDED)
    result = validate.validate(df, AS_OF)
    kept = sorted((r["ord"], r["nse_code"], r["isin"]) for r in result.frame.collect())
    # Rows without ISIN are one company: the first of them stays.
    assert kept == [(1, "A", "I1"), (3, "C", "I2"), (4, None, None)]
    assert result.report.first().asDict() == {
        "rows_in": 5, "stale_count": 2, "missing_code_count": 1, "rows_out": 3,
        "has_missing_code": True, "has_duplicates": True,
    }
    assert validate.dedupe_isin(df, keep_null_isin=True).count() == 4


def test_report_of_an_empty_file(spark):
    assert validate.report(spark.createDataFrame([], LANDED), AS_OF).first().asDict() == {
        "rows_in": 0, "stale_count": 0, "missing_code_count": 0, "rows_out": 0,
        "has_missing_code": False, "has_duplicates": False,
    }


def test_symbols_are_stripped_and_in_first_appearance_order(spark):
    rows = [(3, "B"), (1, "  A \t"), (2, None), (5, "A"), (4, "B\n"), (6, "C D")]
    df = spark.createDataFrame(rows, "ord bigint, nse_code string")
    found = symbols.distinct_symbols(df)
    assert [r["symbol"] for r in found.orderBy("ord").collect()] == ["A", "B", "C D"]
    assert [r["symbol"] for r in symbols.head(found, 2).collect()] == ["A", "B"]


def test_master_fills_only_what_is_missing(spark):
    existing = spark.createDataFrame([("X1", "A", None, None, "S", None)], MASTER)
    incoming = spark.createDataFrame(
        [(0, "X1", "B", None, "b1", None, None), (1, "X1", "C", "T", "b2", "Z", "I"),
         (2, "X2", "D", "U", None, None, None), (4, "X2", "E", None, None, "late", None),
         (3, "X2", "F", None, None, "early", None)],
        "ord bigint, isin string, name string, symbol_nse string, symbol_bse string,"
        " sector string, industry string",
    )
    from barscreen.operators.master import upsert

    merged = upsert(existing, incoming)
    want = [("X1", "A", "T", "b1", "S", "I"), ("X2", "D", "U", None, "early", None)]
    assert sorted(tuple(r) for r in merged.collect()) == want
    again = upsert(merged, incoming)
    assert sorted(tuple(r) for r in again.collect()) == want


def test_master_key_falls_back_only_for_the_empty_string(spark):
    df = spark.createDataFrame(
        [("I1", "o1"), ("", "o2"), (None, "o3"), ("", None)], "isin string, isin_extra string"
    )
    keys = [r[0] for r in df.select(master_key(df.columns)).collect()]
    assert keys == ["I1", "o2", None, None]
    only = df.select("isin_extra")
    assert [r[0] for r in only.select(master_key(only.columns)).collect()] == [
        "o1", "o2", "o3", None]


def test_ingest_stores_table_master_and_report(spark, tmp_path):
    path = write_csv(
        tmp_path / "s.csv",
        [row("A", "A", "I1", Sector="s"), row("A2", "A", "I1", Industry="ignored"),
         row("B", " B", "I2"), row("N", "N", "")],
    )
    args = str(tmp_path / "validated"), str(tmp_path / "master"), AS_OF
    first = ingest(spark, path, *args)
    assert first.report.first()["rows_out"] == 3
    assert [r["name"] for r in first.frame.orderBy("ord").collect()] == ["A", "B", "N"]
    assert {r["isin"]: r["name"] for r in first.master.collect()} == {"I1": "A", "I2": "B"}
    more = write_csv(tmp_path / "t.csv", [row("Z", "Z", "I1", Industry="new"), row("C", "C", "I3")])
    second = ingest(spark, more, *args)
    found = {r["isin"]: (r["name"], r["sector"], r["industry"]) for r in second.master.collect()}
    assert found == {"I1": ("A", "s", "new"), "I2": ("B", None, None), "I3": ("C", None, None)}


def test_csv_is_parsed_once_in_a_run(spark, tmp_path):
    """What is stored and reported stays as it was landed, though the CSV is gone."""
    path = write_csv(tmp_path / "s.csv", [row("A", "A", "I1", **{"Debt to Equity": "x"}), row("A2", "A", "I1")])
    landed = str(tmp_path / "landed")
    found = ingest(spark, path, str(tmp_path / "v"), str(tmp_path / "m"), AS_OF, landed)
    (tmp_path / "s.csv").unlink()
    report = found.report.first()
    assert (report["rows_in"], report["rows_out"], report["non_numeric_cells"]) == (2, 1, 1)
    for frame in (found.report, found.frame, found.master, found.warnings):
        assert "FileScan csv" not in frame._jdf.queryExecution().executedPlan().toString()
    again = validate.validate(spark.read.parquet(landed), AS_OF)
    assert [r["name"] for r in again.frame.collect()] == ["A"]


def test_headers_of_all_files_are_reported(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "whole.csv", [row("A")])
    short = [h for h in REQUIRED_HEADERS if h not in ("Sector", "ISIN")]
    write_csv(folder / "short.csv", [], [*short, 'a "quoted", one', "isin"])
    (folder / "blank.csv").write_text("\n\n")
    found = validate.header_report(read_header_rows(spark, str(folder)))
    assert sorted((r.file.rsplit("/", 1)[1], r.kind, r.header) for r in found.collect()) == [
        ("short.csv", "extra", 'a "quoted", one'), ("short.csv", "extra", "isin"),
        ("short.csv", "missing", "ISIN"), ("short.csv", "missing", "Sector")]


def test_validated_csv_copy_is_in_file_order(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", [row(f"N{i}", f"C{i}", f"I{i}") for i in range(20)])
    frame = validate.dedupe_isin(read_fundamentals(spark, path).frame)
    sinks.write_validated(frame, str(tmp_path / "v"), str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    names = [line.split(",")[0] for p in parts for line in p.read_text().splitlines()[1:]]
    assert names == [f"N{i}" for i in range(20)]


def test_files_with_other_header_orders_are_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", [row("A", "A1", "IN1", **{"Debt to Equity": "1"})])
    assert read_fundamentals(spark, str(folder)).frame.count() == 1
    swapped = [*REQUIRED_HEADERS]
    i, j = swapped.index("Debt to Equity"), swapped.index("Return on Capital Employed")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    write_csv(folder / "b.csv", [row("B", "B1", "IN2", **{"Debt to Equity": "2"})], swapped)
    with pytest.raises(Exception, match=r"b\.csv|a\.csv"):
        read_fundamentals(spark, str(folder)).frame.collect()


@pytest.mark.parametrize("text, day", [
    ("2024-03-31T00:00:00", 31), ("31-Mar-2024", 31), ("31 Mar 2024", 31), ("Mar 2024", 1), ("2024-3-1", 1),
    ("March 2024", 1), ("31 March 2024", 31), ("31.03.2024", 31), ("3/31/2024", 31), ("1/3/2024", 1), ("2024-03-31T00:00:00Z", 31),
    ("20240331", 31), ("202403", 1)])
def test_more_spellings_of_dates(spark, tmp_path, text, day):
    path = write_csv(tmp_path / "d.csv", [row("A", **{"Last quarterly result date": text})])
    assert read_fundamentals(spark, path).frame.first()["last_quarterly_result_date"] == datetime(2024, 3, day)


def test_unread_dates_are_listed_and_counted(spark, tmp_path):
    rows = [row("A", "A1", "IN1", **{"Last quarterly result date": "31/31/2024", "Last annual result date": "soon"}),
            row("B", "B1", "IN2", **{"Last quarterly result date": "NA"})]
    frame = read_fundamentals(spark, write_csv(tmp_path / "d.csv", rows)).frame
    assert sorted(tuple(r) for r in date_warnings(frame).collect()) == [("A1", "Last annual result date"), ("A1", "Last quarterly result date")]
    assert validate.report(frame, AS_OF).first().unparsed_dates_cells == 2


def test_master_survives_what_a_crashed_write_left(spark, tmp_path):
    root = str(tmp_path / "master")
    frame = read_fundamentals(spark, write_csv(tmp_path / "m.csv", [row("A", "A1", "IN1")])).frame
    sinks.update_master(frame, root)
    (tmp_path / "master" / "version=00000002").mkdir()
    (tmp_path / "master" / "version=00000002" / "part-0.parquet").write_text("half")
    assert sinks.update_master(frame, root).count() == 1
    assert sinks.update_master(frame, root, keep=1).count() == 1
    assert sorted(p.name for p in (tmp_path / "master").iterdir() if (p / "_SUCCESS").exists()) == ["version=00000004"]

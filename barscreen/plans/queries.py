"""One query per operator over the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barscreen.functions.text import zones_text
from barscreen.operators import candles as cd
from barscreen.operators import news, rules, signals, symbols, validate, zones
from barscreen.operators.master import incoming_companies, upsert
from barscreen.plans import decisions, screen
from barscreen.plans import warehouse as wh
from barscreen.plans.run import land
from barscreen.schemas import DAILY, FOUR_HOUR, HOURLY, MASTER_FIELDS, REQUIRED_HEADERS, snake
from barscreen.sources import barstates, history, sinks
from barscreen.sources import candles as candle_source
from barscreen.sources.feed import ROW_TAG, read_feed, read_feed_rejects
from barscreen.sources.fundamentals import (
    date_warnings,
    non_numeric_warnings,
    read_fundamentals,
    read_header_rows,
    read_validated,
)
from barscreen.sources.storage import shared_dir
from barscreen.streaming.bars import stream_bars
from barscreen.streaming.feed import start_announcement_stream, stream_feed
from barscreen.streaming.responses import read_rejects, start_response_stream, stream_responses
from barscreen.streaming.signals import start_signal_stream
from barscreen.streaming.stateful import keyed_state, stateful_signals

Query = Callable[[SparkSession, str], DataFrame]

# Instants of the runs: after the last tick, and amid the filings (a month end that clamps).
AS_OF = datetime(2024, 1, 31)
FILED_AS_OF = datetime(1999, 6, 30, 12)
HOURLY_AS_OF = datetime(2024, 1, 20, 12)
STREAM_DELAY = "1 hour"
# The ends of all days on which something was traded.
HISTORY_START, HISTORY_DAYS = datetime(2024, 1, 2), 30

FILING_COLUMNS = [
    "ord", "name", "nse_code", "bse_code", "isin", "industry", "sector",
    "return_on_capital_employed", "debt_to_equity", "altman_z_score", "piotroski_score",
    "last_quarterly_result_date",
]


def _bars(spark: SparkSession, sf_dir: str, interval_min: int) -> DataFrame:
    return cd.resample_ticks(wh.ticks(spark, sf_dir), interval_min)


def _both_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and four-hour bars within the daily look-back; ticks are aggregated once."""
    interval_min, days_back = DAILY
    ticks = cd.recent_ticks(wh.ticks(spark, sf_dir), interval_min, days_back, AS_OF)
    fourh = cd.resample_ticks(ticks, FOUR_HOUR[0])
    return cd.timeframes(fourh, [FOUR_HOUR[0], DAILY[0]])


def _announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.shape_items(wh.announcement_items(spark, sf_dir))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dedupe_isin(wh.filings(spark, sf_dir))


# Candles -------------------------------------------------------------------------------------


def daily_candles(spark, sf_dir):
    return _bars(spark, sf_dir, DAILY[0])


def fourh_candles(spark, sf_dir):
    return _bars(spark, sf_dir, FOUR_HOUR[0])


def hourly_candles(spark, sf_dir):
    return _bars(spark, sf_dir, HOURLY[0])


def daily_from_fourh(spark, sf_dir):
    return cd.rollup_bars(_bars(spark, sf_dir, FOUR_HOUR[0]), DAILY[0])


def lookback_filter(spark, sf_dir):
    return cd.lookback(_bars(spark, sf_dir, HOURLY[0]), [(HOURLY[0], 7)], HOURLY_AS_OF)


def candle_table(spark, sf_dir):
    """Write the candle table and scan it back with its partitions pruned."""
    path = shared_dir(spark, "candles")
    sinks.write_candles(_both_timeframes(spark, sf_dir), path)
    bars = candle_source.read_candles(spark, path, [(DAILY[0], 20), (FOUR_HOUR[0], 5)], AS_OF)
    return bars.select(*cd.KEYS, *cd.VALUES)


def candle_table_append(spark, sf_dir):
    """Land the bars of three halves: early days, late ones, and a day of both restated."""
    path = shared_dir(spark, "candles-grown")
    bars = _bars(spark, sf_dir, DAILY[0])
    early, late = F.col("ts") <= F.lit("2024-01-16"), F.col("ts") >= F.lit("2024-01-14")
    sinks.write_candles(bars.where(late), path)
    restated = bars.where(early).withColumn("close", F.col("close") + 1)
    sinks.write_candles(restated.unionByName(restated), path)
    found = candle_source.read_candles(spark, path, [DAILY], AS_OF)
    return found.select(*cd.KEYS, *cd.VALUES)


def late_ticks_merged(spark, sf_dir):
    """Daily bars whose ticks land in three parts, which have most bars in common.

    The candle table gets the bars that each landing touched; no tick is read twice.
    """
    root, path = shared_dir(spark, "bar-states"), shared_dir(spark, "candles-merged-ticks")
    ticks = wh.ticks(spark, sf_dir)
    for version in range(3):
        barstates.land_ticks(ticks.where(F.col("seq") % 3 == version), root, version, DAILY[0])
        if version == 1:
            barstates.compact(spark, root, up_to=1)
        sinks.write_candles(barstates.touched_states(spark, root, after=version - 1), path)
    found = candle_source.read_candles(spark, path, [DAILY], AS_OF)
    return found.select(*cd.KEYS, *cd.VALUES)


def daily_candles_as_of(spark, sf_dir):
    """Daily bars as they stood in the middle of a day."""
    recent = cd.recent_ticks(wh.ticks(spark, sf_dir), DAILY[0], 7, HOURLY_AS_OF)
    return cd.lookback(cd.resample_ticks(recent, DAILY[0]), [(DAILY[0], 7)], HOURLY_AS_OF)


def restated_bars(spark, sf_dir):
    """Every event restates its instrument's daily bar; the last one landed stands."""
    events = wh.table(spark, sf_dir, "events")
    value = F.col("value")
    landed = events.select(
        F.col("user_id").cast("string").alias("symbol"),
        F.lit(DAILY[0]).alias("interval_min"),
        F.to_date("ts").cast("timestamp_ntz").alias("ts"),
        value.alias("open"),
        (value + 1).alias("high"),
        (value - 1).alias("low"),
        (value * 2).alias("close"),
        F.col("event_id").alias("volume"),
        F.col("event_id").alias("ord"),
    )
    return cd.dedupe_bars(landed)


# Of every ten instruments, by the last digit of the number, one is delivered with times in
# milliseconds and one without volumes.
MILLISECONDS, NO_VOLUME = "3", "7"
# One has its line cut in the middle.
CUT = "5"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed response per instrument: its daily bars within the look-back.

    Some responses are malformed, as named by the two digits above; the source must reject them.
    The look-back bounds the length of every collected list.
    """
    bars = cd.lookback(_bars(spark, sf_dir, DAILY[0]), [DAILY], AS_OF)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    prices = [F.col(v) for v in ("open", "high", "low", "close")]
    candle = F.array(seconds, *prices, F.col("volume").cast("double"))
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("ts", candle.alias("candle")))),
        lambda e: e["candle"],
    )
    digit = F.right("symbol", F.lit(1))

    def milliseconds(candle: Column) -> Column:
        return F.transform(candle, lambda x, i: F.when(i == 0, x * 1000).otherwise(x))

    return bars.groupBy("symbol", "interval_min").agg(listed.alias("candles")).withColumn(
        "candles",
        F.when(digit == MILLISECONDS, F.transform("candles", milliseconds))
        .when(digit == NO_VOLUME, F.transform("candles", lambda c: F.slice(c, 1, 5)))
        .otherwise(F.col("candles")),
    )


def _response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses as (symbol, value), one of ten cut in the middle."""
    line = F.to_json(F.struct("symbol", "interval_min", "candles"))
    half = F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))
    cut = F.when(F.right("symbol", F.lit(1)) == CUT, half).otherwise(line)
    return _responses(spark, sf_dir).select("symbol", cut.alias("value"))


def _landed_responses(spark: SparkSession, sf_dir: str) -> candle_source.Responses:
    path = shared_dir(spark, "responses")
    _response_lines(spark, sf_dir).select("value").write.text(path)
    return candle_source.parse_responses(candle_source.read_responses(spark, path))


def candle_responses(spark, sf_dir):
    bars = _landed_responses(spark, sf_dir).candles
    return bars.select(
        "symbol", "interval_min", F.col("ts").cast("timestamp_ntz").alias("ts"), *cd.VALUES,
        F.col("ord").cast("bigint").alias("ord"),
    )


def bad_candle_series(spark, sf_dir):
    return _landed_responses(spark, sf_dir).bad_series


def landing_rejects(spark, sf_dir):
    """Instruments whose lines could not be read, by what is left of them."""
    record = F.col("record")
    return _landed_responses(spark, sf_dir).rejects.select(
        F.regexp_extract(record, r'"symbol":"([0-9]+)"', 1).alias("symbol"),
        record.endswith("}").alias("is_whole"))


def _streamed_responses(spark: SparkSession, sf_dir: str) -> str:
    """A folder below which the responses of two polls went through the stream, one poll after the other."""
    path = shared_dir(spark, "response-stream")
    lines = _response_lines(spark, sf_dir)
    second = F.pmod(F.xxhash64("symbol"), F.lit(2)) == 1
    for number, poll in enumerate((lines.where(~second), lines.where(second))):
        poll.select("value").write.text(f"{path}/landed/poll{number}")
        landed = stream_responses(spark, f"{path}/landed/*")
        start_response_stream(landed, f"{path}/candles", path, f"{path}/checkpoint").awaitTermination()
    return path


def response_stream_candles(spark, sf_dir):
    """The candle table after both polls."""
    path = _streamed_responses(spark, sf_dir)
    found = candle_source.read_candles(spark, f"{path}/candles", [DAILY], AS_OF, unfinished=True)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*cd.KEYS, *cd.VALUES)


def response_stream_rejects(spark, sf_dir):
    """The lines of both polls that could not be read, each once."""
    record = F.col("record")
    return read_rejects(spark, _streamed_responses(spark, sf_dir)).select(
        F.regexp_extract(record, r'"symbol":"([0-9]+)"', 1).alias("symbol"), record.endswith("}").alias("is_whole"))


# Signals and zones ---------------------------------------------------------------------------


def _latest(name: str) -> Query:
    def query(spark, sf_dir):
        return signals.latest(_bars(spark, sf_dir, DAILY[0])).select("symbol", "ts", name)

    return query


def signal_history(spark, sf_dir):
    return signals.history(_bars(spark, sf_dir, DAILY[0]))


def signal_history_fourh(spark, sf_dir):
    """Four-hour series cut into weekly pieces."""
    return signals.history(_bars(spark, sf_dir, FOUR_HOUR[0]), split_bars=42)


def latest_signals_fourh(spark, sf_dir):
    return signals.latest(_bars(spark, sf_dir, FOUR_HOUR[0]))


def _kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history table brought up to date twice: the first days with some bars wrong, then these restated and the rest."""
    candles, path = shared_dir(spark, "history-candles"), shared_dir(spark, "history")
    bars = _bars(spark, sf_dir, DAILY[0])
    early = F.col("ts") <= F.lit("2024-01-20")
    wrong = F.col("ts").between(F.lit("2024-01-08"), F.lit("2024-01-09"))
    close = F.when(wrong, F.col("close") + 1).otherwise(F.col("close"))
    for landed in (bars.where(early).withColumn("close", close), bars.where(wrong | ~early)):
        sinks.write_candles(landed, candles)
        history.update_history(spark, candles, path, landed, margin_days=4)
    return spark.read.parquet(path)


def signal_history_append(spark, sf_dir):
    return history.signals_of(_kept_history(spark, sf_dir))


def order_blocks_append(spark, sf_dir):
    return history.order_blocks_of(_kept_history(spark, sf_dir))


def fair_value_gaps_append(spark, sf_dir):
    return history.gaps_of(_kept_history(spark, sf_dir))


def order_blocks(spark, sf_dir):
    return zones.order_blocks(_bars(spark, sf_dir, DAILY[0]))


def fair_value_gaps(spark, sf_dir):
    return zones.fair_value_gaps(_bars(spark, sf_dir, DAILY[0]))


def technical_profile(spark, sf_dir):
    recent = cd.lookback(_both_timeframes(spark, sf_dir), [DAILY, FOUR_HOUR], AS_OF)
    profile = screen.technical_profile(recent, split_bars=None)
    return profile.select(
        "symbol", "daily_bars", "fourh_bars", "daily_trend", "daily_bos", "fourh_bos",
        "daily_choch",
        zones_text("order_blocks").alias("order_blocks"),
        zones_text("daily_fvg").alias("daily_fvg"),
        "fourh_liq_sweep",
    )


# Fundamentals --------------------------------------------------------------------------------


def validation_report(spark, sf_dir):
    return validate.report(wh.filings(spark, sf_dir), FILED_AS_OF)


def stale_companies(spark, sf_dir):
    stale = validate.stale_rows(wh.filings(spark, sf_dir), FILED_AS_OF)
    return stale.select("ord", "nse_code", "isin", "last_quarterly_result_date")


def missing_codes(spark, sf_dir):
    filings = wh.filings(spark, sf_dir)
    return filings.agg(
        F.count_if(F.col("nse_code").isNull()).alias("missing_nse"),
        F.count_if(F.col("bse_code").isNull()).alias("missing_bse"),
        F.count_if(F.col("isin").isNull()).alias("missing_isin"),
        F.coalesce(F.bool_or(F.col("bse_code").isNull()), F.lit(False)).alias("has_missing_bse"),
    )


def dedupe_isin(spark, sf_dir):
    return _validated(spark, sf_dir).select(*FILING_COLUMNS)


def dedupe_keep_null_isin(spark, sf_dir):
    frame = validate.dedupe_isin(wh.filings(spark, sf_dir), keep_null_isin=True)
    return frame.select(*FILING_COLUMNS)


def distinct_symbols(spark, sf_dir):
    return symbols.distinct_symbols(_validated(spark, sf_dir))


def symbol_count(spark, sf_dir):
    listed = symbols.distinct_symbols(_validated(spark, sf_dir))
    return listed.agg(F.count(F.lit(1)).alias("n_symbols"))


def symbol_head(spark, sf_dir):
    return symbols.head(symbols.distinct_symbols(_validated(spark, sf_dir)), 10)


def _csv_cells(filings: DataFrame) -> DataFrame:
    """Filings under the required headers, as a data vendor would export them."""
    given = {
        "Name": "name", "NSE Code": "nse_code", "BSE Code": "bse_code", "ISIN": "isin",
        "Industry": "industry", "Sector": "sector",
        "Return on Capital Employed": "return_on_capital_employed",
        "Debt to Equity": "debt_to_equity", "Altman Z Score": "altman_z_score",
        "Piotroski score": "piotroski_score",
    }
    quarter = F.date_format("last_quarterly_result_date", "yyyy-MM-dd")
    special: dict[str, Column] = {
        "Last quarterly result date": F.when(F.col("bse_code").isNull(), F.lit("pending"))
        .otherwise(quarter),
        "NSE Code": F.concat(F.lit(" "), F.col("nse_code"), F.lit(" ")),
        "Interest Coverage Ratio": F.when(F.col("isin").isNull(), F.lit("n.m.")),
    }
    cells = []
    for header in REQUIRED_HEADERS:
        cell = special.get(header)
        if cell is None:
            cell = F.col(given[header]) if header in given else F.lit(None).cast("string")
        cells.append(cell.alias(header))
    return filings.select(*cells, F.col("ord").alias("Serial"))


def _written_csv(cells: DataFrame) -> str:
    path = shared_dir(cells.sparkSession, "fundamentals")
    cells.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _landed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fundamentals(spark, _written_csv(_csv_cells(wh.filings(spark, sf_dir)))).frame


def fundamentals_csv(spark, sf_dir):
    """Land the filings as CSV and read them back typed; `Serial` is an extra column."""
    frame = _landed_csv(spark, sf_dir)
    return frame.select(
        F.col("Serial").cast("bigint").alias("ord"),
        "name", "nse_code", "bse_code", "isin",
        *[snake(h) for h in ("Return on Capital Employed", "Debt to Equity",
                             "Interest Coverage Ratio")],
        "last_quarterly_result_date",
        F.size("non_numeric").alias("bad_cells"),
    )


def fundamentals_multi_line(spark, sf_dir):
    """The filings as CSV whose names hold line breaks, quotes and commas, read in splits."""
    name = F.concat("name", F.lit('\n"'), "industry", F.lit('", '), F.lit("\n\n"), "sector")
    cells = _csv_cells(wh.filings(spark, sf_dir).withColumn("name", name))
    frame = read_fundamentals(spark, _written_csv(cells), multi_line=True).frame
    return frame.select(
        F.col("Serial").cast("bigint").alias("ord"), "name", "nse_code", "bse_code", "isin",
        "return_on_capital_employed", "debt_to_equity", "last_quarterly_result_date",
    )


def header_report(spark, sf_dir):
    """Exports of every nation, one file each: some lack a required header, all have an extra one."""
    path = shared_dir(spark, "exports")
    filings = wh.filings(spark, sf_dir)
    # An export names the figures its nation gives, beside the other required headers.
    names = F.array(*[F.lit(h) for h in REQUIRED_HEADERS])
    lacks = F.element_at(names, (F.length("industry") + 1).cast("int"))
    headers = F.filter(names, lambda h: ~((h == lacks) & F.col("short")))
    exports = filings.groupBy("industry").agg((F.count("*") % 2 == 0).alias("short"))
    line = F.concat_ws(",", headers, F.concat(F.lit('"Notes, '), "industry", F.lit('"')))
    exports.select("industry", line.alias("value")).write.partitionBy("industry").text(path)
    found = validate.header_report(read_header_rows(spark, path))
    nation = F.regexp_extract("file", "industry=([^/]*)/", 1)
    return found.select(F.replace(nation, F.lit("%20"), F.lit(" ")).alias("nation"), "header", "kind")


def landed_report(spark, sf_dir):
    """The validation report of a CSV that was parsed once, with the cells that could not be read."""
    landed = land(spark, _written_csv(_csv_cells(wh.filings(spark, sf_dir))))
    return validate.report(landed.frame, FILED_AS_OF)


def fundamentals_warnings(spark, sf_dir):
    """Number cells of the landed CSV that hold other text."""
    return non_numeric_warnings(_landed_csv(spark, sf_dir))


def unparsed_dates(spark, sf_dir):
    """Date cells of the landed CSV that could not be read."""
    return date_warnings(_landed_csv(spark, sf_dir))


def validated_reload(spark, sf_dir):
    """Store the validated table and read it again."""
    path = shared_dir(spark, "validated")
    sinks.write_validated(_validated(spark, sf_dir), path)
    return read_validated(spark, path).select(*FILING_COLUMNS)


def validated_csv_reload(spark, sf_dir):
    """Store the landed rows as CSV too, under their headers, and land that copy again."""
    path = shared_dir(spark, "validated-csv")
    sinks.write_validated(_landed_csv(spark, sf_dir), f"{path}/table", f"{path}/csv")
    frame = read_fundamentals(spark, f"{path}/csv").frame
    return frame.select(
        F.col("Serial").cast("bigint").alias("ord"), "name", "nse_code", "bse_code", "isin",
        "return_on_capital_employed", "debt_to_equity", "last_quarterly_result_date",
    )


PROFILE_FIELDS = ["roce", "de_ratio", "altman_z", "piotroski_score"]


def _profile(mapping: str) -> Query:
    def query(spark, sf_dir):
        coded = _validated(spark, sf_dir).where(F.col("nse_code").isNotNull())
        first = validate.first_per_key(coded, "nse_code")
        profile = rules.fundamental_profile(first, mapping)
        return profile.select(F.col("nse_code").alias("symbol"), *PROFILE_FIELDS)

    return query


# Master --------------------------------------------------------------------------------------


def master_upsert(spark, sf_dir):
    existing = wh.known_companies(spark, sf_dir)
    return upsert(existing, incoming_companies(wh.filings(spark, sf_dir)))


def master_table(spark, sf_dir):
    """Three versions of the stored master: suppliers, the filings, the filings again."""
    root = shared_dir(spark, "master")
    known = wh.known_companies(spark, sf_dir).select(
        F.xxhash64("isin").alias("ord"),
        "isin", "name",
        F.col("symbol_nse").alias("nse_code"), F.col("symbol_bse").alias("bse_code"),
        "sector", "industry",
    )
    sinks.update_master(known, root)
    sinks.update_master(wh.filings(spark, sf_dir), root)
    return sinks.update_master(wh.filings(spark, sf_dir), root).select("isin", *MASTER_FIELDS)


# Announcements -------------------------------------------------------------------------------


def announcement_symbol(spark, sf_dir):
    shaped = _announcements(spark, sf_dir)
    return shaped.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def classify_announcements(spark, sf_dir):
    classified = news.classify(_announcements(spark, sf_dir))
    return classified.select("feed_ord", "symbol", "title", "event_type", "sentiment")


def first_announcement(spark, sf_dir):
    found = news.first_announcement(_announcements(spark, sf_dir))
    return found.select("symbol", "feed_ord", "title", "event_type", "sentiment")


def event_profile(spark, sf_dir):
    listed = symbols.distinct_symbols(_validated(spark, sf_dir)).select("symbol")
    profile = news.event_profile(listed, _announcements(spark, sf_dir))
    return profile.select("symbol", "sentiment", "title")


def _land_feed(items: DataFrame, path: str) -> None:
    document = items.select("title", "link", "pubDate")
    document.write.option("rootTag", "channel").option("rowTag", ROW_TAG).xml(path)


def announcement_feed(spark, sf_dir):
    """Land the feed as XML documents and read the items back."""
    path = shared_dir(spark, "feed")
    _land_feed(wh.announcement_items(spark, sf_dir), path)
    shaped = news.classify(news.shape_items(read_feed(spark, path)))
    return shaped.select("symbol", "title", "link", "date", "event_type", "sentiment")


def _broken_feed(spark: SparkSession, sf_dir: str) -> str:
    """A folder of feed documents in which every seventh item has a wrong closing tag and no document has an end."""
    path = shared_dir(spark, "broken-feed")
    items = wh.announcement_items(spark, sf_dir)
    tags = [F.concat(F.lit(f"<{c}>"), c, F.lit(f"</{c}>")) for c in ("title", "link", "pubDate")]
    end = F.when(F.col("feed_ord") % 7 == 0, "</itm>").otherwise(f"</{ROW_TAG}>")
    items.select(F.concat(F.lit(f"<{ROW_TAG}>"), *tags, end).alias("value")).write.text(path)
    return path


def feed_rejects(spark, sf_dir):
    """The items that could not be read, by their links."""
    rejects = read_feed_rejects(spark, _broken_feed(spark, sf_dir)).where("pos > 0")
    return rejects.select(F.regexp_extract("record", "<link>(.*?)</link>", 1).alias("link"), F.col("record").endswith("</item>").alias("is_whole"))


def feed_beside_rejects(spark, sf_dir):
    """The items around the broken ones."""
    shaped = news.classify(news.shape_items(read_feed(spark, _broken_feed(spark, sf_dir))))
    return shaped.select("symbol", "title", "link", "date", "event_type", "sentiment")


# Screen --------------------------------------------------------------------------------------


def _assessed(spark: SparkSession, sf_dir: str, mapping: str = "corrected") -> DataFrame:
    return screen.assess(
        _both_timeframes(spark, sf_dir),
        _validated(spark, sf_dir),
        _announcements(spark, sf_dir),
        AS_OF,
        mapping=mapping,
        split_bars=None,  # the bars are resampled here, so the look-back bounds every series
    )


def evaluate_candidates(spark, sf_dir):
    assessed = _assessed(spark, sf_dir).where(F.col("cause").isNull())
    return assessed.select(
        "symbol", "decision", "veto_reason", F.concat_ws("; ", "reasons").alias("reasons"),
        F.size("reasons").cast("bigint").alias("n_reasons"),
    )


def assembled_profiles(spark, sf_dir):
    """The three profiles of every listed symbol side by side, failed ones included."""
    return _assessed(spark, sf_dir).select(
        "symbol", *PROFILE_FIELDS, "daily_trend", "daily_bos", "daily_bars", "fourh_bars",
        "sentiment", "title", "cause",
    )


def evaluate_with_slots(spark, sf_dir):
    """The rules with the two open slots filled: the last order block, a change of character."""
    recent = cd.lookback(_both_timeframes(spark, sf_dir), [DAILY, FOUR_HOUR], AS_OF)
    filled = screen.technical_profile(recent, split_bars=None).withColumns(
        {
            "fourh_order_block": F.try_element_at("order_blocks", F.lit(-1)),
            "fourh_liq_sweep": F.col("daily_choch"),
        }
    )
    return rules.evaluate(filled).select(
        "symbol", "decision", F.concat_ws("; ", "reasons").alias("reasons")
    )


def shortlist(spark, sf_dir):
    return screen.shortlist(_assessed(spark, sf_dir)).select("ord", "symbol", "line")


def shortlist_as_of(spark, sf_dir):
    """The shortlist as it was at a moment amid the ticks, from what had been traded and announced by then."""
    moment = F.lit(HOURLY_AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    events = wh.table(spark, sf_dir, "events").where(F.col("ts") <= moment)
    ticks = cd.recent_ticks(wh.tick_columns(events), DAILY[0], DAILY[1], HOURLY_AS_OF)
    bars = cd.timeframes(cd.resample_ticks(ticks, FOUR_HOUR[0]), [FOUR_HOUR[0], DAILY[0]])
    announced = news.shape_items(wh.announcement_columns(events))
    assessed = screen.assess(bars, _validated(spark, sf_dir), announced, HOURLY_AS_OF, split_bars=None)
    return screen.shortlist(assessed).select("ord", "symbol", "line")


def decision_history(spark, sf_dir):
    """Decisions of every listed symbol at the end of every day, from the bars ended and the news out by then."""
    bars = cd.timeframes(_bars(spark, sf_dir, FOUR_HOUR[0]), [FOUR_HOUR[0], DAILY[0]])
    moments = decisions.Moments(HISTORY_START, HISTORY_DAYS)
    decided = decisions.decision_history(bars, _validated(spark, sf_dir), _announcements(spark, sf_dir), moments)
    return decided.where(F.col("cause").isNull()).select(
        "symbol", "moment", "decision", "veto_reason", F.concat_ws("; ", "reasons").alias("reasons"))


def shortlist_literal(spark, sf_dir):
    return screen.shortlist(_assessed(spark, sf_dir, "literal")).select("ord", "symbol", "line")


def failures(spark, sf_dir):
    """Every instrument that trades or files is asked for; some have no filing, some no bars."""
    traded = wh.ticks(spark, sf_dir).groupBy("symbol").agg(F.min("seq").alias("ord"))
    filed = symbols.distinct_symbols(_validated(spark, sf_dir))
    asked = traded.unionByName(filed).groupBy("symbol").agg(F.min("ord").alias("ord"))
    assessed = screen.assess(
        _both_timeframes(spark, sf_dir),
        _validated(spark, sf_dir),
        _announcements(spark, sf_dir),
        AS_OF,
        symbols=asked,
        bad_series=_landed_responses(spark, sf_dir).bad_series,
        split_bars=None,
    )
    return screen.failures(assessed)


# Streams -------------------------------------------------------------------------------------


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return wh.tick_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def _run_to_end(df: DataFrame, path: str) -> None:
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_candles(spark, sf_dir):
    """Four-hour bars of all ticks as a stream: every bar the watermark has closed."""
    path = shared_dir(spark, "stream-candles")
    _run_to_end(stream_bars(_tick_stream(spark, sf_dir), FOUR_HOUR[0], STREAM_DELAY), path)
    bars = spark.read.parquet(f"{path}/out")
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*cd.KEYS, *cd.VALUES)


def stream_announcements_query(spark, sf_dir):
    """Two polls of the whole feed, a few files at a time; every announcement comes out once."""
    path = shared_dir(spark, "stream-feed")
    items = wh.announcement_items(spark, sf_dir)
    for poll in ("poll1", "poll2"):
        _land_feed(items, f"{path}/landed/{poll}")
    stream = stream_feed(spark, f"{path}/landed/*", files_per_trigger=1)
    start_announcement_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.select("symbol", "title", "link", "event_type", "sentiment")


def stream_signals(spark, sf_dir):
    """Daily bars closed on a stream, with their signals."""
    path = shared_dir(spark, "stream-signals")
    bars = stream_bars(_tick_stream(spark, sf_dir), DAILY[0], STREAM_DELAY)
    start_signal_stream(
        bars, f"{path}/out", f"{path}/state", f"{path}/checkpoint"
    ).awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.select(
        "symbol", "interval_min", F.col("ts").cast("timestamp_ntz").alias("ts"), *signals.SIGNALS
    )


def stream_signals_stateful(spark, sf_dir):
    """The same with keyed state: only series that have bars in a batch are read and written."""
    path = shared_dir(spark, "stream-signals-stateful")
    bars = stream_bars(_tick_stream(spark, sf_dir), DAILY[0], STREAM_DELAY)
    with keyed_state(spark):
        _run_to_end(stateful_signals(bars), path)
    found = spark.read.parquet(f"{path}/out")
    return found.select(
        "symbol", "interval_min", F.col("ts").cast("timestamp_ntz").alias("ts"), *signals.SIGNALS
    )


QUERIES: dict[str, Query] = {
    "daily_candles": daily_candles,
    "fourh_candles": fourh_candles,
    "hourly_candles": hourly_candles,
    "daily_from_fourh": daily_from_fourh,
    "lookback_filter": lookback_filter,
    "candle_table": candle_table,
    "candle_table_append": candle_table_append,
    "daily_candles_as_of": daily_candles_as_of,
    "restated_bars": restated_bars,
    "candle_responses": candle_responses,
    "bad_candle_series": bad_candle_series,
    "landing_rejects": landing_rejects,
    "latest_trend": _latest("trend"),
    "latest_bullish_bos": _latest("bullish_bos"),
    "latest_bearish_bos": _latest("bearish_bos"),
    "latest_bullish_choch": _latest("bullish_choch"),
    "latest_signals_fourh": latest_signals_fourh,
    "signal_history": signal_history,
    "signal_history_fourh": signal_history_fourh,
    "order_blocks": order_blocks,
    "fair_value_gaps": fair_value_gaps,
    "technical_profile": technical_profile,
    "validation_report": validation_report,
    "stale_companies": stale_companies,
    "missing_codes": missing_codes,
    "dedupe_isin": dedupe_isin,
    "dedupe_keep_null_isin": dedupe_keep_null_isin,
    "distinct_symbols": distinct_symbols,
    "symbol_count": symbol_count,
    "symbol_head": symbol_head,
    "fundamentals_csv": fundamentals_csv,
    "fundamentals_multi_line": fundamentals_multi_line,
    "header_report": header_report,
    "landed_report": landed_report,
    "fundamentals_warnings": fundamentals_warnings,
    "unparsed_dates": unparsed_dates,
    "validated_reload": validated_reload,
    "validated_csv_reload": validated_csv_reload,
    "fundamental_profile": _profile("corrected"),
    "fundamental_profile_literal": _profile("literal"),
    "master_upsert": master_upsert,
    "master_table": master_table,
    "announcement_symbol": announcement_symbol,
    "classify_announcements": classify_announcements,
    "first_announcement": first_announcement,
    "event_profile": event_profile,
    "announcement_feed": announcement_feed,
    "assembled_profiles": assembled_profiles,
    "evaluate_candidates": evaluate_candidates,
    "evaluate_with_slots": evaluate_with_slots,
    "shortlist": shortlist,
    "shortlist_literal": shortlist_literal,
    "failures": failures,
    "stream_candles": stream_candles,
    "stream_announcements": stream_announcements_query,
    "stream_signals": stream_signals,
    "stream_signals_stateful": stream_signals_stateful,
    "shortlist_as_of": shortlist_as_of,
    "feed_rejects": feed_rejects,
    "feed_beside_rejects": feed_beside_rejects,
    "signal_history_append": signal_history_append,
    "order_blocks_append": order_blocks_append,
    "fair_value_gaps_append": fair_value_gaps_append,
    "response_stream_candles": response_stream_candles,
    "response_stream_rejects": response_stream_rejects,
    "late_ticks_merged": late_ticks_merged,
    "decision_history": decision_history,
}

"""The queries of `barscreen.plans.queries` as SQL over the same tables."""

from __future__ import annotations

from barscreen.schemas import REQUIRED_HEADERS

HEADER_LIST = "[" + ", ".join(f"'{h}'" for h in REQUIRED_HEADERS) + "]"
TICKS = """ticks as (
  select cast(user_id as varchar) as symbol, ts, event_id as seq, value as price from events)"""


def _bar_start(minutes: int) -> str:
    if minutes == 1440:
        return "cast(date_trunc('day', ts) as timestamp)"
    return f"time_bucket(interval '{minutes} minutes', ts, timestamp '1970-01-01')"


def _bars(minutes: int, name: str = "bars") -> str:
    return f"""{name} as (
  select symbol, {minutes} as interval_min, {_bar_start(minutes)} as ts,
         arg_min(price, row(ts, seq)) as open, max(price) as high, min(price) as low,
         arg_max(price, row(ts, seq)) as close, count(*) as volume
  from ticks group by 1, 2, 3)"""


CANDLE_COLUMNS = "symbol, interval_min, ts, open, high, low, close, volume"


def _candles(minutes: int) -> str:
    return f"with {TICKS}, {_bars(minutes)} select {CANDLE_COLUMNS} from bars"


def _lagged(source: str, name: str = "lagged") -> str:
    """Bars with the look-ups of the signals."""
    return f"""{name} as (
  select *,
    row_number() over w as pos,
    lag(high) over w as high1, lag(low) over w as low1, lag(close) over w as close1,
    lag(high, 2) over w as high2, lag(low, 2) over w as low2, lag(low, 3) over w as low3,
    max(high) over (w rows between 5 preceding and 1 preceding) as swing_high,
    min(low) over (w rows between 5 preceding and 1 preceding) as swing_low,
    lead(open) over w as open_n, lead(close) over w as close_n,
    lead(high) over w as high_n, lead(low) over w as low_n,
    lead(ts) over w is not null as has_next1, lead(ts, 2) over w is not null as has_next2
  from {source} window w as (partition by symbol, interval_min order by ts))"""


TREND = """case when pos = 1 then null
  when high > high1 and low > low1 then 'Bullish'
  when high < high1 and low < low1 then 'Bearish' else 'Neutral' end"""
BULLISH_BOS = "coalesce(close > swing_high, false)"
BEARISH_BOS = "coalesce(close < swing_low, false)"
BULLISH_CHOCH = """coalesce(pos >= 3
  and close1 < case when pos >= 4 then low3 else least(low2, low1, low) end
  and close > high2, false)"""
BLOCK_KIND = """case when close < open and close_n > open_n then 'bullish'
  when close > open and close_n < open_n then 'bearish' end"""


def _signals(source: str = "lagged") -> str:
    return f"""select symbol, interval_min, ts, {TREND} as trend, {BULLISH_BOS} as bullish_bos,
  {BEARISH_BOS} as bearish_bos, {BULLISH_CHOCH} as bullish_choch from {source}"""


def _latest(name: str, expression: str) -> str:
    return f"""with {TICKS}, {_bars(1440)}, {_lagged("bars")}
select symbol, ts, {expression} as {name} from lagged where not has_next1"""


GAPS = """gaps as (
  select symbol, interval_min, ts, 1 as n, 'up' as kind, high as zone_low, low_n as zone_high
  from lagged where has_next2 and low_n > high
  union all
  select symbol, interval_min, ts, 2, 'down', high_n, low
  from lagged where has_next2 and high_n < low)"""

ZONE_TEXT = "'(' || cast({0} as varchar) || ', ' || cast({1} as varchar) || ')'"


def _zone_list(low: str, high: str, order: str) -> str:
    text = ZONE_TEXT.format(low, high)
    return f"'[' || string_agg({text}, ', ' order by {order}) || ']'"


# Daily and four-hour bars within the look-backs of the screen.
RECENT = f"""{TICKS}, {_bars(1440, "daily")}, {_bars(240, "fourh")}, recent as (
  select * from daily where ts between timestamp '2024-01-31' - interval 365 day
                                   and timestamp '2024-01-31'
  union all
  select * from fourh where ts between timestamp '2024-01-31' - interval 90 day
                                   and timestamp '2024-01-31')"""

TECHNICAL = f"""{RECENT}, {_lagged("recent")}, {GAPS},
blocks as (
  select symbol, {_zone_list("low", "high", "ts")} as order_blocks
  from lagged where interval_min = 1440 and {BLOCK_KIND} is not null group by 1),
gap_lists as (
  select symbol, {_zone_list("zone_low", "zone_high", "ts, n")} as daily_fvg
  from gaps where interval_min = 1440 group by 1),
technical as (
  select l.symbol, count(*) filter (where interval_min = 1440) as daily_bars,
    count(*) filter (where interval_min = 240) as fourh_bars,
    max({TREND}) filter (where interval_min = 1440 and not has_next1) as daily_trend,
    bool_or({BULLISH_BOS}) filter (where interval_min = 1440 and not has_next1) as daily_bos,
    bool_or({BULLISH_BOS}) filter (where interval_min = 240 and not has_next1) as fourh_bos,
    bool_or({BULLISH_CHOCH}) filter (where interval_min = 1440 and not has_next1) as daily_choch,
    any_value(b.order_blocks) as order_blocks, any_value(g.daily_fvg) as daily_fvg
  from lagged l left join blocks b on b.symbol = l.symbol
  left join gap_lists g on g.symbol = l.symbol
  group by 1)"""

FILINGS = """filings as (
  select coalesce(o_orderkey, -1 - c_custkey) as ord,
    concat_ws(' ', c_name, o_orderpriority) as name,
    cast(c_custkey as varchar) as nse_code,
    case when o_orderstatus <> 'P' then cast(c_custkey + 500000 as varchar) end as bse_code,
    case when c_acctbal >= 0 then 'IN' || lpad(cast(c_custkey as varchar), 10, '0') end as isin,
    n_name as industry, r_name as sector,
    o_totalprice / 20000 as return_on_capital_employed,
    c_acctbal / 4000 as debt_to_equity,
    o_totalprice / 100000 as altman_z_score,
    n_nationkey / cast(2.5 as double) as piotroski_score,
    o_orderdate as last_quarterly_result_date
  from customer join nation on n_nationkey = c_nationkey
  join region on r_regionkey = n_regionkey
  left join orders on o_custkey = c_custkey)"""
FILING_COLUMNS = """ord, name, nse_code, bse_code, isin, industry, sector,
  return_on_capital_employed, debt_to_equity, altman_z_score, piotroski_score,
  last_quarterly_result_date"""
VALIDATED = f"""{FILINGS}, validated as (
  select * from filings
  qualify row_number() over (partition by isin order by ord) = 1)"""
LISTED = """listed as (select nse_code as symbol, min(ord) as ord from validated
  where nse_code is not null group by 1)"""
FIRST_FILED = """filed as (
  select * from validated where nse_code is not null
  qualify row_number() over (partition by nse_code order by ord) = 1)"""
STALE_LIMIT = "timestamp '1999-06-30 12:00:00' - interval 4 month"

ITEMS = """items as (
  select -event_id as feed_ord,
    case when event_type = 'signup' and value < 10 then 'Exchange circular'
      else cast(user_id as varchar) || ': ' || case event_type
        when 'purchase' then 'Board approves Dividend'
        when 'view' then 'Quarterly Results declared'
        when 'error' then 'Debt restructure and loss'
        when 'click' then 'Board Meeting on Buyback'
        else 'General update' end end as title,
    'https://example.org/a/' || cast(event_id as varchar) as link,
    strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' as date,
    date_trunc('second', ts) as published_at
  from events)"""
SYMBOL = "case when contains(title, ':') then split_part(title, ':', 1) else '' end"


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(title), '{w}')" for w in words) + ")"


def _classified(event_type: bool) -> str:
    pick = 0 if event_type else 1
    outcomes = [
        (["buyback", "bonus", "dividend"], ("Corporate Action", "Positive")),
        (["board meeting", "results", "quarterly"], ("Results", "Neutral")),
        (["debt", "fall", "restructure", "loss"], ("Fundamental", "Negative")),
    ]
    cases = " ".join(f"when {_any(words)} then '{out[pick]}'" for words, out in outcomes)
    return f"case {cases} else '{('General', 'Neutral')[pick]}' end"


ANNOUNCED = f"""{ITEMS}, announced as (
  select feed_ord, {SYMBOL} as symbol, title, link, date, published_at,
    {_classified(True)} as event_type, {_classified(False)} as sentiment from items),
first_announced as (
  select * from announced qualify row_number() over (partition by symbol order by feed_ord) = 1)"""


def _decisions(roce: str, debt: str) -> str:
    """Decisions of all symbols that trade long enough."""
    return f"""with {TECHNICAL}, {VALIDATED}, {FIRST_FILED}, {ANNOUNCED}, joined as (
  select f.ord, f.nse_code as symbol, {roce} as roce, {debt} as de_ratio,
    f.altman_z_score as altman_z, f.piotroski_score, t.* exclude (symbol),
    coalesce(a.sentiment, 'Neutral') as sentiment, coalesce(a.title, '') as title
  from filed f join technical t on t.symbol = f.nse_code
  left join first_announced a on a.symbol = f.nse_code
  where t.daily_bars >= 2 and t.fourh_bars >= 1),
reasoned as (
  select *, sentiment = 'Negative' as veto, [x for x in [
      case when roce < 10 or de_ratio > 2 then 'Weak fundamentals (ROCE<10% or D/E>2)' end,
      case when altman_z < 1.8 then 'Altman Z-Score low (distress sign)' end,
      case when piotroski_score >= 7 then 'High Piotroski Score (quality)' end,
      case when daily_trend = 'Bullish' then 'Daily uptrend' end,
      case when daily_bos then 'Daily BOS confirmed' end,
      case when daily_fvg is not null then 'Fair Value Gap at ' || daily_fvg end,
      case when sentiment = 'Positive' then 'Positive news/announcement' end
    ] if x is not null] as found
  from joined),
decided as (
  select ord, symbol,
    case when not veto and (daily_bos or sentiment = 'Positive') then 'Buy' else 'Hold' end
      as decision,
    case when veto then 'Negative news: ' || title end as veto_reason,
    case when veto then '' else array_to_string(found, '; ') end as reasons,
    case when veto then 0 else len(found) end as n_reasons
  from reasoned)"""


CORRECTED = _decisions("f.return_on_capital_employed", "f.debt_to_equity")
LITERAL = _decisions("0.0", "0.0")
SHORTLIST = """select ord, symbol, symbol || ': ' || reasons as line
from decided where decision = 'Buy'"""


def _profile(roce: str, debt: str) -> str:
    return f"""with {VALIDATED}, {FIRST_FILED}
select nse_code as symbol, {roce} as roce, {debt} as de_ratio, altman_z_score as altman_z,
  piotroski_score from filed"""


MASTER_ROWS = f"""{FILINGS}, known as (
  select 'IN' || lpad(cast(s_suppkey as varchar), 10, '0') as isin, s_name as name,
    case when s_acctbal > 5000 then cast(s_suppkey as varchar) end as symbol_nse,
    case when s_acctbal > 2000 then cast(s_suppkey + 900000 as varchar) end as symbol_bse,
    cast(null as varchar) as sector,
    case when s_nationkey > 12 then 'SUPPLY' end as industry
  from supplier),
placed as (
  select isin, name, symbol_nse, symbol_bse, sector, industry, 0 as rank, 0 as ord from known
  union all
  select isin, name, nse_code, bse_code, sector, industry, 1, ord from filings
  where isin is not null)"""
MASTER = f"""with {MASTER_ROWS}
select isin, """ + ", ".join(
    f"arg_min({f}, row(rank, ord)) filter (where {f} is not null) as {f}"
    for f in ("name", "symbol_nse", "symbol_bse", "sector", "industry")
) + " from placed group by 1"

# What the delivered responses of the daily series look like.
DELIVERED = f"""{TICKS}, {_bars(1440)}, delivered as (
  select *, row_number() over (partition by symbol order by ts) - 1 as ord from bars)"""
BAD = "right(symbol, 1) in ('3', '7')"

CLOSED = "<= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)"

ORACLE: dict[str, str] = {
    "daily_candles": _candles(1440),
    "fourh_candles": _candles(240),
    "hourly_candles": _candles(60),
    "daily_from_fourh": _candles(1440),
    "lookback_filter": _candles(60)
    + " where ts between timestamp '2024-01-13 12:00:00' and timestamp '2024-01-20 12:00:00'",
    "candle_table": f"""with {TICKS}, {_bars(1440, "daily")}, {_bars(240, "fourh")}
select {CANDLE_COLUMNS} from daily where ts between timestamp '2024-01-11' and timestamp '2024-01-31'
union all
select {CANDLE_COLUMNS} from fourh where ts between timestamp '2024-01-26' and timestamp '2024-01-31'""",
    "candle_table_append": f"""with {TICKS}, {_bars(1440)}
select symbol, interval_min, ts, open, high, low,
  case when ts <= timestamp '2024-01-16' then close + 1 else close end as close, volume
from bars where ts between timestamp '2024-01-31' - interval 365 day and timestamp '2024-01-30'""",
    # What a request for the seven days up to that moment would have brought.
    "daily_candles_as_of": f"""with known as (
  select * from events where ts <= timestamp '2024-01-20 12:00:00'), {TICKS.replace("from events", "from known")}, {_bars(1440)}
select {CANDLE_COLUMNS} from bars where ts >= timestamp '2024-01-20 12:00:00' - interval 7 day""",
    "restated_bars": """select cast(user_id as varchar) as symbol, 1440 as interval_min,
  cast(date_trunc('day', ts) as timestamp) as ts, value as open, value + 1 as high, value - 1 as low,
  value * 2 as close, event_id as volume
from events qualify row_number() over (
  partition by user_id, date_trunc('day', ts) order by event_id desc) = 1""",
    "candle_responses": f"""with {DELIVERED}
select {CANDLE_COLUMNS}, ord from delivered where not {BAD} and right(symbol, 1) <> '5'""",
    "bad_candle_series": f"""with {DELIVERED}
select distinct symbol, interval_min from delivered where {BAD}""",
    "landing_rejects": f"""with {DELIVERED}
select distinct symbol, false as is_whole from delivered where right(symbol, 1) = '5'""",
    "latest_trend": _latest("trend", TREND),
    "latest_bullish_bos": _latest("bullish_bos", BULLISH_BOS),
    "latest_bearish_bos": _latest("bearish_bos", BEARISH_BOS),
    "latest_bullish_choch": _latest("bullish_choch", BULLISH_CHOCH),
    "latest_signals_fourh": f"""with {TICKS}, {_bars(240)}, {_lagged("bars")}, last_bars as (
  select * from lagged where not has_next1)
{_signals("last_bars")}""",
    "signal_history": f"with {TICKS}, {_bars(1440)}, {_lagged('bars')} {_signals()}",
    "signal_history_fourh": f"with {TICKS}, {_bars(240)}, {_lagged('bars')} {_signals()}",
    "order_blocks": f"""with {TICKS}, {_bars(1440)}, {_lagged("bars")}
select symbol, interval_min, ts, {BLOCK_KIND} as kind, low as zone_low, high as zone_high
from lagged where {BLOCK_KIND} is not null""",
    "fair_value_gaps": f"""with {TICKS}, {_bars(1440)}, {_lagged("bars")}, {GAPS}
select symbol, interval_min, ts, kind, zone_low, zone_high from gaps""",
    "technical_profile": f"""with {TECHNICAL}
select symbol, daily_bars, fourh_bars, daily_trend, daily_bos, fourh_bos, daily_choch,
  coalesce(order_blocks, '[]') as order_blocks, coalesce(daily_fvg, '[]') as daily_fvg,
  false as fourh_liq_sweep from technical""",
    "validation_report": f"""with {FILINGS}, counts as (
  select count(*) as rows_in,
    count(*) filter (where last_quarterly_result_date < {STALE_LIMIT}) as stale_count,
    count(*) filter (where nse_code is null) as missing_code_count,
    count(distinct isin) + max(case when isin is null then 1 else 0 end) as rows_out from filings)
select *, missing_code_count > 0 as has_missing_code, rows_in > rows_out as has_duplicates
from counts""",
    "stale_companies": f"""with {FILINGS}
select ord, nse_code, isin, last_quarterly_result_date from filings
where last_quarterly_result_date < {STALE_LIMIT}""",
    "missing_codes": f"""with {FILINGS}
select count(*) filter (where nse_code is null) as missing_nse,
  count(*) filter (where bse_code is null) as missing_bse,
  count(*) filter (where isin is null) as missing_isin,
  bool_or(bse_code is null) as has_missing_bse from filings""",
    "dedupe_isin": f"with {VALIDATED} select {FILING_COLUMNS} from validated",
    "dedupe_keep_null_isin": f"""with {FILINGS}
select {FILING_COLUMNS} from filings
qualify isin is null or row_number() over (partition by isin order by ord) = 1""",
    "distinct_symbols": f"with {VALIDATED}, {LISTED} select symbol, ord from listed",
    "symbol_count": f"""with {VALIDATED}, {LISTED}
select count(*) as n_symbols from listed""",
    "symbol_head": f"""with {VALIDATED}, {LISTED}
select symbol, ord from listed order by ord limit 10""",
    "fundamentals_csv": f"""with {FILINGS}
select ord, name, nse_code, bse_code, isin, return_on_capital_employed, debt_to_equity,
  cast(null as double) as interest_coverage_ratio,
  case when bse_code is not null then last_quarterly_result_date end as last_quarterly_result_date,
  case when isin is null then 1 else 0 end as bad_cells from filings""",
    "fundamentals_multi_line": f"""with {FILINGS}
select ord, name || chr(10) || '"' || industry || '", ' || chr(10) || chr(10) || sector as name,
  nse_code, bse_code, isin, return_on_capital_employed, debt_to_equity,
  case when bse_code is not null then last_quarterly_result_date end as last_quarterly_result_date
from filings""",
    "header_report": f"""with {FILINGS}, exports as (
  select industry as nation, count(*) % 2 = 0 as short from filings group by 1)
select nation, {HEADER_LIST}[length(nation) + 1] as header, 'missing' as kind from exports where short
union all select nation, 'Notes, ' || nation, 'extra' from exports""",
    "landed_report": f"""with {FILINGS}, counts as (
  select count(*) as rows_in,
    count(*) filter (where bse_code is not null and last_quarterly_result_date < {STALE_LIMIT}) as stale_count,
    count(*) filter (where nse_code is null) as missing_code_count,
    count(distinct isin) + max(case when isin is null then 1 else 0 end) as rows_out,
    count(*) filter (where isin is null) as non_numeric_cells,
    count(*) filter (where bse_code is null) as unparsed_dates_cells from filings)
select *, missing_code_count > 0 as has_missing_code, rows_in > rows_out as has_duplicates
from counts""",
    "fundamentals_warnings": f"""with {FILINGS}
select nse_code as symbol, 'Interest Coverage Ratio' as header from filings
where isin is null""",
    "unparsed_dates": f"""with {FILINGS}
select nse_code as symbol, 'Last quarterly result date' as header from filings
where bse_code is null""",
    "validated_reload": f"with {VALIDATED} select {FILING_COLUMNS} from validated",
    "validated_csv_reload": f"""with {FILINGS}
select ord, name, nse_code, bse_code, isin, return_on_capital_employed, debt_to_equity,
  case when bse_code is not null then last_quarterly_result_date end as last_quarterly_result_date
from filings""",
    "fundamental_profile": _profile("return_on_capital_employed", "debt_to_equity"),
    "fundamental_profile_literal": _profile("cast(0 as double)", "cast(0 as double)"),
    "master_upsert": MASTER,
    "master_table": MASTER,
    "announcement_symbol": f"""with {ITEMS}
select feed_ord, {SYMBOL} as symbol, title, link, date, published_at from items""",
    "classify_announcements": f"""with {ANNOUNCED}
select feed_ord, symbol, title, event_type, sentiment from announced""",
    "first_announcement": f"""with {ANNOUNCED}
select symbol, feed_ord, title, event_type, sentiment from first_announced""",
    "event_profile": f"""with {VALIDATED}, {LISTED}, {ANNOUNCED}
select l.symbol, coalesce(sentiment, 'Neutral') as sentiment, coalesce(title, '') as title
from listed l left join first_announced a on a.symbol = l.symbol""",
    "announcement_feed": f"""with {ANNOUNCED}
select symbol, title, link, date, event_type, sentiment from announced""",
    "assembled_profiles": f"""with {TECHNICAL}, {VALIDATED}, {FIRST_FILED}, {ANNOUNCED}
select f.nse_code as symbol, f.return_on_capital_employed as roce, f.debt_to_equity as de_ratio,
  f.altman_z_score as altman_z, f.piotroski_score, t.daily_trend, t.daily_bos, t.daily_bars,
  t.fourh_bars, coalesce(a.sentiment, 'Neutral') as sentiment, coalesce(a.title, '') as title,
  case when coalesce(t.daily_bars, 0) < 2 then 'short_daily'
    when coalesce(t.fourh_bars, 0) < 1 then 'no_4h_bars' end as cause
from filed f left join technical t on t.symbol = f.nse_code
left join first_announced a on a.symbol = f.nse_code""",
    "evaluate_candidates": f"""{CORRECTED}
select symbol, decision, veto_reason, reasons, n_reasons from decided""",
    "evaluate_with_slots": f"""with {TECHNICAL}, last_blocks as (
  select symbol, arg_max(low, ts) as block_low, arg_max(high, ts) as block_high
  from lagged where interval_min = 1440 and {BLOCK_KIND} is not null group by 1)
select t.symbol, case when daily_bos then 'Buy' else 'Hold' end as decision,
  array_to_string([x for x in [
    'Weak fundamentals (ROCE<10% or D/E>2)', 'Altman Z-Score low (distress sign)',
    case when daily_trend = 'Bullish' then 'Daily uptrend' end,
    case when daily_bos then 'Daily BOS confirmed' end,
    case when daily_choch then '4H liquidity sweep detected' end,
    case when block_low is not null
      then 'Order block at ' || {ZONE_TEXT.format("block_low", "block_high")} end,
    case when daily_fvg is not null then 'Fair Value Gap at ' || daily_fvg end
  ] if x is not null], '; ') as reasons
from technical t left join last_blocks b on b.symbol = t.symbol""",
    "shortlist": f"{CORRECTED} {SHORTLIST}",
    "shortlist_literal": f"{LITERAL} {SHORTLIST}",
    "failures": f"""with {TECHNICAL}, {VALIDATED}, {LISTED}, asked as (
  select symbol from listed union select symbol from ticks),
delivered as (select distinct symbol from daily),
causes as (
  select k.symbol, case
      when {BAD.replace('symbol', 'd.symbol')} then 'bad_candle_row'
      when coalesce(t.daily_bars, 0) < 2 then 'short_daily'
      when coalesce(t.fourh_bars, 0) < 1 then 'no_4h_bars'
      when l.symbol is null then 'no_fundamentals' end as cause
  from asked k left join delivered d on d.symbol = k.symbol
  left join technical t on t.symbol = k.symbol
  left join listed l on l.symbol = k.symbol)
select symbol, cause from causes where cause is not null""",
    "stream_candles": f"""with {TICKS}, {_bars(240)}
select {CANDLE_COLUMNS} from bars where ts + interval 240 minute {CLOSED}""",
    "stream_announcements": f"""with {ANNOUNCED}
select symbol, title, link, event_type, sentiment from announced""",
    "stream_signals": f"""with {TICKS}, {_bars(1440)}, closed as (
  select * from bars where ts + interval 1440 minute {CLOSED}), {_lagged("closed")}
{_signals()}""",
}
ORACLE["stream_signals_stateful"] = ORACLE["stream_signals"]
# What had been traded and announced by a moment amid the ticks.
MOMENT = "timestamp '2024-01-20 12:00:00'"
ORACLE["shortlist_as_of"] = (
    ORACLE["shortlist"].replace("from events", f"from (select * from events where ts <= {MOMENT})").replace("timestamp '2024-01-31'", MOMENT)
)
ORACLE["feed_rejects"] = f"""with {ITEMS}
select link, false as is_whole from items where feed_ord % 7 = 0"""
ORACLE["feed_beside_rejects"] = f"{ORACLE['announcement_feed']} where feed_ord % 7 <> 0"
for _kept in ("signal_history", "order_blocks", "fair_value_gaps"):
    ORACLE[f"{_kept}_append"] = ORACLE[_kept]
ORACLE["response_stream_candles"] = f"""with {DELIVERED}
select {CANDLE_COLUMNS} from delivered where not {BAD} and right(symbol, 1) <> '5'"""
ORACLE["response_stream_rejects"] = ORACLE["landing_rejects"]
ORACLE["late_ticks_merged"] = f"{_candles(1440)} where ts between timestamp '2024-01-31' - interval 365 day and timestamp '2024-01-30'"

# Decisions at the end of every day: the moment goes in front of every symbol, and what it does not know is left out.
AT = "cast(moment as varchar) || '|' || symbol"
RECENT_BY_DAY = f"""{TICKS}, {_bars(1440, "daily")}, {_bars(240, "fourh")}, moments as (
  select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-31', interval 1 day)) as moment),
recent as (
  select daily.* replace ({AT} as symbol) from daily join moments
    on ts + interval 1 day <= moment and ts >= moment - interval 365 day
  union all
  select fourh.* replace ({AT} as symbol) from fourh join moments
    on ts + interval 4 hour <= moment and ts >= moment - interval 90 day)"""
FILED_BY_DAY = f"""once as ({FIRST_FILED.removeprefix("filed as (").removesuffix(")")}),
filed as (select once.* replace ({AT.replace('symbol', 'nse_code')} as nse_code) from once, moments)"""
ANNOUNCED_BY_DAY = ANNOUNCED[: ANNOUNCED.index("first_announced")] + f"""known as (
  select announced.* replace ({AT} as symbol) from announced join moments on published_at <= moment),
first_announced as (
  select * from known qualify row_number() over (partition by symbol order by feed_ord) = 1)"""
ORACLE["decision_history"] = (
    CORRECTED.replace(RECENT, RECENT_BY_DAY).replace(FIRST_FILED, FILED_BY_DAY).replace(ANNOUNCED, ANNOUNCED_BY_DAY)
    + """
select split_part(symbol, '|', 2) as symbol, cast(split_part(symbol, '|', 1) as timestamp) as moment,
  decision, veto_reason, reasons from decided"""
)

"""`python -m barscreen --fundamentals stocks.csv --feed feed/ --responses candles/ --out run/`"""

from __future__ import annotations

import argparse
from datetime import datetime

from barscreen import build_session, running_session
from barscreen.plans.run import ingest, screen_stored
from barscreen.sources.sinks import shortlist_lines


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barscreen", description="Screen listed companies.")
    parser.add_argument("--fundamentals", required=True, help="CSV file or folder")
    parser.add_argument("--feed", required=True, help="folder of landed announcement documents")
    candles = parser.add_mutually_exclusive_group(required=True)
    candles.add_argument("--candles", help="candle table written by write_candles")
    candles.add_argument("--responses", help="folder of landed candle responses (JSON lines)")
    parser.add_argument("--feed-ledger", help="folder that keeps when feed documents landed")
    parser.add_argument("--out", required=True, help="folder of the run's results")
    parser.add_argument("--master", help="company master folder (default: OUT/master)")
    parser.add_argument("--as-of", default=datetime.now().isoformat(timespec="seconds"))
    parser.add_argument("--mapping", choices=["corrected", "literal"], default="corrected")
    parser.add_argument("--local", action="store_true", help="own local session, as for tests")
    args = parser.parse_args(argv)

    spark = build_session() if args.local else running_session()
    validated = f"{args.out}/validated"
    ingested = ingest(
        spark, args.fundamentals, validated, args.master or f"{args.out}/master", args.as_of
    )
    report = ingested.report.first()
    print(", ".join(f"{name}: {report[name]}" for name in report.asDict()))
    screened = screen_stored(
        spark, validated, args.feed, args.as_of, args.out,
        candle_table=args.candles, responses=args.responses, mapping=args.mapping,
        feed_ledger=args.feed_ledger,
    )
    print(f"Unreadable announcements: {spark.read.parquet(f'{args.out}/feed_rejects').count()}")
    if args.responses is not None:
        print(f"Unreadable lines: {spark.read.parquet(f'{args.out}/rejects').count()}")
    screened.failures.write.mode("overwrite").parquet(f"{args.out}/failures")
    for row in screened.failures.groupBy("cause").count().orderBy("cause").collect():
        print(f"Failed, {row['cause']}: {row['count']}")
    print("Final shortlist:")
    for line in shortlist_lines(screened.shortlist):
        print(line)


if __name__ == "__main__":
    main()

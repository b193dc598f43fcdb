"""Equity screening on Spark DataFrames: fundamentals, candles, announcements, decisions."""

from barscreen.session import build_session, running_session

__all__ = ["build_session", "running_session"]

"""Structured Streaming versions of the candle, announcement and signal operators."""

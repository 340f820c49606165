"""Interval-driven data flows on Spark: read, route, number, convert, reload, stream."""

"""Streams of raw rows and reference texts: the same operators, stateless but for the dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from accessio.operators.evidence import classify_rows
from accessio.operators.identifiers import extract_identifiers


def classify_stream(raw: DataFrame, patterns: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Evidence rows of a stream of raw rows against a static pattern table.

    With an event time, a record met again for a strain within the delay is dropped.
    """
    if event_time:
        raw = raw.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["ncppb_number", "ncbi_uid"])
    return classify_rows(raw, patterns, carry=(event_time,) if event_time else ())


def identifier_stream(rows: DataFrame, key: str = "ncppb_number", text: str = "other_references") -> DataFrame:
    """Identifier rows of a stream of reference texts."""
    return extract_identifiers(rows, key, text)

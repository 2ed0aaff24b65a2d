"""Frames over streams: stateless operators work on a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.frame import Frame


def stream_frame(df: DataFrame, index: str | tuple[str, ...] = ()) -> Frame:
    """A frame without an order over a streaming DataFrame: projection, filters, membership, nulls, casts, explode and groups."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    return Frame(df, index)

"""Streaming use of the batch operators.

The engine's jobs are batch jobs. Tumbling downsampling is the one operator
that also fits an unbounded series, since it is a window plus mergeable
aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.operators.aggregate import downsample


def downsample_stream(
    stream: DataFrame, width: str, lateness: str, *, key: str = "participant_id", ts_col: str = "timestamp"
) -> DataFrame:
    """``downsample`` on a stream; windows close once the watermark passes them."""
    return downsample(stream.withWatermark(ts_col, lateness), width, key=key, ts_col=ts_col)

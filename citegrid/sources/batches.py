"""Arrow batches in Python workers: small pieces, and their rows as pandas frames and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of at most limit bytes, or of one row, so that what is made of them is small at any time."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), limit)
        yield from pieces(batch.slice(half), limit)


def frame_of(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as mapInPandas shows it: dates as objects, maps as dictionaries, times without a zone in that of the session."""
    out = batch.to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True, maps_as_pydicts="lossy")
    zoned = [f.name for f in batch.schema if pa.types.is_timestamp(f.type) and f.type.tz]
    return out.assign(**{c: out[c].dt.tz_localize(None) for c in zoned})


def batch_of(frame: pd.DataFrame, schema: pa.Schema, zone: str) -> pa.RecordBatch:
    """A frame's columns as a batch of the schema; times without a zone are in the given one."""

    def column(f: pa.Field) -> pa.Array:
        values = frame[f.name]
        if values.isna().all():
            return pa.nulls(len(values), f.type)
        if pa.types.is_timestamp(f.type) and f.type.tz:
            values = pd.to_datetime(values)
            values = values if values.dt.tz else values.dt.tz_localize(zone)
        return pa.Array.from_pandas(values, type=f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)

"""Rows on their way through Python: what is carried along, and the text that is read."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, carry: Column | None, name: str) -> DataFrame:
    """`carry` as `name`, and text. Without carry the whole row travels as one struct, text included, so that no column of docs can
    clash with ours and no text travels twice."""
    if carry is None:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    return docs.select(carry.alias(name), "text")


def text_column(batch: pa.RecordBatch) -> pa.Array:
    """The text column of a batch of carried() rows."""
    return batch.column(1) if batch.num_columns > 1 else pc.struct_field(batch.column(0), "text")


def byte_texts(batch: pa.RecordBatch) -> pa.Array:
    """The same as UTF-8 bytes, without a copy."""
    found = text_column(batch)
    return found.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary())

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at once besides the Arrow batch it came in.
STEP_BYTES = 4 << 20


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns of the input can never clash."""
    return df.select(*[column(source).alias(own) for own, source in names.items()])


def text_key(text: str = "text") -> Column:
    """64-bit key that tells apart rows which share an id. A null text has the key of the empty text."""
    return F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")))


def steps(batches: Iterable[pa.RecordBatch], column_name: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about `size` bytes of text; one very long text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch, column_name))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(batch: pa.RecordBatch, name: str) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle of the operator's own: what the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

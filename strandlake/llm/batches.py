"""Running a numpy function over a text column, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are held in numpy form at one time.
CHUNK_BYTES = 256 << 10
#: Rows of an Arrow batch: whole texts may be long, so batches are small.
BATCH_ROWS = 1000


def chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list]]:
    """(first row, values) of consecutive rows of at most `limit` bytes, one row at least."""
    first, values, held = 0, [], 0
    for k, value in enumerate(column.to_pylist()):
        size = len(value) if value is not None else 0
        if values and held + size > limit:
            yield first, values
            first, values, held = k, [], 0
        values.append(value)
        held += size
    if values:
        yield first, values


def small_batches(df: DataFrame) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS; results don't depend on it."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def with_columns(
    df: DataFrame,
    text: str,
    function: Callable[[list], dict[str, np.ndarray | list]],
    schema: str,
    keep: list[str],
    as_bytes: bool = True,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """`keep` columns of `df` and the columns that `function` makes of whole texts.

    `function` gets a list of bytes (or str) values, nulls as None, and returns one value a row
    for each name in `schema`. Rows stay in their partitions: there is no shuffle.
    """
    wanted = [part.split() for part in schema.split(",")]
    names = [name for name, _ in wanted]
    clash = set(names) & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    kept = text in keep
    value = F.col(f"`{text}`")
    own = [F.col(f"`{k}`") for k in keep]
    narrow = df.select(*own) if kept else df.select(*own, (value.cast("binary") if as_bytes else value).alias("__text"))
    place = keep.index(text) if kept else len(keep)
    small_batches(df)
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    out = pa.schema([pa.field(n, types[t]) for n, t in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            if kept and as_bytes:
                column = column.cast(pa.binary())
            for first, values in chunks(column, limit):
                made = function(values)
                old = [batch.column(k).slice(first, len(values)) for k in range(len(keep))]
                new = [pa.array(made[f.name], type=f.type, from_pandas=True) for f in out]
                yield pa.RecordBatch.from_arrays(old + new, names=[*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in keep]
    return narrow.mapInArrow(run, ", ".join(fields + [f"`{n}` {t}" for n, t in wanted]))

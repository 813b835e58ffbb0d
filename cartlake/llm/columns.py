"""Reading text columns inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of any name neither clash nor travel."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))


#: Bytes of a batch that are worked on at once: what Python copies of it stays of that order, whatever a batch holds.
PART_BYTES = 4 << 20


def parts(batches: Iterable[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes (of single rows where these are larger), without the empty ones."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if rows > 1 and part.nbytes > 2 * size:
                yield from parts([part], size)
            else:
                yield part


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict[str, list] | pa.RecordBatch]], schema: str | StructType, *, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` for a function from a part of a batch to any number of batches; ``done`` is called when a task's input ends."""
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in parts(batches):
                for out in work(part):
                    yield out if isinstance(out, pa.RecordBatch) else record(out, kinds)
        finally:
            if done is not None:
                done()

    return df.mapInArrow(run, schema)


def _arrow(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def record(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in kinds], schema=kinds)

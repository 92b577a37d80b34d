"""Columns computed in Python tasks and put beside the rows they were computed from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Gets the input column of a batch, gives the new columns in blocks of consecutive rows, all rows in order.
Blocks = Callable[[pa.Array], Iterator[list[pa.Array]]]


def add_columns(docs: DataFrame, value: Column, added: dict[str, DataType], blocks: Callable[[], Blocks]) -> DataFrame:
    """The rows with further columns that `blocks()`, made once a task, computes from `value`.

    Columns of these names are replaced (whatever their case). Rows travel as one struct, so that no name can clash.
    """
    taken = {name.lower() for name in added}
    kept = [c for c in docs.columns if c.lower() not in taken]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias("")).alias("row"),
                         value.alias("value"))
    schema = StructType([packed.schema["row"]])
    for i, kind in enumerate(added.values()):
        schema = schema.add(f"added{i}", kind)
    names = schema.names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = blocks()
        for batch in batches:
            start = 0
            for arrays in compute(batch.column(1)):
                rows = batch.column(0).slice(start, len(arrays[0]))
                start += len(rows)
                yield pa.RecordBatch.from_arrays([rows, *arrays], names)

    found = packed.mapInArrow(mapped, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(f"added{i}").alias(n) for i, n in enumerate(added)])

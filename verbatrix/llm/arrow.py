"""Arrow batch plumbing of the Python-side operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """df through fn, which gets and gives column dictionaries (name -> list) batch by batch; one Arrow hop each way."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (dict(zip(b.schema.names, (c.to_pylist() for c in b.columns))) for b in batches if b.num_rows)
        for out in fn(columns):
            if any(len(v) for v in out.values()):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


__all__ = ["map_batches", "pa", "pc"]

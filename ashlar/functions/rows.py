"""Parsers that follow pointers run as Arrow maps: a file in, its rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(df: DataFrame, inputs: list[str], parse: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """``inputs`` of each row go to ``parse``, which gives dictionaries of ``schema``. Output goes on in batches of 1000 rows."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                for row in parse(*(c[i].as_py() for c in columns)):
                    held.append(row)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.select(*inputs).mapInArrow(run, kind)

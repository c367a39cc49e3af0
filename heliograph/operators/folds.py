"""Ordered folds per key, for what is sequential by nature.

Rows are dealt by key and sorted, then read as a stream: memory holds one state, whatever a key's number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], added: str) -> DataFrame:
    """Each row with the columns that ``step(state, row)`` returns besides the next state; a key's first state is ``start()``."""
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    arrow, key_names = to_arrow_schema(schema), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key_names)
                if now != key:
                    key, state = now, start()
                state, more = step(state, row)
                out.append(row | more)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

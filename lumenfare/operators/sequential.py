"""Folds over each key's rows in order, for keys of any length.

Rows are shuffled once on the key and sorted within partitions (spilling where they must); a task then walks its
partition with one key's state at a time, so that memory follows an Arrow batch and never a key or a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship


def fold_sorted(rows: DataFrame, key: str, order: list[str | Column], step: Callable, schema: str) -> DataFrame:
    """(key, *schema): a row for each of rows, by step(state or None, row values after the key) -> (state, result values).

    rows: key, then the columns that step takes. A null key is a key of its own; no rows give none.
    """
    kind = StructType([rows.schema[key], *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, made = step(state, *values)
                out.append((k, *made))
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ship(rows.sparkSession)
    dealt = rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, kind)

"""Order-dependent logic per group, without a call into Python for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH_ROWS = 8192


def per_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[Iterator[dict]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """Apply ``solve`` to the rows of each group, in order, as an iterator of dicts; it gives tuples of ``schema``.

    One shuffle by the keys and one sort; groups then stream through the partition, so thousands of small groups cost no
    more than their rows, and a group is held only as far as ``solve`` holds it.
    """
    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)
    names, arrow = df.columns, to_arrow_schema(schema)
    key_of = itemgetter(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, row)) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out = (row for _, group in groupby(rows, key_of) for row in solve(group))
        while part := list(islice(out, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

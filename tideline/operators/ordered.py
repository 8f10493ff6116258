"""Folds over the rows of each key in order, for recurrences that no window function expresses.

Rows are dealt by key and sorted, and stream through a task in Arrow batches; only the state of the key at hand is
held. So memory doesn't follow a key's rows; its time does, as a recurrence reads one row after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, key: str, order: list[str], reads: list[str], start: Callable[[], object], step: Callable[..., tuple], out: str) -> DataFrame:
    """``rows`` with the columns ``out`` (a schema) added: ``step(state, *values of reads)`` returns the new state and
    their values. ``start`` makes the state before a key's first row. Nulls come first; null keys are one key."""
    added = StructType.fromDDL(out)
    schema = StructType([*rows.schema.fields, *added.fields])
    fields = to_arrow_schema(added)
    at = rows.columns.index(key)
    places = [rows.columns.index(c) for c in reads]

    def run(batches: Iterable[pa.RecordBatch]):
        state, now, begun = None, None, False
        for batch in batches:
            made: list[tuple] = []
            values = zip(*(batch.column(i).to_pylist() for i in places), strict=True)
            for k, row in zip(batch.column(at).to_pylist(), values, strict=True):
                if not begun or k != now:
                    state, now, begun = start(), k, True
                state, new = step(state, *row)
                made.append(new)
            columns = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *fields.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

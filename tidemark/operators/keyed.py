"""Folding sorted rows by key, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_by_key(rows: DataFrame, keys: list[str], order: list[str], make: Callable[..., Callable[[dict], Iterable[dict]]], schema: str) -> DataFrame:
    """Runs a state machine over the rows of each key in order. ``make(*key)`` gives a fresh machine, which takes a row
    as a dict and gives rows of ``schema``.

    Rows are dealt by key, sorted on disk if need be, and streamed: a task holds one machine and one Arrow batch, never
    the rows of a key, so a key with a third of all rows takes time but no memory. The state is sequential by nature, so
    one key is one task's work; keys should be as fine as the state allows.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns
    places = [names.index(k) for k in keys]

    def run(batches):
        current, machine = object(), None
        for batch in batches:
            out: list[dict] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[i] for i in places)
                if key != current:
                    current, machine = key, make(*key)
                out.extend(machine(dict(zip(names, row, strict=True))))
            yield columns_of(out, target)

    # by a hash of the keys: a deal by the keys themselves is left out where a join by them is below, and adaptive execution,
    # which sees no need of the join's deal once it broadcasts the other side, then reads a key in several tasks
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def columns_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; a field that a row lacks is null."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

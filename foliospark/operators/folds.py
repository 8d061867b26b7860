"""Folds whose result depends on the order of a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _listed(c: pa.Array) -> list:
    """to_pylist(), which is slow by the value, of texts and of whole numbers without nulls by way of numpy."""
    plain = pa.types.is_string(c.type) or pa.types.is_integer(c.type) and not c.null_count
    return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()


def streamed(rows: DataFrame, keys: list[str], order: list, begin: Callable[[], Callable[[dict], Iterable[tuple]]], schema: str) -> DataFrame:
    """What step(row) yields for the rows of each key in order; begin() makes the step of a new key.

    One shuffle by the key, then rows stream past: a task never holds a key's rows, only what its step remembers.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step, held = None, None
        for b in batches:
            out, names = [], b.schema.names
            for values in zip(*map(_listed, b.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if step is None or key != held:
                    step, held = begin(), key
                out.extend(step(row))
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

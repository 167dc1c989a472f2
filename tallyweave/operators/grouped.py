"""Order-dependent steps over many small groups, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def by_group(df: DataFrame, key: list[str], order: list, fn: Callable[[list[dict]], list[dict]], schema: T.StructType | str) -> DataFrame:
    """fn over the rows of each group in the given order; a group is whole in one task, the rest streams.

    Rows are shuffled once by key and sorted in the JVM; Python sees Arrow batches and keeps one group at a time.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    names = arrow.names

    def run(batches):
        held: list[dict] = []
        last = None
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if now != last and held:
                    done += fn(held)
                    held = []
                last = now
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in done], schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in fn(held)], schema=arrow)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)


def by_group_lists(df: DataFrame, key: list[str], order: list, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType | str) -> DataFrame:
    """by_group for functions from the columns of a group, as lists, to those of its result: no dict per row is built."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    names = arrow.names

    def run(batches):
        held: dict[str, list] = {}
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            keys = list(zip(*(columns[k] for k in key), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            done: dict[str, list] = {n: [] for n in names}
            for a, b in zip(edges, edges[1:], strict=False):
                part = {c: v[a:b] for c, v in columns.items()}
                if keys[a] == last:
                    for c, v in part.items():
                        held[c] += v
                    continue
                if held:
                    for n, v in fn(held).items():
                        done[n] += v
                held, last = part, keys[a]
            yield pa.RecordBatch.from_pydict(done, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pydict(fn(held), schema=arrow)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)

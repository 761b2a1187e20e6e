"""The N best rows of every group, by secondary sort and streaming.

Every partition is sorted by group, score and identifier where it lies, and its Arrow
batches stream through a filter that counts each row's place in its group; so a
partition passes on at most N rows of a group, however many it holds. What is left is
partitioned by group and goes through the same filter once more. No group
is buffered, and a hot group shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each element from the second on: equal to the one before it, nulls equal to each other."""
    a, b = column[1:], column[:-1]
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _first_rows(n: int, groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            keys = [batch.column(g) for g in groups]
            starts = np.ones(rows, bool)
            if rows > 1:
                starts[1:] = ~np.logical_and.reduce([_same_as_before(k) for k in keys])
            goes_on = last is not None and all(k[0].as_py() == x for k, x in zip(keys, last, strict=True))
            starts[0] = not goes_on
            at = np.arange(rows)
            began = np.maximum.accumulate(np.where(starts, at, -1))
            place = np.where(began < 0, at + seen, at - began)
            last, seen = tuple(k[-1].as_py() for k in keys), int(place[-1]) + 1
            keep = place < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, which should end in a unique identifier so that ties break alike on every run.

    A null in a group column is a value like any other (filter before, if it shouldn't be). Where
    nulls of the score stand is up to the order given. Repeated rows count each. All columns are kept; pass only those
    needed. No rows give no rows; n below 1 gives none. NaN isn't meant for group columns.
    """
    schema = df.schema
    pick = _first_rows(n, groups)
    local = df.sortWithinPartitions(*groups, *order).mapInArrow(pick, schema)
    return local.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(pick, schema)

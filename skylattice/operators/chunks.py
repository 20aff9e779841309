"""Entity chunks: bounded pieces of an ordered sequence, streamed through numpy without a call per group.

A sequence (say an episode) is cut by its order key into chunks of BLOCK consecutive keys. Rows are shuffled by
(entity, chunk), so a sequence that holds a third of all rows is spread over all tasks, and each chunk is small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FLUSH_ROWS = 40_000


def by_chunk(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One shuffle on the chunk keys, then a sort inside each partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers that are equal where the values are equal; null counts as a value of its own (-1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where any column differs from the row before; the first row is True."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def floats(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values with NaN for null, and which are not null."""
    valid = pc.is_valid(column).to_numpy()
    return pc.fill_null(column, float("nan")).to_numpy(), valid


def whole_chunks(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no chunk is cut in two. At most one chunk beyond FLUSH_ROWS rows is held."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < FLUSH_ROWS:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(changes([codes(table[k]) for k in keys]))[-1])
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)

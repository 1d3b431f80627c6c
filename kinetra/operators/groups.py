"""Series in time order for the sequential filters: one exchange by series, one Arrow pass over each partition.

The number of partitions is fixed, since adaptive execution would put a small table into one task, where all series
run on one core. A partition is sorted by series and time; a series that goes over the end of a batch is carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from kinetra.schema import KEY

#: Places of one series that stay (a mask, places, or None for all) and new columns of the rows that stay.
Change = tuple[np.ndarray | None, dict[str, np.ndarray]]
Step = Callable[[dict[str, np.ndarray]], Change]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """First place of every group of a sorted table."""
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        new[1:] = False
    for k in keys:
        codes = _codes(table.column(k))
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' first places; a partition's batches come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key_of = lambda b, i: tuple(b.column(k)[i].as_py() for k in keys)
    for b in batches:
        if not b.num_rows:
            continue
        if held and key_of(held[0], 0) == key_of(b, b.num_rows - 1):
            held.append(b)
            continue
        table = pa.Table.from_batches([*held, b])
        first = starts(table, keys)
        if len(first) > 1:
            yield table.slice(0, int(first[-1])), first[:-1]
        held = table.slice(int(first[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, dtype=np.int64)


def dealt(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def change_series(df: DataFrame, step: Step, columns: tuple[str, ...] = ("at", "pos"), keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """``step`` on the named columns of every series in time order; the other columns go with their rows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, keys):
            values = {c: table.column(c).to_numpy() for c in columns}
            kept: list[np.ndarray] = []
            new: dict[str, list[np.ndarray]] = {}
            for a, z in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                keep, changes = step({c: v[a:z] for c, v in values.items()})
                own = np.arange(a, z)
                kept.append(own if keep is None else own[keep])
                for c, v in changes.items():
                    new.setdefault(c, []).append(v)
            out = table.take(pa.array(np.concatenate(kept)))
            for c, v in new.items():
                at = names.index(c)
                out = out.set_column(at, table.schema.field(at), pa.array(np.concatenate(v), from_pandas=True).cast(table.schema.field(at).type))
            yield from out.to_batches()

    return dealt(df, keys, order).mapInArrow(run, df.schema)


def frames_of(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """``fn`` on a pandas frame of every series in time order, with the columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, keys):
            rows = table.to_pandas()
            found = [fn(rows.iloc[a:z]) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)]
            out = pd.concat([f for f in found if len(f)] or [found[0]])[table.schema.names]
            yield from pa.Table.from_pandas(out, schema=table.schema, preserve_index=False, safe=False).to_batches()

    return dealt(df, keys, order).mapInArrow(run, df.schema)


def grouped(df: DataFrame, keys: tuple[str, ...], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, order: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` on a pandas frame of every group, in as many partitions as shuffles have; a group that goes over the end of a batch is carried on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for rows in frames:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            new = np.zeros(len(rows), dtype=bool)
            for k in keys:
                codes = pd.factorize(rows[k], use_na_sentinel=False)[0]
                new[1:] |= codes[1:] != codes[:-1]
            first = [0, *np.flatnonzero(new).tolist()]
            found = [fn(rows.iloc[a:z]) for a, z in zip(first, first[1:], strict=False)]
            found = [f for f in found if len(f)]
            if found:
                yield pd.concat(found, ignore_index=True)
            held = rows.iloc[first[-1] :]
        if held is not None:
            yield fn(held)

    return dealt(df, keys, order).mapInPandas(run, schema)

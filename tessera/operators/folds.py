"""Folds over each key's rows in order, streamed: only the state of one key is held, never its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pieces(batch: pa.RecordBatch, key: str) -> Iterator[tuple]:
    """The runs of equal keys of a batch: key, rows."""
    codes = pc.fill_null(batch.column(key).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(edges, edges[1:]):
        piece = batch.slice(a, b - a)
        yield piece.column(key)[0].as_py(), piece


def _sorted(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order)


def running(rows: DataFrame, key: str, order: list[str | Column], keep: list[str], new: dict[str, str], begin: Callable, step: Callable) -> DataFrame:
    """The columns `keep` of rows and the new ones (name: type): step(state, rows as an Arrow batch) gives the next state and the lists of the new columns."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for at, piece in _pieces(batch, key) if batch.num_rows else ():
                if state is None or at != last:
                    last, state = at, begin()
                state, made = step(state, piece)
                out.append(made)
            made = [pa.array([x for part in out for x in part[i]], types[t]) for i, t in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *new])

    return _sorted(rows, key, order).mapInArrow(fold, ", ".join(f"`{c}` {t}" for c, t in ({c: fields[c] for c in keep} | new).items()))


def final(rows: DataFrame, key: str, order: list[str | Column], new: dict[str, str], begin: Callable, step: Callable, end: Callable) -> DataFrame:
    """One row for each key: key and end(state), a tuple of the new columns; step(state, rows as an Arrow batch) gives the next state."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}[key]
    types = {"string": pa.string(), "bigint": pa.int64()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out, of_key = None, None, [], None

        def rest() -> pa.RecordBatch:
            made = [pa.array([r[1][i] for r in out], types[t]) for i, t in enumerate(new.values())]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], of_key), *made], [key, *new])

        for batch in batches:
            of_key = batch.schema.field(key).type
            for at, piece in _pieces(batch, key) if batch.num_rows else ():
                if state is None or at != last:
                    if state is not None:
                        out.append((last, end(state)))
                    last, state = at, begin()
                state = step(state, piece)
            if len(out) >= 4096:
                yield rest()
                out = []
        if state is not None:
            out.append((last, end(state)))
            yield rest()

    return _sorted(rows, key, order).mapInArrow(fold, f"`{key}` {kind}, " + ", ".join(f"`{c}` {t}" for c, t in new.items()))


def digests(lines: DataFrame, key: str, line: str, name: str) -> DataFrame:
    """key, name: 16 hex digits of the SHA-256 of each key's lines in order, with newlines between; null lines are left out."""

    def step(state: tuple, rows: pa.RecordBatch) -> tuple:
        digest, some = state
        for x in rows.column(line).to_pylist():
            if x is not None:
                digest.update((("\n" if some else "") + x).encode())
                some = True
        return digest, some

    return final(lines.select(key, line), key, [line], {name: "string"}, lambda: (hashlib.sha256(), False), step, lambda state: (state[0].hexdigest()[:16],))

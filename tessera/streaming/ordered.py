"""Folds over each key's rows in the order of time, on streams: rows wait in state until the watermark has passed them, so what comes out is what the batch gives."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """List state `waiting`: a key's rows that the watermark hasn't passed. Value state `held`: the fold's state as JSON. An event-time timer at the earliest waiting row folds all that are due; a
    timer at the time that `fades` names lets the state go once it means no more than none."""

    def __init__(self, key: str, fields: dict[str, str], order: list[str], keep: list[str], new: dict[str, str], begin: Callable, step: Callable, fades: Callable):
        self.key, self.fields, self.order, self.keep, self.new = key, fields, order, keep, new
        self.begin, self.step, self.fades = begin, step, fades

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"f{i} {t}" for i, t in enumerate(self.fields.values())))
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            some = some[[f"f{i}" for i in range(len(self.fields))]].astype(object)
            some = [tuple(r) for r in some.where(some.notna(), None).itertuples(index=False)]
            if some:
                self.waiting.appendList(some)
                at = min(r[0] for r in some)
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame({c: pd.Series([], dtype=object) for c in [self.key, *self.keep, *self.new]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.fields, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r["_t"] <= now), key=lambda r: tuple(r[c] for c in self.order))
        later = [tuple(r.values()) for r in rows if r["_t"] > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        state = json.loads(self.held.get()[0]) if self.held.exists() else self.begin()
        made: tuple = ()
        if due:
            state, made = self.step(state, pa.RecordBatch.from_pylist(due))
        state, until = self.fades(state, now)
        if state is None:
            self.held.clear()
        else:
            self.held.update((json.dumps(state),))
            if until is not None:
                self.handle.registerTimer(max(until, now) // 1000 + 1)
        out = {self.key: [key[0]] * len(due)} | {c: [r[c] for r in due] for c in self.keep} | dict(zip(self.new, made or [[] for _ in self.new]))
        yield pd.DataFrame({c: pd.Series(list(x), dtype=object) for c, x in out.items()})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, late: str, order: list[str], keep: list[str], new: dict[str, str], begin: Callable, step: Callable, fades: Callable) -> DataFrame:
    """key, keep and new columns of a stream of rows (key, _t in microseconds, others), each when the watermark (`late` behind the greatest time) has passed it; later rows are left out.

    step(state, rows as an Arrow batch) gives the next state and lists of the new columns, as in folds.running(); fades(state, watermark) gives what is left of the state then (None: nothing) and when to look
    again. States are JSON values. They are kept by RocksDB, which the session is set to if it names no other provider.
    """
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, _ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = {"_t": "bigint"} | {c: t for c, t in types.items() if c not in (key, "_t")}
    plain = rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])  # pandas frames of processors rename columns like _t
    timed = plain.withColumn("ts", F.timestamp_micros("f0")).withWatermark("ts", late).filter("f0 is not null")
    schema = ", ".join(f"`{c}` {t}" for c, t in ({c: types[c] for c in [key, *keep]} | new).items())
    return timed.groupBy("k").transformWithStateInPandas(InOrder(key, fields, order, keep, new, begin, step, fades), schema, "append", "eventTime")

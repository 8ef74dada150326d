"""Attempts over an event stream: each key's attempts in order of event time, up to its first success, as a keyed state machine.

Files may come in any order within the watermark's lateness. An attempt waits in state until the watermark has passed it; a timer then lets it go, with its number. After a success a
key keeps its count alone and takes no more, so state is bounded by the lateness and the number of keys. Keys share state by their hash, for each call of a state costs as much as
the work on thousands of attempts: a batch makes a few calls for each of GROUPS groups of keys, however many keys there are."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.shipping import ship

#: From here on a time is no event's: a row with it, whatever its key and order but not without them, closes the stream, for the watermark follows it past all events.
CLOSING = "9999-01-01 00:00:00"
#: Groups of keys that share state, and attempts of a piece of it.
GROUPS, PIECE = 1024, 1 << 16


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state machines need, for the streams that start within."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _packed(rows: pd.DataFrame) -> bytes:
    found = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as writer:
        writer.write_table(found)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(packed)).read_all().to_pandas()


def numbered(rows: pd.DataFrame, told: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Attempts (key, us, id, ok), of keys that have not succeeded, with their round behind those told of their keys (key, round, done), none behind a key's first success; and told
    as it is then."""
    code, keys = pd.factorize(pd.concat([told["key"], rows["key"]], ignore_index=True), use_na_sentinel=False)
    code = code[len(told) :]  # the keys told of come first, each once
    order = np.lexsort((rows["ok"], rows["id"], rows["us"], code))
    rows, code = rows.iloc[order], code[order]
    before, done = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    before[: len(told)], done[: len(told)] = told["round"], told["done"]
    which, start, n = np.unique(code, return_index=True, return_counts=True)
    place = np.arange(len(rows)) - np.repeat(start, n)
    taken = n
    if len(rows):
        taken = np.minimum(np.minimum.reduceat(np.where(rows["ok"], place + 1, len(rows) + 1), start), n)
    succeeded = rows["ok"].to_numpy(bool)[start + taken - 1]
    out = rows.assign(round=place + before[code])[place < np.repeat(taken, n)]
    before[which] += taken
    done[which] = succeeded
    return out, pd.DataFrame({"key": keys, "round": before, "done": done})


class _Attempts(StatefulProcessor):
    """State of a group of keys: the attempts that wait, in pieces; for each key the next one's number and whether one has succeeded; and the time of the timer."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.told = handle.getValueState("told", "keys binary, due long")

    def _state(self) -> tuple[pd.DataFrame | None, int | None]:
        keys, due = self.told.get() if self.told.exists() else (b"", -1)
        return _unpacked(keys) if keys else None, None if due < 0 else due

    def _timed(self, due: int | None, want: int) -> int:
        """A timer for the first attempt that waits. One for a later time may stand beside it: it finds what waits then, or nothing."""
        if due is None or want < due:
            self.handle.registerTimer(want)
            return want
        return due

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told, due = self._state()
        over = None if told is None else told["key"][told["done"]]
        first = None
        for part in rows:
            part = part[[self.names[0], "us", "id", "ok"]].set_axis(["key", "us", "id", "ok"], axis=1)
            if over is not None:
                part = part[~part["key"].isin(over)]
            if len(part):
                self.waiting.appendValue((_packed(part),))
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.told.update((b"" if told is None else _packed(told), self._timed(due, first // 1000 + 1)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        told, _ = self._state()
        pieces = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        if not pieces:
            return
        rows = pd.concat(pieces, ignore_index=True)
        now = rows["us"] <= timerValues.getCurrentWatermarkInMs() * 1000
        out, told = numbered(rows[now], rows[:0].assign(round=0, done=False)[["key", "round", "done"]] if told is None else told)
        left = rows[~now]
        left = left[~left["key"].isin(told["key"][told["done"]])]
        self.waiting.clear()
        due = -1
        if len(left):
            self.waiting.put([(_packed(left[at : at + PIECE]),) for at in range(0, len(left), PIECE)])
            due = self._timed(None, int(left["us"].min()) // 1000 + 1)
        self.told.update((_packed(told), due))
        if len(out):
            yield out[["key", "id", "round", "ok"]].set_axis(self.names, axis=1).reset_index(drop=True)

    def close(self) -> None:
        pass


def attempts(stream: DataFrame, key: str, order: str, time: str, success: str, lateness: str) -> DataFrame:
    """key, order, round, success of a stream's attempts up to each key's first success, or all where none succeeds; numbered from 0 by time, then by order (long).

    Rows later than the watermark allows are lost to it; rows without key, order or time are no attempts, a null success is none, repeated rows are attempts each. Rows at CLOSING only move the
    watermark. Needs the RocksDB state store."""
    spark = stream.sparkSession
    ship(spark)
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    # Spark moves what it can of this below the watermark, but not what is about the time: closing rows get that far.
    rows = timed.where((F.col("_at") < F.lit(CLOSING).cast("timestamp")) & F.col(key).isNotNull() & F.col(order).isNotNull())
    typed = rows.select(F.col(key), F.unix_micros("_at").alias("us"), F.col(order).cast("long").alias("id"), F.coalesce(F.col(success), F.lit(False)).alias("ok"), "_at", F.pmod(F.xxhash64(F.col(key)), F.lit(GROUPS)).alias("_group"))
    kind = stream.schema[key].dataType.simpleString()
    return typed.groupBy("_group").transformWithStateInPandas(_Attempts([key, order, "round", success]), f"`{key}` {kind}, `{order}` long, round long, `{success}` boolean", "Append", "EventTime")


def run_appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has emitted once what is there now has been read; a batch that is run again replaces itself. May be called again as more comes, with the same checkpoint."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)

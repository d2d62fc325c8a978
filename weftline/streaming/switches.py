"""Switch counts over a stream of states, in the order of event time whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key long, switch_count long, pending long, late long"


#: A row as it waits: time in microseconds, order among rows of one time, state.
_ROW = np.dtype([("t", "<i8"), ("n", "<i8"), ("state", "<i4")])


class _Switches(StatefulProcessor):
    """Of each key: the last settled (time, order, state) with the count up to it, and the rows after it, sorted by (time, order).

    Rows up to the watermark are settled in order when it has passed them, by a timer where no new row
    comes. A row older than the last settled one comes too late to change anything, and is counted as such. A key that
    is silent for the time to live is forgotten. The whole state of a key is one value, its waiting rows packed in it, so a batch reads and
    writes a key once and not a row at a time.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "t long, n long, state int, switches long, late long, waiting binary", self.ttl_ms)

    def _advance(self, key: tuple, timers, batches: Iterable[pd.DataFrame] = ()) -> pd.DataFrame:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        t, n, state, switches, late, packed = self.held.get() or (None, None, None, 0, 0, b"")
        parts = [np.frombuffer(bytes(packed), _ROW)]
        for batch in batches:
            new = np.empty(len(batch), _ROW)
            new["t"], new["n"], new["state"] = batch["micros"], batch["n"], batch["state"]
            if t is not None:
                lost = (new["t"] < t) | ((new["t"] == t) & (new["n"] <= n))
                late += int(lost.sum())
                new = new[~lost]
            parts.append(new)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["n"], rows["t"]))]  # stable: of rows with one time and order the last to come counts
        if len(rows):
            rows = rows[np.append((rows["t"][1:] != rows["t"][:-1]) | (rows["n"][1:] != rows["n"][:-1]), True)]
        ready = int(np.searchsorted(rows["t"], watermark, "right"))
        states = rows["state"] if state is None else np.append(np.int32(state), rows["state"])
        moved = np.cumsum(states[1:] != states[:-1])
        if state is None:
            moved = np.append(0, moved)[: len(rows)]
        now = switches + int(moved[-1]) if len(rows) else switches
        if ready:
            last = rows[ready - 1]
            t, n, state, switches = int(last["t"]), int(last["n"]), int(last["state"]), switches + int(moved[ready - 1])
        rest = rows[ready:]
        self.held.update((t, n, state, switches, late, rest.tobytes()))
        if len(rest):
            self.handle.registerTimer(int(rest["t"][0]) // 1000 + 1)
        return pd.DataFrame({"key": [key[0]], "switch_count": [now], "pending": [len(rest)], "late": [late]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues, rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues)

    def close(self) -> None:
        pass


def switch_stream(states: DataFrame, delay: str = "1 hour", ttl_ms: int | None = None) -> DataFrame:
    """(key, switch_count, pending, late), updated as rows (key long, ts timestamp, n long, state int) come in; n orders rows of one time.

    Counts hold all rows that came so far, in the order of (ts, n): those up to the watermark, ``delay`` behind the latest, are settled, ``pending``
    ones after it are kept and may still get earlier ones between them. ``late`` rows came after later ones
    had been settled. The session needs the RocksDB state store, see ``rocks``.
    """
    rows = states.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(_Switches(ttl_ms), _OUT, "Update", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that timers and maps need; as it was afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def count_files(spark: SparkSession, source: str, schema: str, folder: str, delay: str, files_per_trigger: int = 4) -> DataFrame:
    """Stream all files of a folder with rows as ``switch_stream`` takes them, and give the last count of each key, (key, switch_count, late).

    The stream ends when all files that are there now are counted; checkpoints and updates go to ``folder``.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    with rocks(spark):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        stream = switch_stream(rows, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    latest = F.max_by(F.struct("switch_count", "late"), F.struct("batch", "switch_count")).alias("_l")
    return spark.read.schema(f"{_OUT}, batch int").parquet(f"{folder}/updates").groupBy("key").agg(latest).select("key", "_l.switch_count", "_l.late")

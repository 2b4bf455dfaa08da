"""Alerts of closed windows from keyed state in the stream, sessions, late rows, and upkeep of the tables a stream writes.

A window closes when the watermark passes its end; its counts are then final and go on to a second stateful operator that
remembers the previous window's status of every key.  That state is one short row per key, and a timer drops it when the key
has been silent for longer than a previous window counts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import alert_status, utc_instant, utc_wall
from ordinalis.operators.windows import severity

#: Metrics of a window by name, undefined ones NULL.
METRICS = {"qwk": lambda: cf.qwk(), "macro_f1": lambda: cf.macro_f1(), "detractor_recall": lambda: cf.recall(0, None)}


def closed_windows(events: DataFrame, by: list[str], ts: str = "ts", length: str = "1 day", delay: str = "1 day",
                   session_gap: str | None = None) -> DataFrame:
    """(w, by, counts) of tumbling or session windows; on a stream in append mode a window comes once, when it is closed."""
    source = events.withColumn(ts, utc_instant(F.col(ts))) if dict(events.dtypes)[ts] == "timestamp_ntz" else events
    if source.isStreaming:
        source = source.withWatermark(ts, delay)
    window = F.session_window(ts, session_gap) if session_gap else F.window(ts, length)
    return source.groupBy(window.alias("w"), *by).agg(*cf.counts(), F.count(F.lit(1)).alias("n"))


def statuses(windows: DataFrame, by: list[str], metric: str, lo: float, hi: float) -> DataFrame:
    """(window_start, window_end, by, metric, value, status), the edges in microseconds, which no time zone touches."""
    value = METRICS[metric]()
    return windows.select(F.unix_micros("w.start").alias("window_start"), F.unix_micros("w.end").alias("window_end"), F.window_time("w").alias("_time"),
                          *by, F.lit(metric).alias("metric"), value.alias("value"), alert_status(value, F.lit(lo), F.lit(hi)).alias("status"))


def _walls(df: DataFrame, by: list[str]) -> DataFrame:
    wall = lambda c: utc_wall(F.timestamp_micros(F.col(c))).alias(c)
    return df.select(wall("window_start"), wall("window_end"), *by, "metric", "value", "status", "previous",
                     severity(F.col("status"), F.col("previous")).alias("severity"))


def alert_log(windows: DataFrame, by: list[str], metric: str, lo: float, hi: float, forget: dt.timedelta = dt.timedelta(days=3)) -> DataFrame:
    """(window_start, window_end, by, metric, value, status, previous, severity) of closed windows.

    `previous` is the status of the key's previous window if that started at most `forget` before, else NULL.  On a stream
    it comes from keyed state, on a table from a window function; both give the same rows.
    """
    rows, gap = statuses(windows, by, metric, lo, hi), int(forget.total_seconds() * 1e6)
    if not rows.isStreaming:
        over = W.partitionBy(*by).orderBy("window_start")
        near = F.col("window_start") - F.lag("window_start").over(over) <= gap
        return _walls(rows.withColumn("previous", F.when(near, F.lag("status").over(over))), by)
    kinds = dict(rows.dtypes)
    schema = "window_start long, window_end long, " + "".join(f"`{k}` {kinds[k]}, " for k in by) + "metric string, value double, status string, previous string"
    key = F.to_json(F.struct(*by)).alias("_key")  # never NULL: keyed state mixes NULL keys with others
    followed = rows.withColumn("_key", key).groupBy("_key").transformWithStateInPandas(_follower(by, gap), schema, "Append", "EventTime")
    return _walls(followed, by)


def _follower(by: list[str], gap: int):
    """State processor: the status and start of a key's last closed window, and a timer that forgets them."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    names = ["window_start", "window_end", *by, "metric", "value", "status"]

    class Follower(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "status string, start long, timer long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows)).sort_values("window_start")  # the key's windows that closed in this micro-batch
            last, start, timer = self.last.get() or (None, None, None)
            previous = []
            for at, status in zip(pdf["window_start"].tolist(), pdf["status"], strict=True):
                previous.append(last if start is not None and at - start <= gap else None)
                last, start = status, at
            if timer is not None:
                self.handle.deleteTimer(timer)
            # No window of the key that still counts this one can close after that moment.
            until = (int(pdf["window_end"].iloc[-1]) + gap) // 1000 + 1
            self.handle.registerTimer(until)
            self.last.update((last, start, until))
            yield pdf[names].assign(previous=pd.Series(previous, dtype=object, index=pdf.index))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Follower()


def counts_log(windows: DataFrame, by: list[str]) -> DataFrame:
    """(window_start, window_end, by, n, counts) of closed windows."""
    return windows.select(utc_wall(F.col("w.start")).alias("window_start"), utc_wall(F.col("w.end")).alias("window_end"), *by, "n", *cf.CELLS)


#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_log(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True, **trigger) -> StreamingQuery:
    """Append closed windows to the table at `path`, one folder for each micro-batch; a retried batch rewrites its own."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKSDB)  # read when the query starts
    writer = rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger)).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The closed windows written so far."""
    return spark.read.schema(schema).parquet(path).drop("epoch")


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> DataFrame:
    """Rewrite an epoch table of updated windows: the newest row of each window once, in `target`, by day.

    Windows that later epochs update again are simply newer rows of the old table; readers union both and keep the newest.
    """
    table = spark.read.option("mergeSchema", "false").parquet(path)
    rest = [c for c in table.columns if c not in (*keys, "epoch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct("epoch", *rest), "epoch").alias("_r")).select(*keys, "_r.*")
    newest.withColumn("day", F.to_date("window_start")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(target)
    return spark.read.parquet(target)


class DroppedRows(StreamingQueryListener):
    """Counts what all micro-batches of a query dropped behind the watermark, however many there were.

    Spark counts after its partial sums: rows of the same window and key in one task are one.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        """Nothing was read, nothing dropped."""

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

"""Streaming KPIs: windowed confusion counts with a watermark, metrics and alerts derived from the counts.

The only streaming state is nine counters per open window and key.  Each micro-batch writes the windows it updated under
`epoch=<n>` (rewriting that folder, so a retried batch changes nothing); readers keep the latest epoch of a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import alert_status, utc_instant, utc_wall
from ordinalis.operators.windows import escalate


def read_events(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed_counts(events: DataFrame, by: list[str], ts: str = "ts", length: str = "1 day", slide: str | None = None,
                    delay: str | None = "1 day", session_gap: str | None = None) -> DataFrame:
    """Confusion counts per window: tumbling, sliding (`slide`) or session (`session_gap`, needs a key in `by`).

    Works on streams and on tables; rows later than the watermark are dropped on streams.
    """
    zoneless = dict(events.dtypes)[ts] == "timestamp_ntz"
    source = events.withColumn(ts, utc_instant(F.col(ts))) if zoneless else events
    if source.isStreaming and delay:
        source = source.withWatermark(ts, delay)
    window = F.session_window(ts, session_gap) if session_gap else F.window(ts, length, slide or length)
    edge = utc_wall if zoneless else (lambda c: c)
    return source.groupBy(window.alias("w"), *by).agg(*cf.counts()).select(
        edge(F.col("w.start")).alias("window_start"), edge(F.col("w.end")).alias("window_end"), *by, *cf.CELLS)


def start(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True, **trigger) -> StreamingQuery:
    """Run the stream into the epoch table at `path`; with `available_now` it stops once the input is drained."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger)).start()


def latest_counts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Current counts of every window: the row of the highest epoch."""
    table = spark.read.option("mergeSchema", "false").parquet(path)
    newest = F.max_by(F.struct(*cf.CELLS), "epoch").alias("_c")
    return table.groupBy("window_start", "window_end", *by).agg(newest).select(
        "window_start", "window_end", *by, "_c.*")


def kpis(counts: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per window from its counts."""
    return counts.select("window_start", *by, cf.total().cast("long").alias("n"), cf.qwk().alias("qwk"),
                         cf.macro_f1().alias("macro_f1"), cf.recall(0, None).alias("detractor_recall"))


def alerts(kpi_table: DataFrame, by: list[str], metric: str, lo: float, hi: float) -> DataFrame:
    """Status of each window against a band and severity against the previous window of the same key."""
    rows = kpi_table.select("window_start", *by, F.col(metric).alias("value"))
    placed = rows.withColumn("status", alert_status(F.col("value"), F.lit(lo), F.lit(hi)))
    return escalate(placed.withColumn("metric", F.lit(metric)), [*by, "metric"], "window_start")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark, over all micro-batches still in the progress log."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

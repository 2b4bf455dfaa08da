"""Alerts, sessions and late rows of a stream in several micro-batches and runs, against the same rules on a table."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from ordinalis.streaming import alerts
from ordinalis.streaming import kpis as stream

SCHEMA = "ts timestamp_ntz, arm int, y int, yp int"


def events(spark, days, arms, n=40, wrong=()):
    """n events a day and arm; on the days of `wrong` all predictions miss."""
    rows = [(dt.datetime(2024, 1, d) + dt.timedelta(minutes=30 * i), a, i % 3, (i + (d in wrong)) % 3) for d in days for a in arms for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, root, parts, log, **start):
    """Write the parts one after another, each followed by a run of the stream to its end; the rows of the log."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        rows = log(stream.read_events(spark, f"{root}/in", part.schema, files_per_trigger=1))
        alerts.start_log(rows, f"{root}/log", f"{root}/checkpoint", **start).awaitTermination()
    return sorted(map(tuple, alerts.read_log(spark, f"{root}/log", rows.schema).collect()), key=repr)


def alert_rows(source):
    return alerts.alert_log(alerts.closed_windows(source, ["arm"]), ["arm"], "qwk", 0.0, 0.9)


def closed(df, until):
    return sorted(map(tuple, df.where(F.col("window_end") <= F.lit(until)).collect()), key=repr)


def test_state_over_restarts_equals_a_table(spark, tmp_path):
    """Keys with null, gaps shorter and longer than a previous window counts, several windows of a key in one micro-batch."""
    parts = [events(spark, [1, 2], [0, 1, None], wrong=[2]), events(spark, [3, 4], [0, None], wrong=[3]), events(spark, [6], [0], wrong=[6]),
             events(spark, [8, 9], [1, None], wrong=[8, 9]), events(spark, [12], [0])]
    got = run(spark, tmp_path, parts, alert_rows)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # The last event is at 19:30 of the 12th, so the watermark ends a day before and all windows up to the 11th are closed.
    want = closed(alert_rows(whole), dt.datetime(2024, 1, 11))
    assert got == want and len(want) == 15
    by = {(r[2], r[0].day): (r[5], r[6], r[7]) for r in want}
    assert by[(0, 2)] == ("drift_low", "drift_high", "warn") and by[(0, 3)] == ("drift_low", "drift_low", "alert")
    assert by[(1, 8)] == ("drift_low", None, "warn") and by[(1, 9)] == ("drift_low", "drift_low", "alert")  # six days of silence
    assert by[(0, 6)][1] == "drift_high" and by[(None, 8)][1] is None


def test_running_again_adds_nothing(spark, tmp_path):
    first = run(spark, tmp_path, [events(spark, [1, 2, 5], [0])], alert_rows)
    again = run(spark, tmp_path, [events(spark, [1], [0]).limit(0)], alert_rows)
    assert first == again and len(first) == 2


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    listener = alerts.DroppedRows()
    spark.streams.addListener(listener)
    try:
        def log(source):
            return alerts.counts_log(alerts.closed_windows(source, ["arm"]), ["arm"])
        on_time = [events(spark, [1, 2], [0]), events(spark, [5], [0]), events(spark, [9], [0])]
        got = run(spark, tmp_path, [on_time[0], on_time[1].unionByName(events(spark, [1], [0, 7])).coalesce(1), on_time[2], events(spark, [1, 2], [0, 3])], log)
        for _ in range(100):
            if len(listener.ended) == 4:
                break
            time.sleep(0.1)
        assert sum(listener.dropped.values()) > 0 and len(listener.dropped) == 4
    finally:
        spark.streams.removeListener(listener)
    # Rows of the 1st that came with those of the 5th were not late yet: the watermark then stood at the 1st of January.
    want = closed(log(on_time[0].unionByName(on_time[1]).unionByName(events(spark, [1], [0, 7]))), dt.datetime(2024, 1, 8))
    assert got == want


@pytest.mark.parametrize("chunked", [False, True])
def test_sessions(spark, tmp_path, chunked):
    base = dt.datetime(2024, 1, 1)
    minutes = {0: [0, 10, 25, 70, 75, 200], 1: [5, 600, 601], None: [0, 29]}
    rows = [(base + dt.timedelta(minutes=m), a, 0, 0) for a, ms in minutes.items() for m in ms] + [(base + dt.timedelta(days=4), 9, 0, 0)]
    rows.sort(key=lambda r: r[0])
    cut = [rows[:6], rows[6:]] if chunked else [rows]

    def log(source):
        return alerts.counts_log(alerts.closed_windows(source, ["arm"], session_gap="30 minutes"), ["arm"])
    got = run(spark, tmp_path, [spark.createDataFrame(c, SCHEMA) for c in cut], log)
    spans = sorted(((r[2], int((r[0] - base).total_seconds() // 60), int((r[1] - base).total_seconds() // 60), r[3]) for r in got), key=repr)
    assert spans == sorted([(0, 0, 55, 3), (0, 70, 105, 2), (0, 200, 230, 1), (1, 5, 35, 1), (1, 600, 631, 2), (None, 0, 59, 2)], key=repr)


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    for epoch, rows in enumerate([[(at(1), 0, 5), (at(2), 0, 1)], [(at(2), 0, 4)], [(at(2), 1, 9), (at(1), 0, 6)]]):
        spark.createDataFrame(rows, "window_start timestamp_ntz, arm int, n long").write.parquet(f"{tmp_path}/t/epoch={epoch}")
    small = alerts.compact(spark, f"{tmp_path}/t", f"{tmp_path}/c", ["window_start", "arm"])
    assert sorted((r.window_start.day, r.arm, r.n, r.epoch) for r in small.collect()) == [(1, 0, 6, 2), (2, 0, 4, 1), (2, 1, 9, 2)]


def test_provider_is_put_back(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    run(spark, tmp_path, [events(spark, [1], [0])], alert_rows)
    assert spark.conf.get(name, None) == before

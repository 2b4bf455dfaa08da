import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordinalis.operators import monitor, sampling, windows
from ordinalis.streaming import kpis as stream


@pytest.mark.parametrize("statuses,expected", [
    (["in_band"] * 3, ["ok"] * 3),
    (["drift_low", "drift_low", "drift_low"], ["warn", "alert", "alert"]),
    (["drift_low", "drift_high"], ["warn", "warn"]),
    (["drift_low", "in_band", "drift_low"], ["warn", "ok", "warn"]),
    (["drift_high", "no_reference", "drift_high", "drift_high"], ["warn", "ok", "warn", "alert"])])
def test_escalation(spark, statuses, expected):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate(statuses)], "cell string, batch int, status string")
    got = [r.severity for r in windows.escalate(df, ["cell"], "batch").orderBy("batch").collect()]
    assert got == expected


def reference(spark):
    own = spark.createDataFrame([("C1", "Senior", "Yes", 0, 0.5, 0.7), ("C1", "Senior", "No", 0, None, None)],
                                "model string, segment string, `group` string, class_idx int, recall_ci_lo double, recall_ci_hi double")
    main = spark.createDataFrame([("C1", "silent_test", "detractor_recall", 0.6, 0.65), ("C1", "val", "qwk", 0.1, 0.2)],
                                 "model string, split string, metric string, ci_lo double, ci_hi double")
    return own, main


def test_reference_lookup_falls_through(spark):
    cells = spark.createDataFrame([("C1", "detractor_recall", "Senior", "Yes"), ("C1", "detractor_recall", "Senior", "No"),
                                   ("C1", "detractor_recall", None, None), ("C1", "qwk", None, None)],
                                  "model string, metric string, segment string, `group` string")
    got = {(r.metric, r.group): (r.ref_lo, r.ref_hi, r.ref_source) for r in monitor.reference_ci(cells, *reference(spark)).collect()}
    assert got[("detractor_recall", "Yes")] == (0.5, 0.7, "per_segment")
    assert got[("detractor_recall", "No")] == (0.6, 0.65, "headline")
    assert got[("detractor_recall", None)] == (0.6, 0.65, "headline")
    assert got[("qwk", None)] == (None, None, "no_reference")


def test_alert_table_and_summary(spark):
    rows = [("C1", b, 10, 0, 9, "detractor_recall", v, None, None) for b, v in enumerate([0.62, 0.4, 0.3, 0.9, None])]
    kpis = spark.createDataFrame(rows, "model string, batch_id int, batch_size int, first_id int, last_id int, metric string, "
                                       "value double, segment string, `group` string")
    table = monitor.alert_table(kpis, *reference(spark)).orderBy("batch_id").collect()
    assert [r.severity for r in table] == ["ok", "warn", "alert", "warn", "ok"]
    assert [r.status for r in table] == ["in_band", "drift_low", "drift_low", "drift_high", "no_reference"]
    s = monitor.alert_summary(monitor.alert_table(kpis, *reference(spark))).first()
    assert (s.total, s.ok, s.warn, s.alert) == (5, 2, 2, 1)


def test_alert_table_is_planned_apart_from_its_inputs(spark):
    """The plans of the KPIs and of both references end before the table's own: together they took the driver minutes."""
    rows = [("C1", b, 10, 0, 9, "detractor_recall", v, None, None) for b, v in enumerate([0.62, 0.4])]
    kpis = spark.createDataFrame(rows, "model string, batch_id int, batch_size int, first_id int, last_id int, metric string, "
                                       "value double, segment string, `group` string")
    long = [df.groupBy(*df.columns).count().drop("count") for df in (kpis, *reference(spark))]
    table = monitor.alert_table(*long)
    assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [r.severity for r in table.orderBy("batch_id").collect()] == ["ok", "warn"]


def test_threshold_rules(spark):
    df = spark.createDataFrame([(1, 0.05, 0.2), (2, 0.12, 0.15), (3, 0.13, 0.31), (4, 0.09, 0.2)], "m int, ece double, selection_rate double")
    got = monitor.threshold_rules(df.withColumn("k", F.lit(1)), ["k"], "m").orderBy("m").collect()
    assert [r.ece_status for r in got] == ["ok", "warn", "alert", "warn"]
    assert [r.selection_status for r in got] == ["ok", "warn", "alert", "ok"]


@pytest.mark.parametrize("n,batches", [(100, 12), (5, 12), (24, 12)])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_fifo_batches(spark, n, batches, kind):
    key = F.format_string("%05d", "id") if kind == "string" else F.col("id") * 3
    got = sampling.fifo_batches(spark.range(n).select(key.alias("k")), "k", batches).orderBy("k").collect()
    size = -(-n // batches)
    assert [r.batch_id for r in got] == [i // size + 1 for i in range(n)]


def test_score_integrity_finds_violations(spark):
    rows = [(1, 0.5, 0.3, 0.2, 0, 1), (2, 0.5, 0.6, 0.2, 0, 2), (3, 0.2, 0.3, 0.5, 2, 9)]
    df = spark.createDataFrame(rows, "id int, p0_A double, p1_A double, p2_A double, yp_A int, rank_A int")
    got = {r.rule: r.violations for r in monitor.score_integrity(df, ["A"]).collect()}
    assert got == {"probability_range_A": 0, "probability_sum_A": 1, "argmax_A": 1, "rank_min_A": 0, "rank_max_A": 1}


def events(spark, day, n, key=0):
    base = dt.datetime(2024, 1, day)
    rows = [(base + dt.timedelta(minutes=7 * i), key, i % 3, (i * 5) % 3) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, arm int, y int, yp int")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    files = [events(spark, 1, 100), events(spark, 5, 100), events(spark, 9, 100), events(spark, 1, 50, 1)]
    import os
    for i, df in enumerate(files):
        df.coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        (part,) = (tmp_path / f"f{i}").glob("part-*.parquet")
        src.mkdir(exist_ok=True)
        os.link(part, src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    source = stream.read_events(spark, str(src), files[0].schema, files_per_trigger=1)
    run = stream.start(stream.windowed_counts(source, ["arm"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    run.awaitTermination()
    got = sorted(map(tuple, stream.latest_counts(spark, str(tmp_path / "out"), ["arm"]).collect()))
    on_time = files[0].union(files[1]).union(files[2])
    want = sorted(map(tuple, stream.windowed_counts(on_time, ["arm"]).collect()))
    assert got == want and stream.dropped_rows(run) > 0


def test_stream_alerts(spark):
    rows = [(dt.datetime(2024, 1, d), 0, v) for d, v in enumerate([0.5, 0.5, 0.65, 0.9], 1)]
    df = spark.createDataFrame(rows, "window_start timestamp_ntz, arm int, qwk double")
    got = stream.alerts(df, ["arm"], "qwk", 0.6, 0.7).orderBy("window_start").collect()
    assert [r.severity for r in got] == ["warn", "alert", "ok", "warn"]


def test_session_and_sliding_windows(spark):
    df = events(spark, 1, 10)
    assert stream.windowed_counts(df, ["arm"], session_gap="10 minutes").count() == 1
    assert stream.windowed_counts(df, ["arm"], session_gap="5 minutes").count() == 10
    assert stream.windowed_counts(df, ["arm"], slide="12 hours").count() == 2

"""Queries on batch scoring, monitoring, alerts and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.operators import bootstrap as bs
from ordinalis.operators import calibration as cal
from ordinalis.operators import evaluation as ev
from ordinalis.operators import fairness as fair
from ordinalis.operators import monitor, prep, ranking, sampling
from ordinalis.plans import frag
from ordinalis.plans.evaluation import _BIN
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import LONG, SEG_LONG, SEGMENTS, scored, scored_long, sql, table, with_segments
from ordinalis.session import scratch_path, small_side
from ordinalis.streaming import alerts as alert_stream
from ordinalis.streaming import kpis as stream

SEGS = list(SEGMENTS)


# --- wide score table --------------------------------------------------------------------------------------------------

def wide_scores(spark, sf):
    """Two models side by side with detractor ranks and the agreement flag."""
    wide = prep.side_by_side(scored_long(spark, sf), "id", "model", ["C1", "C2"], ["p0", "p1", "p2", "yp"])
    for m in ("C1", "C2"):
        wide = ranking.min_rank(wide, [], f"p0_{m}", f"rank_{m}")
    return wide.withColumn("agreement", F.col("yp_C1") == F.col("yp_C2"))


_WIDE = "w0 AS (SELECT id, " + ", ".join(f"max({v}) FILTER (model='{m}') AS {v}_{m}" for m in ("C1", "C2") for v in ("p0", "p1", "p2", "yp")) + """
  FROM scored_long GROUP BY id),
wide AS (SELECT *, rank() OVER (ORDER BY p0_C1 DESC) AS rank_C1, rank() OVER (ORDER BY p0_C2 DESC) AS rank_C2, yp_C1=yp_C2 AS agreement FROM w0)"""


@query("batch_score_table", sql(LONG, _WIDE, "SELECT id, yp_C1, yp_C2, rank_C1, rank_C2, agreement, "
       + ", ".join(f"round({p}_{m},6) AS {p}_{m}" for m in ("C1", "C2") for p in ("p0", "p1", "p2")) + " FROM wide"))
def batch_score_table(spark, sf):
    return r6(wide_scores(spark, sf))


@query("model_agreement", sql(LONG, _WIDE, """SELECT count(*) AS n, count(*) FILTER (agreement) AS n_agree,
    round(avg(agreement::int),6) AS agreement FROM wide"""))
def model_agreement(spark, sf):
    wide = prep.side_by_side(scored_long(spark, sf), "id", "model", ["C1", "C2"], ["yp"])
    return r6(monitor.agreement(wide, "yp_C1", "yp_C2"))


_RULES = []
for _m in ("C1", "C2"):
    _RULES += [(f"probability_range_{_m}", f"count(*) FILTER (NOT (p0_{_m} BETWEEN 0 AND 1 AND p1_{_m} BETWEEN 0 AND 1 AND p2_{_m} BETWEEN 0 AND 1))"),
               (f"probability_sum_{_m}", f"count(*) FILTER (abs(p0_{_m}+p1_{_m}+p2_{_m}-1)>1e-3)"),
               (f"argmax_{_m}", f"count(*) FILTER ([p0_{_m},p1_{_m},p2_{_m}][yp_{_m}+1] < greatest(p0_{_m},p1_{_m},p2_{_m}))"),
               (f"rank_min_{_m}", f"count(*) FILTER (rank_{_m}<1)"), (f"rank_max_{_m}", f"(max(rank_{_m})>count(*))::bigint")]
_RULES.append(("agreement", "count(*) FILTER (agreement <> (yp_C1=yp_C2))"))


@query("score_integrity", sql(LONG, _WIDE, " UNION ALL ".join(f"SELECT '{n}' AS rule, {e} AS violations FROM wide" for n, e in _RULES)))
def score_integrity(spark, sf):
    return monitor.score_integrity(wide_scores(spark, sf), ["C1", "C2"])


@query("population_kpis", sql(LONG, "SELECT model, split, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (yp={k}) AS n_{k}, round(count(*) FILTER (yp={k})/count(*)::double,6) AS share_{k}" for k in range(3)) + " FROM scored_long GROUP BY ALL"))
def population_kpis(spark, sf):
    return r6(monitor.population_kpis(scored_long(spark, sf), ["model", "split"]))


# --- batches -----------------------------------------------------------------------------------------------------------

_BATCHED = """bat AS (SELECT *, ((dense_rank() OVER (ORDER BY id)-1)//ceil((SELECT count(*) FROM labelled)/12.0)::bigint + 1)::int AS batch_id FROM seg_scored_long)"""
_EXT = "ext AS (SELECT model, batch_id, count(*) AS batch_size, min(id) AS first_id, max(id) AS last_id FROM bat GROUP BY ALL)"
_KMETRICS = {"qwk": "qwk", "macro_f1": "macro_f1", "detractor_recall": "detractor_recall", "lift_10": "lift@10"}
_KPI = ",\n".join([SEG_LONG, _BATCHED, _EXT, frag.evaluate_cte("ev", "bat", "model, batch_id"), frag.long_cte("el", "ev", "model, batch_id", _KMETRICS),
    """kpi AS (SELECT model, batch_id, batch_size, first_id, last_id, metric, value, NULL::varchar AS segment, NULL::varchar AS "group"
    FROM el JOIN ext USING (model, batch_id))"""])
_MELTB = "mb AS (" + " UNION ALL ".join(f"SELECT model, batch_id, y, yp, '{s}' AS segment, {s} AS \"group\" FROM bat" for s in SEGS) + ")"
_SEGKPI = _MELTB + """,
segkpi AS (SELECT model, batch_id, batch_size, first_id, last_id, 'detractor_recall' AS metric,
  count(*) FILTER (y=0 AND yp=0)/nullif(count(*) FILTER (y=0),0)::double AS value, segment, "group"
  FROM mb JOIN ext USING (model, batch_id) GROUP BY ALL)"""
_COLS = 'model, batch_id, batch_size, first_id, last_id, metric, round(value,6) AS value, segment, "group"'


def batched(spark, sf):
    rows = scored_long(spark, sf)
    bounds = sampling.fifo_bounds(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    return with_segments(spark, sf, rows.withColumn("batch_id", sampling.batch_number("id", bounds)))


def all_kpis(spark, sf):
    rows = batched(spark, sf)
    return monitor.batch_kpis(rows), monitor.batch_segment_recall(rows, SEGS)


@query("batch_kpis", sql(_KPI, f"SELECT {_COLS} FROM kpi"))
def batch_kpis(spark, sf):
    return r6(all_kpis(spark, sf)[0])


@query("batch_segment_recall", sql(SEG_LONG, _BATCHED, _EXT, _SEGKPI, f"SELECT {_COLS} FROM segkpi"))
def batch_segment_recall(spark, sf):
    return r6(all_kpis(spark, sf)[1])


@query("kpi_stability", sql(_KPI, """SELECT model, metric, round(min(value),6) AS min, round(max(value),6) AS max,
    round(max(value)-min(value),6) AS range FROM kpi GROUP BY ALL"""))
def kpi_stability(spark, sf):
    return r6(monitor.kpi_stability(all_kpis(spark, sf)[0]))


# Reference bands of the SQL-checked alert queries: normal-approximation recall bands per group and fixed-width headline bands without lift (so that it has no reference).
def reference_tables(spark, sf):
    rows = with_segments(spark, sf, scored_long(spark, sf))
    rates = fair.group_rates(small_side(fair.group_counts(rows, SEGS, ["model"])), ["model"])
    half = 1.96 * F.sqrt(F.col("recall") * (1 - F.col("recall")) / F.col("n_class"))
    own = rates.select("model", "segment", "group", "class_idx", (F.col("recall") - half).alias("recall_ci_lo"), (F.col("recall") + half).alias("recall_ci_hi"))
    cm = ev.confusion_counts(scored_long(spark, sf), ["model", "split"])
    long = ev.to_long(ev.point_metrics(cm, ["model", "split"]), ["model", "split"])
    return own, long.select("model", "split", "metric", (F.col("value") - 0.01).alias("ci_lo"), (F.col("value") + 0.01).alias("ci_hi"))


_REFS = ",\n".join([
    "rmelt AS (" + " UNION ALL ".join(f"SELECT model, y, yp, '{s}' AS segment, {s} AS \"group\" FROM seg_scored_long" for s in SEGS) + ")",
    frag.cm_cte("rcm", "rmelt", 'model, segment, "group"'),
    f"""rown AS (SELECT model, segment, "group", r-1.96::double*sqrt(r*(1-r)/np) AS lo, r+1.96::double*sqrt(r*(1-r)/np) AS hi FROM
    (SELECT *, {frag.recall(0, True)} AS r, {frag.row(0)} AS np FROM rcm))""",
    frag.cm_cte("hcm", "scored_long", "model, split"),
    "hl AS (" + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {e} AS v FROM hcm WHERE split='silent_test'"
                                   for n, e in (("qwk", frag.QWK), ("macro_f1", frag.MACRO_F1), ("detractor_recall", frag.recall(0)))) + ")"])
_CELLS = ",\n".join([_KPI, _SEGKPI, _REFS, """cells AS (SELECT * FROM kpi UNION ALL SELECT * FROM segkpi),
refd AS (SELECT c.*, coalesce(o.lo, h.v-0.01::double) AS ref_lo, coalesce(o.hi, h.v+0.01::double) AS ref_hi,
  case when o.lo is not null then 'per_segment' when h.v is not null then 'headline' else 'no_reference' end AS ref_source
  FROM cells c LEFT JOIN rown o ON o.model=c.model AND o.segment=c.segment AND o."group"=c."group" AND c.metric='detractor_recall'
  LEFT JOIN hl h ON h.model=c.model AND h.metric=c.metric),
stat AS (SELECT *, case when value is null or ref_lo is null or ref_hi is null then 'no_reference' when value<ref_lo then 'drift_low'
  when value>ref_hi then 'drift_high' else 'in_band' end AS status FROM refd),
prv AS (SELECT *, lag(status) OVER (PARTITION BY model, metric, segment, "group" ORDER BY batch_id) AS prev FROM stat),
alerts AS (SELECT *, case when status NOT LIKE 'drift%' then 'ok' when prev=status then 'alert' else 'warn' end AS severity FROM prv)"""])


def cells(spark, sf):
    a, b = all_kpis(spark, sf)
    return a.unionByName(b)


def alerts(spark, sf):
    own, main = reference_tables(spark, sf)
    return monitor.alert_table(cells(spark, sf), own, main)


@query("reference_ci_lookup", sql(_CELLS, """SELECT DISTINCT model, metric, segment, "group", round(ref_lo,6) AS ref_lo, round(ref_hi,6) AS ref_hi, ref_source FROM refd"""))
def reference_ci_lookup(spark, sf):
    own, main = reference_tables(spark, sf)
    keys = cells(spark, sf).select("model", "metric", "segment", "group").distinct()
    return r6(monitor.reference_ci(keys, own, main))


@query("alert_status", sql(_CELLS, """SELECT model, batch_id, metric, segment, "group", status FROM stat"""))
def alert_status(spark, sf):
    return alerts(spark, sf).select("model", "batch_id", "metric", "segment", "group", "status")


@query("alert_table", sql(_CELLS, """SELECT model, batch_id, metric, segment, "group", round(value,6) AS observed, round(ref_lo,6) AS ref_lo,
    round(ref_hi,6) AS ref_hi, ref_source, status, severity, batch_size FROM alerts"""))
def alert_table(spark, sf):
    return r6(alerts(spark, sf))


@query("alert_summary", sql(_CELLS, """SELECT model, metric, count(*) AS total, count(*) FILTER (severity='ok') AS ok,
    count(*) FILTER (severity='warn') AS warn, count(*) FILTER (severity='alert') AS alert FROM alerts GROUP BY ALL"""))
def alert_summary(spark, sf):
    return monitor.alert_summary(alerts(spark, sf), ["model", "metric"])


@query("alert_table_bootstrap")
def alert_table_bootstrap(spark, sf):
    """The same table against bootstrap bands, as in production."""
    rows = with_segments(spark, sf, scored_long(spark, sf))
    keys = ["model", "segment", "group"]
    cm = small_side(fair.group_counts(rows, SEGS, ["model"]))
    own = bs.group_bootstrap(cm, bs.multinomial_counts(cm, keys, 1000), keys)
    main = bs.bootstrap_all(scored_long(spark, sf), ["model", "split"], 1000)
    return r6(monitor.alert_table(cells(spark, sf), own, main))


# --- spec rules --------------------------------------------------------------------------------------------------------

_MONTH = """mo AS (SELECT model, (year(ts)*12+month(ts))::int AS month, y, yp, p0 AS p, (y=0)::int AS hit FROM scored_long)"""
_RULESQL = f"""mc AS (SELECT model, month, {_BIN} AS b, count(*) AS n, sum(p) AS sp, sum(hit) AS sh, count(*) FILTER (yp=0) AS sel FROM mo GROUP BY ALL),
mk AS (SELECT model, month, sum(abs(sp-sh))/sum(n) AS ece, sum(sel)::double/sum(n) AS selection_rate FROM mc GROUP BY ALL)"""


@query("threshold_rules", sql(LONG, _MONTH, _RULESQL, """SELECT model, month, round(ece,6) AS ece, round(selection_rate,6) AS selection_rate,
    case when ece>0.1::double and coalesce(lag(ece) OVER w > 0.1::double, false) then 'alert' when ece>0.08::double then 'warn' else 'ok' end AS ece_status,
    case when not (selection_rate*100 between 13 and 30) then 'alert' when not (selection_rate*100 between 16 and 26) then 'warn' else 'ok' end AS selection_status
    FROM mk WINDOW w AS (PARTITION BY model ORDER BY month)"""))
def threshold_rules(spark, sf):
    rows = scored_long(spark, sf).withColumn("month", (F.year("ts") * 12 + F.month("ts")).cast("int"))
    rows = rows.select("model", "month", "y", "yp", "p0", "p1", "p2")
    ece = cal.calibration_report(rows, ["model", "month"]).filter("class_idx = 0").select("model", "month", "ece")
    rate = rows.groupBy("model", "month").agg(F.avg((F.col("yp") == 0).cast("double")).alias("selection_rate"))
    return r6(monitor.threshold_rules(ece.join(rate, ["model", "month"]), ["model"], "month"))


@query("label_join_monthly", sql(LONG, """recent AS (SELECT s.model, s.id, l.y, s.yp, s.p0 FROM (SELECT model, id, yp, p0, ts FROM scored_long) s
    JOIN (SELECT id, y FROM labelled WHERE split<>'silent_test') l USING (id)
    WHERE s.ts > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY AND s.ts <= (SELECT max(o_orderdate) FROM orders))""",
    frag.evaluate_cte("ev", "recent", "model"), f"""SELECT model, n, {frag.rounded(["qwk", "macro_f1", "balanced_acc", "detractor_recall",
    "recall_detractor", "recall_passive", "recall_promoter", "lift_10", "lift_20"])} FROM ev"""))
def label_join_monthly(spark, sf):
    rows = scored_long(spark, sf)
    truth = scored(spark, sf).filter("split <> 'silent_test'").select("id", "y")
    # as text, so that neither the session's nor Python's time zone touches it; a literal reaches the scan filter
    until = table(spark, sf, "orders").agg(F.max("o_orderdate").cast("string")).first()[0]
    joined = monitor.label_join(rows.select("model", "id", "yp", "p0", "ts"), truth, "id", "ts", F.lit(until).cast("timestamp_ntz"))
    return r6(ev.evaluate(joined, ["model"]))


# --- streams -------------------------------------------------------------------------------------------------------------


def scored_events(events, *more):
    """Truth from the event type; the prediction agrees two times in three and else follows the value."""
    y = F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("click", "view"), 1).otherwise(2)
    return events.select("ts", "event_id", (F.col("user_id") % 2).cast("int").alias("arm"), y.alias("y")
                         , F.when(F.col("event_id") % 3 != 0, y).otherwise((F.floor("value") % 3).cast("int")).alias("yp"), *more)


_EV = """se AS (SELECT ts, (user_id%2)::int AS arm, y, case when event_id%3<>0 then y else (floor(value)::bigint%3)::int end AS yp FROM
  (SELECT *, case when event_type='error' then 0 when event_type in ('click','view') then 1 else 2 end AS y FROM events)),
sw AS (SELECT *, date_trunc('day', ts)::timestamp AS window_start FROM se)"""
_SK = f"""sk AS (SELECT window_start, arm, {frag.N}::bigint AS n, {frag.QWK} AS qwk, {frag.MACRO_F1} AS macro_f1, {frag.recall(0, True)} AS detractor_recall FROM scm)"""


def stream_table(spark, sf):
    schema = table(spark, sf, "events").schema
    events = stream.read_events(spark, sf, schema, "events.parquet")
    path = scratch_path(spark, "stream")
    run = stream.start(stream.windowed_counts(scored_events(events), ["arm"]), f"{path}/table", f"{path}/checkpoint")
    run.awaitTermination()
    return stream.latest_counts(spark, f"{path}/table", ["arm"])


@query("stream_kpis", sql(_EV, frag.cm_cte("scm", "sw", "window_start, arm"), _SK,
       "SELECT window_start, arm, n, round(qwk,6) AS qwk, round(macro_f1,6) AS macro_f1, round(detractor_recall,6) AS detractor_recall FROM sk"))
def stream_kpis(spark, sf):
    return r6(stream.kpis(stream_table(spark, sf), ["arm"]))


@query("stream_alerts", sql(_EV, frag.cm_cte("scm", "sw", "window_start, arm"), _SK,
    """st AS (SELECT *, case when qwk is null then 'no_reference' when qwk<0.6::double then 'drift_low' when qwk>0.7::double then 'drift_high' else 'in_band' end AS status FROM sk),
    pv AS (SELECT *, lag(status) OVER (PARTITION BY arm ORDER BY window_start) AS prev FROM st)""",
    """SELECT window_start, arm, 'qwk' AS metric, round(qwk,6) AS value, status,
    case when status NOT LIKE 'drift%' then 'ok' when prev=status then 'alert' else 'warn' end AS severity FROM pv"""))
def stream_alerts(spark, sf):
    return r6(stream.alerts(stream.kpis(stream_table(spark, sf), ["arm"]), ["arm"], "qwk", 0.6, 0.7))


@query("sliding_window_counts", sql(_EV, """hops AS (SELECT se.*, date_trunc('day', ts)::timestamp - to_hours(12*k) AS window_start FROM se, range(-1, 2) r(k)
    WHERE ts >= date_trunc('day', ts)::timestamp - to_hours(12*k) AND ts < date_trunc('day', ts)::timestamp - to_hours(12*k) + INTERVAL 1 DAY)""",
    frag.cm_cte("scm", "hops", "window_start, arm"), "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, arm, "
    + ", ".join(cf.CELLS) + " FROM scm"))
def sliding_window_counts(spark, sf):
    return stream.windowed_counts(scored_events(table(spark, sf, "events")), ["arm"], length="1 day", slide="12 hours")


def drain_chunks(spark, sf, log, chunks=3, late=None):
    """Events come in `chunks` parts of the month, written one after another; each run goes on from the checkpoint of the one before.

    Rows of the first part for which `late` holds come with the last part instead. `log(stream)` gives the rows to append.
    """
    events = table(spark, sf, "events")
    path = scratch_path(spark, "stream")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(chunks - 1))
    if late is not None:
        part = F.when((part == 0) & F.expr(late), chunks - 1).otherwise(part)
    for i in range(chunks):
        events.where(part == i).write.mode("append").parquet(f"{path}/in")
        rows = log(stream.read_events(spark, f"{path}/in", events.schema))
        alert_stream.start_log(rows, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return alert_stream.read_log(spark, f"{path}/log", rows.schema)


LATE = "event_id % 25 = 0"
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 DAY"
_ONTIME = "so AS (SELECT * FROM sw WHERE NOT (day(ts) <= 10 AND event_id % 25 = 0))"
_EV_ID = _EV.replace("SELECT ts, (user_id", "SELECT ts, event_id, user_id, (user_id")


@query("stream_alert_log", sql(_EV_ID, _ONTIME, frag.cm_cte("scm", "so", "window_start, arm"), _SK,
    """st AS (SELECT *, case when qwk is null then 'no_reference' when qwk<0.6::double then 'drift_low' when qwk>0.7::double then 'drift_high' else 'in_band' end AS status FROM sk),
    pv AS (SELECT *, case when window_start - lag(window_start) OVER w <= INTERVAL 3 DAY then lag(status) OVER w end AS previous FROM st
      WINDOW w AS (PARTITION BY arm ORDER BY window_start))""",
    f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, arm, 'qwk' AS metric, round(qwk,6) AS value, status, previous,
    case when status NOT LIKE 'drift%' then 'ok' when previous=status then 'alert' else 'warn' end AS severity
    FROM pv WHERE window_start + INTERVAL 1 DAY <= {_CLOSED}"""))
def stream_alert_log(spark, sf):
    """Alerts of closed windows from keyed state, over three runs that go on from each other's checkpoint, with late rows."""
    return r6(drain_chunks(spark, sf, lambda s: alert_stream.alert_log(alert_stream.closed_windows(scored_events(s), ["arm"]), ["arm"], "qwk", 0.6, 0.7), late=LATE))


@query("stream_late_rows", sql(_EV_ID, _ONTIME, frag.cm_cte("scm", "so", "window_start, arm"),
    f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, arm, {frag.N}::bigint AS n, {', '.join(cf.CELLS)} FROM scm
    WHERE window_start + INTERVAL 1 DAY <= {_CLOSED}"""))
def stream_late_rows(spark, sf):
    """Counts of closed windows; rows that come after their window was closed are not in them."""
    return drain_chunks(spark, sf, lambda s: alert_stream.counts_log(alert_stream.closed_windows(scored_events(s), ["arm"]), ["arm"]), late=LATE)


@query("stream_sessions", sql(_EV_ID, """marked AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, true)::int AS first FROM se
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked),
    sess AS (SELECT user_id, s, min(ts)::timestamp AS window_start, max(ts)::timestamp + INTERVAL 12 HOUR AS window_end FROM numbered GROUP BY 1, 2)""",
    frag.cm_cte("scm", "numbered", "user_id, s"),
    f"""SELECT window_start, window_end, user_id, {frag.N}::bigint AS n, {', '.join(cf.CELLS)} FROM scm JOIN sess USING (user_id, s)
    WHERE window_end <= {_CLOSED}"""))
def stream_sessions(spark, sf):
    """Counts of closed sessions of each user; a session ends twelve hours after its last event."""
    def log(source):
        rows = scored_events(source, "user_id")
        return alert_stream.counts_log(alert_stream.closed_windows(rows, ["user_id"], session_gap="12 hours"), ["user_id"])
    return drain_chunks(spark, sf, log)

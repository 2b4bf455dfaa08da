"""Queries on scored orders: metrics, lift, model comparison and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import ratio
from ordinalis.operators import calibration as cal
from ordinalis.operators import evaluation as ev
from ordinalis.operators import fairness as fair
from ordinalis.operators.ranking import join_on
from ordinalis.plans import frag
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import LONG, SEG_LONG, SEGMENTS, scored_long, sql, with_segments

BY = ["model", "split"]
SB = "model, split"


@query("flagship", sql(SEG_LONG, """melted AS (
  SELECT model, 'status' AS segment, status AS grp, id, y, yp, p0 FROM seg_scored_long UNION ALL
  SELECT model, 'mktsegment', mktsegment, id, y, yp, p0 FROM seg_scored_long UNION ALL
  SELECT model, 'region', region, id, y, yp, p0 FROM seg_scored_long)""",
    frag.evaluate_cte("ev", "melted", "model, segment, grp"),
    """ref AS (SELECT *, first_value(detractor_recall) OVER (PARTITION BY model, segment
       ORDER BY detractor_recall DESC NULLS LAST, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rr FROM ev)""",
    f"""SELECT model, segment, grp AS "group", n, {frag.rounded(["qwk", "macro_f1", "balanced_acc", "detractor_recall",
        "recall_detractor", "recall_passive", "recall_promoter", "lift_10", "lift_20"])},
        round(detractor_recall / nullif(rr,0), 6) AS di FROM ref"""))
def flagship(spark, sf):
    """Every metric per model x segment x group, with the disparate impact of detractor recall."""
    rows = with_segments(spark, sf, scored_long(spark, sf))
    long = fair.melt_segments(rows, list(SEGMENTS), ["model", "id", "y", "yp", "p0"])
    table = ev.evaluate(long, ["model", "segment", "group"])
    rates = table.select("model", "segment", "group", F.lit(0).alias("class_idx"),
                         F.col("detractor_recall").alias("recall"))
    impact = fair.disparate_impact(rates, ["model"]).select("model", "segment", "group", "di")
    return r6(table.join(impact, ["model", "segment", "group"]))


@query("confusion_matrix", sql(LONG, frag.cm_cte("cm", "scored_long", SB), "SELECT * FROM cm"))
def confusion_matrix(spark, sf):
    return ev.confusion_counts(scored_long(spark, sf), BY).drop("n_rows")


@query("confusion_rownorm", sql(LONG, frag.cm_cte("cm", "scored_long", SB),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {SB}, {i} AS y, {j} AS yp, n{i}{j} AS n, round(n{i}{j}/nullif({frag.row(i)},0), 6) AS share FROM cm"
        for i in range(3) for j in range(3)) + ")"))
def confusion_rownorm(spark, sf):
    return r6(ev.confusion_long(ev.confusion_counts(scored_long(spark, sf), BY), BY))


def _metric(name: str, expr, text: str):
    @query(name, sql(LONG, frag.cm_cte("cm", "scored_long", SB), f"SELECT {SB}, round({text}, 6) AS {name} FROM cm"))
    def run(spark, sf):
        return r6(ev.confusion_counts(scored_long(spark, sf), BY).select(*BY, expr().alias(name)))
    return run


_metric("qwk", cf.qwk, frag.QWK)
_metric("macro_f1", cf.macro_f1, frag.MACRO_F1)
_metric("balanced_accuracy", cf.balanced_accuracy, frag.BALANCED)


@query("class_recall", sql(LONG, frag.cm_cte("cm", "scored_long", SB), f"SELECT {SB}, " + ", ".join(
    f"round({frag.recall(i)}, 6) AS recall_{i}" for i in range(3)) + " FROM cm"))
def class_recall(spark, sf):
    cm = ev.confusion_counts(scored_long(spark, sf), BY)
    return r6(cm.select(*BY, *[cf.recall(i).alias(f"recall_{i}") for i in range(3)]))


@query("lift_at_k", sql(LONG, frag.lift_cte("lf", "scored_long", SB),
                        f"SELECT {SB}, {frag.rounded(['lift_10', 'lift_20'])} FROM lf"))
def lift_at_k(spark, sf):
    return r6(ev.lift(scored_long(spark, sf), BY))


_METRICS = ["qwk", "macro_f1", "balanced_acc", "detractor_recall", "recall_detractor", "recall_passive",
            "recall_promoter", "lift_10", "lift_20"]


@query("evaluate", sql(LONG, frag.evaluate_cte("ev", "scored_long", "model"),
                       f"SELECT model, n, {frag.rounded(_METRICS)} FROM ev"))
def evaluate(spark, sf):
    return r6(ev.evaluate(scored_long(spark, sf), ["model"]))


@query("evaluate_on_splits", sql(LONG, frag.evaluate_cte("ev", "scored_long", SB),
                                 f"SELECT {SB}, n, {frag.rounded(_METRICS)} FROM ev"))
def evaluate_on_splits(spark, sf):
    return r6(ev.evaluate(scored_long(spark, sf), BY))


@query("lift_curve", sql(LONG, """rk AS (SELECT model, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY model) AS n,
    sum((y=0)::int) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum((y=0)::int) OVER (PARTITION BY model) AS total
    FROM scored_long WINDOW w AS (PARTITION BY model ORDER BY p0 DESC, id))""",
    """SELECT model, g::int AS grid, k, round(k/n::double, 6) AS contacted, round(cum/total::double, 6) AS captured,
    round((cum/k::double)/(total/n::double), 6) AS lift FROM rk JOIN range(1, 101) t(g) ON k = greatest(1, n*g//100)"""))
def lift_curve(spark, sf):
    return r6(ev.lift_curve(scored_long(spark, sf), ["model"]))


# --- comparisons ---------------------------------------------------------------------------------------------

_EVAL_LONG = ",\n".join([LONG, frag.evaluate_cte("ev", "scored_long", SB), frag.long_cte("el", "ev", SB)])


def metrics_long(spark, sf):
    return ev.to_long(ev.evaluate(scored_long(spark, sf), BY), BY)


@query("covariate_shift_delta", sql(_EVAL_LONG, """d AS (SELECT model, metric,
    max(value) FILTER (split='silent_test') AS value_new, max(value) FILTER (split='respondent_test') AS value_old
    FROM el GROUP BY 1,2)""",
    """SELECT model, metric, round(value_new,6) AS value_new, round(value_old,6) AS value_old,
    round(value_new-value_old,6) AS delta, abs(value_new-value_old) < 0.05::double AS low_shift FROM d"""))
def covariate_shift_delta(spark, sf):
    return r6(ev.shift_delta(metrics_long(spark, sf), ["model"]))


@query("model_delta", sql(_EVAL_LONG, """b AS (SELECT split, metric, value AS base FROM el WHERE model='C2')""",
    """SELECT split, model, metric, round(value,6) AS value, round(base,6) AS base, round(value-base,6) AS delta,
    case when abs(value-base)<0.02::double then 'no gain' when value>base then 'gain' else 'loss' end AS verdict
    FROM el JOIN b USING (split, metric) WHERE model <> 'C2'"""))
def model_delta(spark, sf):
    return r6(ev.model_delta(metrics_long(spark, sf), ["split"], "C2"))


@query("champion_pick", sql(_EVAL_LONG, """SELECT split, round(max(value),6) AS value,
    arg_max(model, value) AS model FROM el WHERE metric='qwk' GROUP BY split"""))
def champion_pick(spark, sf):
    return r6(ev.champion(metrics_long(spark, sf), ["split"]))


# --- calibration ---------------------------------------------------------------------------------------------

_ARMS = "arms AS (" + " UNION ALL ".join(
    f"SELECT model, split, {k} AS class_idx, p{k} AS p, (y={k})::int AS hit FROM scored_long" for k in range(3)) + ")"
_EDGES = [f"({i} * 0.1::double)" for i in range(1, 10)]
_BIN = "(" + " + ".join(f"(p >= {e})::int" for e in _EDGES) + ")"
_EDGE_LIST = "['-infinity'::double, " + ", ".join(_EDGES) + ", 'infinity'::double]"
_CURVE = f"""curve AS (SELECT g.model, g.class_idx, b::int AS bin_id, {_EDGE_LIST}[b+1] AS bin_lo, {_EDGE_LIST}[b+2] AS bin_hi,
    coalesce(f.n, 0) AS n, predicted_mean, observed_rate
    FROM (SELECT DISTINCT model, class_idx FROM arms) g JOIN range(10) r(b) ON true
    LEFT JOIN (SELECT model, class_idx, {_BIN} AS bin_id, count(*) AS n, avg(p) AS predicted_mean, avg(hit) AS observed_rate
               FROM arms GROUP BY ALL) f ON f.model=g.model AND f.class_idx=g.class_idx AND f.bin_id=b)"""


@query("reliability_curve", sql(LONG, _ARMS, _CURVE, f"""SELECT model, class_idx, bin_id, {frag.rounded(
    ['bin_lo', 'bin_hi', 'predicted_mean', 'observed_rate'])}, n FROM curve"""))
def reliability_curve(spark, sf):
    return r6(cal.reliability_curve(scored_long(spark, sf), ["model"]))


@query("reliability_curve_quantile", sql(LONG, _ARMS, """q AS (SELECT model, class_idx,
    quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM arms GROUP BY ALL)""",
    """SELECT model, class_idx, len(list_filter(e, lambda x: p >= x))::int AS bin_id, count(*) AS n,
    round(avg(p),6) AS predicted_mean, round(avg(hit),6) AS observed_rate FROM arms JOIN q USING (model, class_idx) GROUP BY ALL"""))
def reliability_curve_quantile(spark, sf):
    curve = cal.reliability_curve(scored_long(spark, sf), ["model"], strategy="quantile")
    return r6(curve.filter("n > 0").drop("bin_lo", "bin_hi"))


@query("brier_per_class", sql(LONG, _ARMS, f"""SELECT {SB}, class_idx, round(avg((p-hit)*(p-hit)),6) AS brier
    FROM arms GROUP BY ALL"""))
def brier_per_class(spark, sf):
    return r6(cal.brier(scored_long(spark, sf), BY))


@query("ece_per_class", sql(LONG, _ARMS, _CURVE, """SELECT model, class_idx,
    round(sum(n*abs(predicted_mean-observed_rate))/sum(n),6) AS ece FROM curve GROUP BY ALL"""))
def ece_per_class(spark, sf):
    return r6(cal.ece(cal.reliability_curve(scored_long(spark, sf), ["model"]), ["model"]))


@query("calibration_report", sql(LONG, _ARMS, f"""cells AS (SELECT {SB}, class_idx, {_BIN} AS b, count(*) AS n,
    sum(p) AS sp, sum(hit) AS sh, sum((p-hit)*(p-hit)) AS se FROM arms GROUP BY ALL)""",
    f"""SELECT {SB}, class_idx, sum(n)::bigint AS n, round(sum(se)/sum(n),6) AS brier, round(sum(abs(sp-sh))/sum(n),6) AS ece
    FROM cells GROUP BY ALL"""))
def calibration_report(spark, sf):
    return r6(cal.calibration_report(scored_long(spark, sf), BY))


# Second model's scores play the part of the recalibrated ones.
_PAIR = """pair AS (SELECT a.id, a.y, a.yp, a.p0, a.p1, a.p2, b.p0 AS q0, b.p1 AS q1, b.p2 AS q2, b.yp AS yq
    FROM scored_long a JOIN scored_long b USING (id) WHERE a.model='C1' AND b.model='C2')"""


def score_pair(spark, sf):
    both = scored_long(spark, sf)
    a = both.filter("model = 'C1'").select("id", "y", "yp", "p0", "p1", "p2")
    b = both.filter("model = 'C2'").select("id", F.col("p0").alias("q0"), F.col("p1").alias("q1"),
                                           F.col("p2").alias("q2"), F.col("yp").alias("yq"))
    return a.join(b, "id")


# Brier and ECE before and after, from `pair`.
AUDIT = ["arms AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, {k} AS class_idx, {c}{k} AS p, (y={k})::int AS hit FROM pair"
    for t, c in (("a", "p"), ("b", "q")) for k in range(3)) + ")",
    f"cells AS (SELECT t, class_idx, {_BIN} AS b, count(*) AS n, sum(p) AS sp, sum(hit) AS sh, sum((p-hit)*(p-hit)) AS se FROM arms GROUP BY ALL)",
    "rep AS (SELECT t, class_idx, sum(se)/sum(n) AS brier, sum(abs(sp-sh))/sum(n) AS ece FROM cells GROUP BY ALL)",
    """SELECT class_idx, round(a.brier,6) AS brier_before, round(a.ece,6) AS ece_before, round(b.brier,6) AS brier_after,
    round(b.ece,6) AS ece_after, round(b.brier-a.brier,6) AS brier_delta, round(b.ece-a.ece,6) AS ece_delta
    FROM (SELECT * FROM rep WHERE t='a') a JOIN (SELECT * FROM rep WHERE t='b') b USING (class_idx)"""]


@query("recalibration_audit", sql(LONG, _PAIR, *AUDIT))
def recalibration_audit(spark, sf):
    return r6(cal.recalibration_audit(score_pair(spark, sf), []))


_MODES = """tagged AS (SELECT id, y, yp, p0, 'before' AS mode FROM pair UNION ALL
    SELECT id, y, yq, q0, 'after_full' FROM pair UNION ALL SELECT id, y, yp, q0, 'after_hybrid' FROM pair)"""
_HEAD = {k: v for k, v in frag.LONG_METRICS.items() if k != "balanced_acc"}


# Headline metrics of the three prediction modes, from `pair`.
MODES = [_MODES, frag.evaluate_cte("ev", "tagged", "mode"),
    frag.long_cte("el", "ev", "mode", _HEAD), """w AS (SELECT metric, max(value) FILTER (mode='before') AS before,
    max(value) FILTER (mode='after_full') AS after_full, max(value) FILTER (mode='after_hybrid') AS after_hybrid FROM el GROUP BY 1)""",
    """SELECT metric, round(before,6) AS before, round(after_full,6) AS after_full, round(after_hybrid,6) AS after_hybrid,
    round(after_full-before,6) AS delta_full, round(after_hybrid-before,6) AS delta_hybrid FROM w"""]


@query("hybrid_modes", sql(LONG, _PAIR, *MODES))
def hybrid_modes(spark, sf):
    return r6(ev.hybrid_modes(score_pair(spark, sf)))

"""Queries on bootstrap intervals and group fairness of scored orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import ci_text, fairness_verdict
from ordinalis.operators import bootstrap as bs
from ordinalis.operators import evaluation as ev
from ordinalis.operators import fairness as fair
from ordinalis.plans import frag
from ordinalis.plans.evaluation import BY, SB
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import LONG, SCORED, SEG_LONG, SEGMENTS, scored, scored_long, sql, u_sql, with_segments
from ordinalis.session import small_side

B = 1000  # replicates of the index mode, the default of the operator
FEW = 12  # of the two queries that show one interval of it


def _draws(source: str, by: str, replicates: int) -> str:
    """Index-mode replicates as CTE `boot` (by, b, id, y, yp, p0), one row per draw."""
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {by}, y ORDER BY id) AS j,
      count(*) OVER (PARTITION BY {by}, y) AS nc FROM {source}),
picks AS (SELECT {by}, y, b, 1 + floor({u_sql('boot', 'b::varchar, y::varchar, j::varchar')} * nc)::bigint AS pick
      FROM placed, range(1, {replicates + 1}) r(b)),
boot AS (SELECT p.*, b FROM picks k JOIN placed p ON {' AND '.join(f'p.{c.strip()}=k.{c.strip()}' for c in by.split(','))}
      AND p.y=k.y AND p.j=k.pick)"""


def _boot(replicates: int) -> str:
    return ",\n".join([LONG, _draws("scored_long", SB, replicates), frag.evaluate_cte("bev", "boot", f"{SB}, b"),
                       frag.long_cte("bl", "bev", f"{SB}, b"), frag.evaluate_cte("pev", "scored_long", SB),
                       frag.long_cte("pl", "pev", SB),
                       f"""ci AS (SELECT {SB}, metric, quantile_cont(value, 0.025) AS ci_lo, quantile_cont(value, 0.975) AS ci_hi
                    FROM bl GROUP BY ALL)"""])


_BOOT = _boot(B)


@query("bootstrap_ci", sql(_boot(FEW), f"""SELECT {SB}, metric, round(value,6) AS value, round(ci_lo,6) AS ci_lo,
    round(ci_hi,6) AS ci_hi FROM pl JOIN ci USING ({SB}, metric) WHERE metric='qwk'"""))
def bootstrap_ci(spark, sf):
    rows = bs.bootstrap_all(scored_long(spark, sf), BY, FEW, mode="index", probabilities=False)
    return r6(rows.filter("metric = 'qwk'").drop("n_resamples", "ci"))


@query("bootstrap_all_metrics", sql(_BOOT, f"""SELECT {SB}, metric, round(value,6) AS value, round(ci_lo,6) AS ci_lo,
    round(ci_hi,6) AS ci_hi, {B} AS n_resamples, 0.95::double AS ci FROM pl JOIN ci USING ({SB}, metric)"""))
def bootstrap_all_metrics(spark, sf):
    return r6(bs.bootstrap_all(scored_long(spark, sf), BY, B, mode="index"))


@query("bootstrap_multinomial")
def bootstrap_multinomial(spark, sf):
    """The scalable mode with the full thousand replicates."""
    return r6(bs.bootstrap_all(scored_long(spark, sf), BY, 1000))


@query("ci_overlap", sql(_BOOT, f"""SELECT a.split, a.metric, round(a.ci_lo,6) AS lo_a, round(a.ci_hi,6) AS hi_a,
    round(b.ci_lo,6) AS lo_b, round(b.ci_hi,6) AS hi_b,
    case when a.ci_lo<=b.ci_hi and b.ci_lo<=a.ci_hi then 'overlap' else 'disjoint' end AS verdict
    FROM ci a JOIN ci b ON a.split=b.split AND a.metric=b.metric AND a.model='C1' AND b.model='C2'"""))
def ci_overlap(spark, sf):
    ci = bs.bootstrap_all(scored_long(spark, sf), BY, B, mode="index")
    return r6(ev.ci_overlap(ci, "model", "C1", "C2", ["split"]))


@query("report_table", sql(_BOOT, f"""f AS (SELECT {SB}, metric, printf('%.3f [%.3f, %.3f]', value, ci_lo, ci_hi) AS t
    FROM pl JOIN ci USING ({SB}, metric))""",
    f"""SELECT {SB}, {', '.join(f"max(t) FILTER (metric='{m}') AS {c}" for c, m in frag.LONG_METRICS.items())}
    FROM f GROUP BY {SB}"""))
def report_table(spark, sf):
    """Printed evaluation table: one formatted interval per model x split x metric."""
    ci = bs.bootstrap_all(scored_long(spark, sf), BY, B, mode="index")
    text = ci.withColumn("t", ci_text(F.col("value"), F.col("ci_lo"), F.col("ci_hi")))
    wide = text.groupBy(*BY).pivot("metric", list(ev.METRIC_NAMES.values())).agg(F.first("t"))
    return wide.select(*BY, *[F.col(f"`{m}`").alias(c) for c, m in ev.METRIC_NAMES.items()])


_HARD = """hard AS (
  SELECT 'narrow' AS kind, model, id, y, yp, 0.5::double + p0 * 0.002::double AS p0 FROM scored_long UNION ALL
  SELECT 'rare', model, id, case when y = 0 and id % 20 <> 0 then 1 else y end, yp, p0 * 0.0005::double FROM scored_long UNION ALL
  SELECT 'tied', model, id, y, yp, floor(p0 * 8) / 8 FROM scored_long)"""


def hard_scores(rows):
    """Scores in a sliver around a half, a class rarer by a factor of twenty with small scores, and eight tied scores."""
    def kind(name, y, p):
        return F.struct(F.lit(name).alias("kind"), y.cast("int").alias("y"), p.alias("p0"))
    y, p = F.col("y"), F.col("p0")
    arms = F.array(kind("narrow", y, 0.5 + p * 0.002), kind("rare", F.when((y == 0) & (F.col("id") % 20 != 0), 1).otherwise(y), p * 0.0005),
                   kind("tied", y, F.floor(p * 8) / 8))
    return rows.select("model", "id", "yp", F.explode(arms).alias("_a")).select("model", "id", "yp", "_a.*")


@query("lift_intervals", sql(LONG, _HARD, frag.lift_cte("hl", "hard", "kind, model"),
    """SELECT kind, model, metric, round(value, 6) AS value, true AS bracketed, true AS of_some_width
    FROM (SELECT kind, model, unnest(['lift@10', 'lift@20']) AS metric, unnest([lift_10, lift_20]) AS value FROM hl)"""))
def lift_intervals(spark, sf):
    """Lift on scores that are narrow, rare or tied, and whether its bootstrap interval holds it and is more than a point."""
    ci = bs.bootstrap_all(hard_scores(scored_long(spark, sf)), ["kind", "model"], 1000).where(F.col("metric").isin("lift@10", "lift@20"))
    return r6(ci.select("kind", "model", "metric", "value", F.col("value").between(F.col("ci_lo"), F.col("ci_hi")).alias("bracketed"),
                        (F.col("ci_hi") > F.col("ci_lo")).alias("of_some_width")))


@query("rolling_reference_ci")
def rolling_reference_ci(spark, sf):
    """Reference band at the size of a monitoring batch (a twelfth of the rows)."""
    cm = small_side(ev.confusion_counts(scored_long(spark, sf), ["model"]))
    size = scored(spark, sf).count() // 12
    reps = bs.multinomial_counts(cm, ["model"], 1000, batch=size)
    return r6(bs.intervals(bs.replicate_metrics(reps, ["model"]), ["model"]).withColumn("batch_size", F.lit(size)))


# --- fairness ------------------------------------------------------------------------------------------------

SEGS = list(SEGMENTS)
M = ["model"]
_MELT = "melted AS (" + " UNION ALL ".join(
    f"SELECT model, id, y, yp, p0, '{s}' AS segment, {s} AS \"group\" FROM seg_scored_long" for s in SEGS) + ")"
_SG = 'model, segment, "group"'
_COUNTS = frag.cm_cte("cm", "melted", _SG)
_RATES = "rates AS (" + " UNION ALL ".join(
    f"SELECT {_SG}, {k} AS class_idx, {frag.N}::bigint AS n_total, {frag.row(k)}::bigint AS n_class, "
    f"{frag.recall(k, True)} AS recall, {frag.selection(k)} AS selection_rate FROM cm" for k in (0, 2)) + ")"
_DI = """di AS (SELECT *, recall/nullif(rr,0) AS di, case when recall/nullif(rr,0) is null then 'undefined'
    when recall/nullif(rr,0) between 0.8::double and 1.25::double then 'fair' else 'biased' end AS di_status
    FROM (SELECT *, first_value("group") OVER w AS reference_group, first_value(recall) OVER w AS rr FROM rates
      WINDOW w AS (PARTITION BY model, segment, class_idx ORDER BY recall DESC NULLS LAST, "group"
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""


def _spread_sql(v: str, prefix: str) -> str:
    return f"""(SELECT model, segment, class_idx, max({v})-min({v}) AS {prefix},
      (arg_min("group", ({v}, "group")) FILTER ({v} = mx)) AS {prefix}_max_group,
      (arg_min("group", ({v}, "group"))) AS {prefix}_min_group
      FROM (SELECT *, max({v}) OVER (PARTITION BY model, segment, class_idx) AS mx FROM rates WHERE {v} IS NOT NULL)
      GROUP BY ALL)"""


_EOD = "eod AS " + _spread_sql("recall", "eod")
_DPD = "dpd AS " + _spread_sql("selection_rate", "dpd")
_WORST = """worst AS (SELECT model, segment, class_idx, di AS di_worst, "group" AS di_worst_group, reference_group AS di_reference_group,
    di_status FROM di WHERE di IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model, segment, class_idx
    ORDER BY abs(di-1) DESC, "group") = 1)"""
_AUDIT = """audit AS (SELECT *, case when di_worst between 0.8::double and 1.25::double and coalesce(abs(eod),0) < 0.1::double
    then 'fair' else 'disparity' end AS verdict FROM worst JOIN eod USING (model, segment, class_idx) JOIN dpd USING (model, segment, class_idx))"""
_FAIR = ",\n".join([SEG_LONG, _MELT, _COUNTS, _RATES])
_FULL = ",\n".join([_FAIR, _DI, _EOD, _DPD, _WORST, _AUDIT])


def counts(spark, sf):
    return fair.group_counts(with_segments(spark, sf, scored_long(spark, sf)), SEGS, M)


def rates(spark, sf):
    return fair.group_rates(small_side(counts(spark, sf)), M)


@query("segment_distribution", sql(SEG_LONG, _MELT, f"SELECT {_SG}, count(*) AS n FROM melted GROUP BY ALL"))
def segment_distribution(spark, sf):
    return fair.segment_sizes(with_segments(spark, sf, scored_long(spark, sf)), SEGS, M)


@query("group_recall", sql(_FAIR, f"SELECT {_SG}, class_idx, n_total, n_class, round(recall,6) AS recall FROM rates"))
def group_recall(spark, sf):
    return r6(rates(spark, sf).drop("selection_rate"))


@query("selection_rate", sql(_FAIR, f"SELECT {_SG}, class_idx, round(selection_rate,6) AS selection_rate FROM rates"))
def selection_rate(spark, sf):
    return r6(rates(spark, sf).drop("recall", "n_total", "n_class"))


@query("disparate_impact", sql(_FAIR, _DI, f"""SELECT {_SG}, class_idx, n_total, n_class, round(recall,6) AS recall,
    round(selection_rate,6) AS selection_rate, reference_group, round(di,6) AS di, di_status FROM di"""))
def disparate_impact(spark, sf):
    return r6(fair.disparate_impact(rates(spark, sf), M))


@query("equal_opportunity_diff", sql(_FAIR, _EOD, "SELECT * REPLACE (round(eod,6) AS eod) FROM eod"))
def equal_opportunity_diff(spark, sf):
    return r6(fair.equal_opportunity(rates(spark, sf), M))


@query("demographic_parity_diff", sql(_FAIR, _DPD, "SELECT * REPLACE (round(dpd,6) AS dpd) FROM dpd"))
def demographic_parity_diff(spark, sf):
    return r6(fair.demographic_parity(rates(spark, sf), M))


@query("worst_row", sql(_FAIR, _DI, _WORST, "SELECT * REPLACE (round(di_worst,6) AS di_worst) FROM worst"))
def worst_row(spark, sf):
    return r6(fair.worst_row(fair.disparate_impact(rates(spark, sf), M), M))


@query("audit_one", sql(_FULL, """SELECT * REPLACE (round(di_worst,6) AS di_worst, round(eod,6) AS eod, round(dpd,6) AS dpd)
    FROM audit WHERE class_idx=0"""))
def audit_one(spark, sf):
    return r6(fair.audit(small_side(counts(spark, sf)), M, (0,)))


@query("fairness_matrix", sql(_FULL, """SELECT * REPLACE (round(di_worst,6) AS di_worst, round(eod,6) AS eod, round(dpd,6) AS dpd),
    (count(*) FILTER (verdict='disparity') OVER (PARTITION BY model)) AS n_flagged FROM audit"""))
def fairness_matrix(spark, sf):
    table = small_side(fair.audit(small_side(counts(spark, sf)), M))
    return r6(table.join(fair.flagged(table, M).select("model", "n_flagged"), "model"))


@query("fairness_badge", sql(_FULL, """SELECT model, segment, class_idx, case when di_worst is null or eod is null then 'N/A'
    when di_worst between 0.8::double and 1.25::double and abs(eod) < 0.1::double then 'fair' else 'biased' end AS badge FROM audit"""))
def fairness_badge(spark, sf):
    table = fair.audit(small_side(counts(spark, sf)), M)
    return table.select("model", "segment", "class_idx", fairness_verdict(F.col("di_worst"), F.col("eod")).alias("badge"))


def _gboot(replicates: int) -> str:
    return ",\n".join([_FAIR, _draws("melted", _SG, replicates), frag.cm_cte("bcm", "boot", f"{_SG}, b"),
        "br AS (" + " UNION ALL ".join(f"SELECT {_SG}, b, {k} AS class_idx, {frag.recall(k, True)} AS r, {frag.selection(k)} AS s FROM bcm"
                                       for k in (0, 2)) + ")",
        f"""bands AS (SELECT {_SG}, class_idx, quantile_cont(r,0.025) AS rl, quantile_cont(r,0.975) AS rh,
    quantile_cont(s,0.025) AS sl, quantile_cont(s,0.975) AS sh FROM br GROUP BY ALL)"""])


@query("group_bootstrap", sql(_gboot(B), f"""SELECT {_SG}, class_idx, n_total, n_class, round(recall,6) AS recall,
    round(selection_rate,6) AS selection_rate,
    round(case when n_class>=5 and n_total>=15 then rl end,6) AS recall_ci_lo,
    round(case when n_class>=5 and n_total>=15 then rh end,6) AS recall_ci_hi,
    round(case when n_class>=5 and n_total>=15 then sl end,6) AS selection_rate_ci_lo,
    round(case when n_class>=5 and n_total>=15 then sh end,6) AS selection_rate_ci_hi
    FROM rates JOIN bands USING (model, segment, "group", class_idx)"""))
def group_bootstrap(spark, sf):
    return _group_intervals(spark, sf, B)


def _group_intervals(spark, sf, replicates):
    keys = [*M, "segment", "group"]
    long = fair.melt_segments(with_segments(spark, sf, scored_long(spark, sf)), SEGS, [*M, "id", "y", "yp"])
    drawn = bs.weighted_counts(bs.index_weights(long, keys, replicates), keys)
    return r6(bs.group_bootstrap(small_side(long.groupBy(*keys).agg(*cf.counts())), drawn, keys))


@query("group_bootstrap_multinomial")
def group_bootstrap_multinomial(spark, sf):
    """Same table with a thousand replicates from counts alone."""
    keys = [*M, "segment", "group"]
    cm = small_side(counts(spark, sf))
    return r6(bs.group_bootstrap(cm, bs.multinomial_counts(cm, keys, 1000), keys))


@query("format_ci", sql(_gboot(FEW), f"""SELECT {_SG}, class_idx, case when recall is null then '—' when n_class<5 or n_total<15
    then printf('%.3f', recall) else printf('%.3f [%.3f, %.3f]', recall, rl, rh) end AS recall_text
    FROM rates JOIN bands USING (model, segment, "group", class_idx)"""))
def format_ci(spark, sf):
    table = _group_intervals(spark, sf, FEW)
    text = ci_text(F.col("recall"), F.col("recall_ci_lo"), F.col("recall_ci_hi"))
    return table.select("model", "segment", "group", "class_idx", text.alias("recall_text"))


@query("segment_normalize", sql(SCORED, """SELECT id, case when (y=0)::int=1 then 'Yes' else 'No' end AS detractor,
    sat::varchar AS score FROM scored"""))
def segment_normalize(spark, sf):
    from ordinalis.functions.scalar import segment_value
    rows = scored(spark, sf)
    return rows.select("id", segment_value((F.col("y") == 0).cast("int"), True).alias("detractor"),
                       segment_value(F.col("sat"), False).alias("score"))


@query("counterfactual_transitions", sql(LONG, """pair AS (SELECT a.split, a.yp, b.yp AS yq FROM scored_long a JOIN scored_long b
    USING (id) WHERE a.model='C1' AND b.model='C2')""", """SELECT split, count(*) AS n, count(*) FILTER (yp<>yq) AS n_changed,
    round(count(*) FILTER (yp<>yq)/count(*)::double,6) AS change_rate,
    count(*) FILTER (yp=0 and yq<>0) AS detractor_to_other, count(*) FILTER (yp<>0 and yq=0) AS other_to_detractor,
    count(*) FILTER (yp=2 and yq<>2) AS promoter_to_other, count(*) FILTER (yp<>2 and yq=2) AS other_to_promoter
    FROM pair GROUP BY 1"""))
def counterfactual_transitions(spark, sf):
    both = scored_long(spark, sf)
    pairs = both.filter("model='C1'").select("id", "split", "yp").join(
        both.filter("model='C2'").select("id", F.col("yp").alias("yp_flip")), "id")
    return r6(fair.transitions(pairs, ["split"]))

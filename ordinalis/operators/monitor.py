"""Batch monitoring: KPIs per batch, reference bands, alerts and spec rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import alert_status, ratio
from ordinalis.operators.evaluation import evaluate, to_long
from ordinalis.operators.fairness import melt_segments
from ordinalis.operators.windows import escalate
from ordinalis.session import settle

KPIS = {"qwk": "qwk", "macro_f1": "macro_f1", "detractor_recall": "detractor_recall", "lift_10": "lift@10"}
# Metric -> class whose per-group recall band is its reference.
RECALL_CLASS = {"detractor_recall": 0, "promoter_recall": 2}
CELL = ["model", "metric", "segment", "group"]


def batch_extent(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    return df.groupBy("model", batch).agg(F.count(F.lit(1)).alias("batch_size"), F.min("id").alias("first_id"),
                                          F.max("id").alias("last_id"))


def batch_kpis(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(model, batch, batch_size, first_id, last_id, metric, value, segment, group) of the global KPIs."""
    keys = ["model", batch]
    long = to_long(evaluate(df, keys), keys, KPIS).join(batch_extent(df, batch), keys)
    nothing = F.lit(None).cast("string")
    return long.select("model", batch, "batch_size", "first_id", "last_id", "metric", "value",
                       nothing.alias("segment"), nothing.alias("group"))


def batch_segment_recall(df: DataFrame, segments: list[str], batch: str = "batch_id") -> DataFrame:
    """Detractor recall per model x batch x segment x group, same columns; NULL groups are left out."""
    keys = ["model", batch, "segment", "group"]
    counts = (melt_segments(df, segments, ["model", batch, "y", "yp"]).filter(F.col("group").isNotNull())
              .groupBy(*keys).agg(*cf.counts()))
    out = counts.select(*keys, F.lit("detractor_recall").alias("metric"), cf.recall(0, None).alias("value"))
    return out.join(batch_extent(df, batch), ["model", batch]).select(
        "model", batch, "batch_size", "first_id", "last_id", "metric", "value", "segment", "group")


def kpi_stability(kpis: DataFrame) -> DataFrame:
    return kpis.filter(F.col("segment").isNull()).groupBy("model", "metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"))


def reference_ci(cells: DataFrame, per_group: DataFrame, headline: DataFrame, split: str = "silent_test") -> DataFrame:
    """Add ref_lo, ref_hi, ref_source: the group's own band, else the headline band of the metric, else none.

    Both reference tables are result tables; the join strategy is left to AQE's size check.
    """
    of_class = F.lit(None).cast("int")
    for metric, k in RECALL_CLASS.items():
        of_class = F.when(F.col("metric") == metric, k).otherwise(of_class)
    own = per_group.filter(F.col("recall_ci_lo").isNotNull() & F.col("recall_ci_hi").isNotNull()).select(
        "model", "segment", "group", F.col("class_idx").alias("_class"), F.col("recall_ci_lo").alias("_lo1"),
        F.col("recall_ci_hi").alias("_hi1"))
    main = headline.filter(F.col("split") == split).select(
        "model", "metric", F.col("ci_lo").alias("_lo2"), F.col("ci_hi").alias("_hi2"), F.lit(True).alias("_found"))
    out = (cells.withColumn("_class", of_class).join(own, ["model", "segment", "group", "_class"], "left")
           .join(main, ["model", "metric"], "left"))
    has_own = F.col("_lo1").isNotNull()
    return (out.withColumn("ref_lo", F.coalesce("_lo1", "_lo2")).withColumn("ref_hi", F.coalesce("_hi1", "_hi2"))
            .withColumn("ref_source", F.when(has_own, "per_segment").when(F.col("_found"), "headline").otherwise("no_reference"))
            .drop("_class", "_lo1", "_hi1", "_lo2", "_hi2", "_found"))


def alert_table(kpis: DataFrame, per_group: DataFrame, headline: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Status against the reference band and severity against the previous batch for every cell.

    Window partitions treat NULL segment / group as equal, so global cells need no stand-in value. The three inputs are result
    tables with long plans; they are settled, as one plan of all of them takes the driver longer than the work itself.
    """
    placed = reference_ci(settle(kpis), settle(per_group), settle(headline))
    placed = placed.withColumn("status", alert_status(F.col("value"), F.col("ref_lo"), F.col("ref_hi")))
    out = escalate(placed, CELL, batch)
    return out.select("model", batch, "metric", "segment", "group", F.col("value").alias("observed"), "ref_lo", "ref_hi",
                      "ref_source", "status", "severity", "batch_size")


def alert_summary(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "warn", "alert")])


def threshold_rules(monthly: DataFrame, by: list[str], period: str, ece: str = "ece", rate: str = "selection_rate") -> DataFrame:
    """Fixed rules: ECE above 0.08 warns, above 0.10 twice in a row alerts; selection rate in percent warns outside
    [16, 26] and alerts outside [13, 30]."""
    order = W.partitionBy(*by).orderBy(period)
    high = F.col(ece) > 0.10
    twice = high & F.coalesce(F.lag(high).over(order), F.lit(False))
    pct = F.col(rate) * 100
    return (monthly.withColumn("ece_status", F.when(F.col(ece).isNull(), "ok").when(twice, "alert")
                               .when(F.col(ece) > 0.08, "warn").otherwise("ok"))
            .withColumn("selection_status", F.when(pct.isNull(), "ok").when(~pct.between(13, 30), "alert")
                        .when(~pct.between(16, 26), "warn").otherwise("ok")))


def label_join(events: DataFrame, labels: DataFrame, key: str, ts: str, until: Column, days: int = 30) -> DataFrame:
    """Scoring events of the last `days` before `until` with their survey truth; the time filter reaches the scan."""
    recent = events.filter((F.col(ts) > until - F.make_interval(days=F.lit(days))) & (F.col(ts) <= until))
    return recent.join(labels, key)


def population_kpis(df: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), *[F.count_if(F.col("yp") == k).alias(f"n_{k}") for k in range(3)],
                               *[ratio(F.count_if(F.col("yp") == k), n).alias(f"share_{k}") for k in range(3)])


def score_integrity(wide: DataFrame, models: list[str]) -> DataFrame:
    """(rule, violations) over a side-by-side score table p0_<m>, p1_<m>, p2_<m>, yp_<m>, rank_<m>, agreement."""
    aggs = []
    for m in models:
        p = [F.col(f"p{k}_{m}") for k in range(3)]
        best = F.greatest(*p)
        chosen = F.when(F.col(f"yp_{m}") == 0, p[0]).when(F.col(f"yp_{m}") == 1, p[1]).otherwise(p[2])
        aggs += [F.count_if(~(p[0].between(0, 1) & p[1].between(0, 1) & p[2].between(0, 1))).alias(f"probability_range_{m}"),
                 F.count_if(F.abs(p[0] + p[1] + p[2] - 1) > 1e-3).alias(f"probability_sum_{m}"),
                 F.count_if(chosen < best).alias(f"argmax_{m}"),
                 F.count_if(F.col(f"rank_{m}") < 1).alias(f"rank_min_{m}"),
                 (F.max(f"rank_{m}") > F.count(F.lit(1))).cast("long").alias(f"rank_max_{m}")]
    if len(models) == 2:
        a, b = (F.col(f"yp_{m}") for m in models)
        aggs.append(F.count_if(F.col("agreement") != (a == b)).alias("agreement"))
    counted = wide.agg(*aggs)
    arms = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(x).alias("violations")) for x in counted.columns])).alias("_r")
    return counted.select(arms).select("_r.*")


def agreement(wide: DataFrame, a: str, b: str) -> DataFrame:
    same = F.count_if(F.col(a) == F.col(b))
    return wide.agg(F.count(F.lit(1)).alias("n"), same.alias("n_agree"), ratio(same, F.count(F.lit(1))).alias("agreement"))


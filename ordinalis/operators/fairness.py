"""Group fairness: recall, selection rate and their disparities, all from confusion counts per (segment, group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.constants import FAIR_DI, FAIR_EOD
from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import ratio

AUDITED = (0, 2)


def melt_segments(df: DataFrame, segments: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, segment): map-side, so that every segment is counted in the same shuffle."""
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("group"))
                               for s in segments])).alias("_s")
    return df.select(*keep, arms).select(*keep, "_s.*")


def group_counts(df: DataFrame, segments: list[str], by: list[str]) -> DataFrame:
    keys = [*by, "segment", "group"]
    return melt_segments(df, segments, [*by, "y", "yp"]).groupBy(*keys).agg(*cf.counts())


def group_rates(counts: DataFrame, by: list[str], classes=AUDITED) -> DataFrame:
    """(by, segment, group, class_idx, n_total, n_class, recall, selection_rate); recall is NULL without positives."""
    arms = F.explode(F.array(*[F.struct(
        F.lit(k).alias("class_idx"), cf.total().cast("long").alias("n_total"),
        cf.true_total(k).cast("long").alias("n_class"),
        cf.recall(k, None).alias("recall"), cf.selection_rate(k).alias("selection_rate")) for k in classes])).alias("_k")
    keys = [*by, "segment", "group"]
    return counts.select(*keys, arms).select(*keys, "_k.*")


def disparate_impact(rates: DataFrame, by: list[str], reference: str | None = None) -> DataFrame:
    """Recall over the reference group's recall; by default the best group, first in name order."""
    cell = [*by, "segment", "class_idx"]
    # windows over the groups of one segment: aggregated rows, never base rows
    if reference is None:
        ordered = W.partitionBy(*cell).orderBy(F.col("recall").desc_nulls_last(), F.col("group").asc())
        ordered = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ref_group, ref_recall = F.first("group").over(ordered), F.first("recall").over(ordered)
    else:
        ref_group = F.lit(reference)
        ref_recall = F.max(F.when(F.col("group") == reference, F.col("recall"))).over(W.partitionBy(*cell))
    out = (rates.withColumn("reference_group", ref_group).withColumn("_ref", ref_recall)
           .withColumn("di", ratio(F.col("recall"), F.col("_ref"))))
    status = (F.when(F.col("di").isNull(), "undefined").when(F.col("di").between(*FAIR_DI), "fair")
              .otherwise("biased"))
    return out.withColumn("di_status", status).drop("_ref")


def spread(rates: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """max - min of a rate over the groups of a segment, with the groups that hold them (NULL rates are ignored)."""
    up = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col("group"))))
    down = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("group"))))
    return rates.groupBy(*by, "segment", "class_idx").agg(
        (F.max(value) - F.min(value)).alias(prefix), up.getField("group").alias(f"{prefix}_max_group"),
        down.getField("group").alias(f"{prefix}_min_group"))


def equal_opportunity(rates: DataFrame, by: list[str]) -> DataFrame:
    return spread(rates, by, "recall", "eod")


def demographic_parity(rates: DataFrame, by: list[str]) -> DataFrame:
    return spread(rates, by, "selection_rate", "dpd")


def worst_row(impact: DataFrame, by: list[str]) -> DataFrame:
    """The group whose disparate impact is furthest from 1, first in name order on ties."""
    pick = F.min(F.when(F.col("di").isNotNull(), F.struct(
        (-F.abs(F.col("di") - 1.0)).alias("v"), F.col("group"), F.col("di"), F.col("reference_group"),
        F.col("di_status"))))
    out = impact.groupBy(*by, "segment", "class_idx").agg(pick.alias("_w"))
    return out.select(*by, "segment", "class_idx", F.col("_w.di").alias("di_worst"),
                      F.col("_w.group").alias("di_worst_group"),
                      F.col("_w.reference_group").alias("di_reference_group"),
                      F.col("_w.di_status").alias("di_status"))


def audit(counts: DataFrame, by: list[str], classes=AUDITED) -> DataFrame:
    """Worst DI, EOD and DPD per (segment, class) with the verdict of the 4/5 rule and the 0.10 EOD rule."""
    rates = group_rates(counts, by, classes)
    keys = [*by, "segment", "class_idx"]
    out = (worst_row(disparate_impact(rates, by), by).join(equal_opportunity(rates, by), keys)
           .join(demographic_parity(rates, by), keys))
    fair = F.col("di_worst").between(*FAIR_DI) & (F.coalesce(F.abs(F.col("eod")), F.lit(0.0)) < FAIR_EOD)
    return out.withColumn("verdict", F.when(F.coalesce(fair, F.lit(False)), "fair").otherwise("disparity"))


def flagged(audit_table: DataFrame, by: list[str]) -> DataFrame:
    """How many cells are not fair."""
    return audit_table.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"),
                                        F.count_if(F.col("verdict") == "disparity").alias("n_flagged"))


def segment_sizes(df: DataFrame, segments: list[str], by: list[str]) -> DataFrame:
    return melt_segments(df, segments, by).groupBy(*by, "segment", "group").agg(F.count(F.lit(1)).alias("n"))


def transitions(pairs: DataFrame, by: list[str], before: str = "yp", after: str = "yp_flip") -> DataFrame:
    """Prediction changes between two scorings of the same rows."""
    a, b = F.col(before), F.col(after)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a != b).alias("n_changed"),
        ratio(F.count_if(a != b), F.count(F.lit(1))).alias("change_rate"),
        F.count_if((a == 0) & (b != 0)).alias("detractor_to_other"),
        F.count_if((a != 0) & (b == 0)).alias("other_to_detractor"),
        F.count_if((a == 2) & (b != 2)).alias("promoter_to_other"),
        F.count_if((a != 2) & (b == 2)).alias("other_to_promoter"))

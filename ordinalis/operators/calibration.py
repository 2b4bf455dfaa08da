"""Reliability curves, Brier score and expected calibration error, one-vs-rest per class."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.functions.confusion import K
from ordinalis.functions.scalar import argmax3, ratio
from ordinalis.operators.ranking import exact_quantiles, join_on
from ordinalis.session import small_side


def by_class(df: DataFrame, keep: list[str], probs: tuple[str, ...] = ("p0", "p1", "p2")) -> DataFrame:
    """Long one-vs-rest form (keep, class_idx, p, hit); map-side, no shuffle."""
    arms = F.explode(F.array(*[
        F.struct(F.lit(k).alias("class_idx"), F.col(p).alias("p"), (F.col("y") == k).cast("int").alias("hit"))
        for k, p in enumerate(probs)])).alias("_k")
    return df.select(*keep, arms).select(*keep, "_k.*")


def uniform_edges(bins: int) -> list[float]:
    """Inner edges i * (1 / bins), computed in double."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def bin_of(p: Column, edges: list[Column]) -> Column:
    """Left-closed bin index: the number of inner edges at or below p."""
    return reduce(add, [(p >= e).cast("int") for e in edges], F.lit(0))


def reliability_curve(df: DataFrame, by: list[str], bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(by, class_idx, bin_id, bin_lo, bin_hi, n, predicted_mean, observed_rate), empty bins kept with NULL means."""
    long = by_class(df, by)
    keys = [*by, "class_idx"]
    if strategy == "quantile":
        names = {f"_e{i}": i / bins for i in range(1, bins)}
        edges_table = small_side(exact_quantiles(long, keys, "p", names))
        long = join_on(long, edges_table, keys)
        edges = [F.col(e) for e in names]
        extra = list(names)
    else:
        edges = [F.lit(e) for e in uniform_edges(bins)]
        extra = []
    filled = (long.withColumn("bin_id", bin_of(F.col("p"), edges)).groupBy(*keys, "bin_id")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted_mean"),
                   F.avg("hit").alias("observed_rate")))
    bounds = [F.lit(float("-inf")), *edges, F.lit(float("inf"))]
    spine_rows = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bin_id"), bounds[b].alias("bin_lo"), bounds[b + 1].alias("bin_hi"))
        for b in range(bins)])).alias("_b")
    groups = filled.select(*keys).distinct()
    if extra:
        groups = join_on(groups, edges_table, keys)
    spine = groups.select(*keys, spine_rows).select(*keys, "_b.*")
    return join_on(spine, filled, [*keys, "bin_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier(df: DataFrame, by: list[str]) -> DataFrame:
    long = by_class(df, by)
    err = F.col("p") - F.col("hit")
    return long.groupBy(*by, "class_idx").agg(F.avg(err * err).alias("brier"))


def ece(curve: DataFrame, by: list[str]) -> DataFrame:
    """Bin-weighted mean |predicted - observed| from a reliability curve."""
    gap = F.col("n") * F.abs(F.col("predicted_mean") - F.col("observed_rate"))
    return curve.groupBy(*by, "class_idx").agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def calibration_report(df: DataFrame, by: list[str], bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Brier and ECE per class."""
    if strategy == "uniform":
        # one pass: bins carry the sums from which both figures follow
        long = by_class(df, by)
        err = F.col("p") - F.col("hit")
        cells = (long.withColumn("bin_id", bin_of(F.col("p"), [F.lit(e) for e in uniform_edges(bins)]))
                 .groupBy(*by, "class_idx", "bin_id")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("hit").alias("sh"),
                      F.sum(err * err).alias("se")))
        return cells.groupBy(*by, "class_idx").agg(
            F.sum("n").alias("n"), ratio(F.sum("se"), F.sum("n")).alias("brier"),
            ratio(F.sum(F.abs(F.col("sp") - F.col("sh"))), F.sum("n")).alias("ece"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    both = join_on(brier(df, by), ece(reliability_curve(df, by, bins, strategy), by), [*by, "class_idx"])
    return join_on(both, sizes, by)


def recalibration_audit(df: DataFrame, by: list[str]) -> DataFrame:
    """Brier and ECE of p0..p2 against calibrated q0..q2, with deltas."""
    after = df.drop("p0", "p1", "p2").withColumnsRenamed({f"q{k}": f"p{k}" for k in range(K)})
    a = calibration_report(df, by).select(*by, "class_idx", F.col("brier").alias("brier_before"),
                                          F.col("ece").alias("ece_before"))
    b = calibration_report(after, by).select(*by, "class_idx", F.col("brier").alias("brier_after"),
                                             F.col("ece").alias("ece_after"))
    return join_on(a, b, [*by, "class_idx"]).select(
        "*", (F.col("brier_after") - F.col("brier_before")).alias("brier_delta"),
        (F.col("ece_after") - F.col("ece_before")).alias("ece_delta"))


def with_calibrated_argmax(df: DataFrame) -> DataFrame:
    return df.withColumn("yq", argmax3(F.col("q0"), F.col("q1"), F.col("q2")))

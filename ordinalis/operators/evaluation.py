"""Point metrics, lift and model comparison on scored tables (id, y, yp, p0, p1, p2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import ratio
from ordinalis.operators.ranking import attach_thresholds, join_on, with_position
from ordinalis.session import small_side

LIFT_SHARES = {"lift_10": 0.10, "lift_20": 0.20}
# Column of `evaluate` -> metric name in long results.
METRIC_NAMES = {"qwk": "qwk", "macro_f1": "macro_f1", "balanced_acc": "balanced_acc",
                "detractor_recall": "detractor_recall", "lift_10": "lift@10", "lift_20": "lift@20"}


def confusion_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nine counts per group: one aggregation, at most #groups rows per task cross the wire."""
    return df.groupBy(*(by or [])).agg(*cf.counts(), F.count(F.lit(1)).alias("n_rows"))


def confusion_long(cm: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, yp, n, share of the true class); absent cells are zero."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("y"), F.lit(j).alias("yp"), F.col(f"n{i}{j}").alias("n"),
                 ratio(F.col(f"n{i}{j}"), cf.true_total(i)).alias("share"))
        for i in range(cf.K) for j in range(cf.K)])).alias("_c")
    return cm.select(*by, cells).select(*by, "_c.*")


def top_share_size(share: float) -> Column:
    """k = max(1, floor(n * share)) over the group size `n`."""
    return F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))


def lift(df: DataFrame, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """Detractor rate among the top-k by p0 over the base rate, one column per share; ties go to the lower id."""
    shares = shares or LIFT_SHARES
    ranked = df.select(*by, "id", "y", (-F.col("p0")).alias("_s"))
    flagged = attach_thresholds(ranked, by, "_s", "id", {name: top_share_size(s) for name, s in shares.items()})
    agg = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 0).alias("_pos"),
        *[F.count_if(F.col(name) & (F.col("y") == 0)).alias(f"_hit_{name}") for name in shares],
        *[F.count_if(F.col(name)).alias(f"_k_{name}") for name in shares])
    return agg.select(*by, *[
        F.coalesce(F.try_divide(ratio(F.col(f"_hit_{n}"), F.col(f"_k_{n}")), ratio(F.col("_pos"), F.col("_n"))),
                   F.lit(0.0)).alias(n) for n in shares])


def point_metrics(cm: DataFrame, by: list[str]) -> DataFrame:
    return cm.select(
        *by, cf.total().cast("long").alias("n"),
        cf.qwk().alias("qwk"), cf.macro_f1().alias("macro_f1"), cf.balanced_accuracy().alias("balanced_acc"),
        cf.recall(0).alias("detractor_recall"), cf.recall(0).alias("recall_detractor"),
        cf.recall(1).alias("recall_passive"), cf.recall(2).alias("recall_promoter"))


def evaluate(df: DataFrame, by: list[str], probabilities: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """One wide row of metrics per group; put `split`, `model`, `batch` ... into `by` to evaluate all in one pass."""
    if not probabilities:
        return point_metrics(counts if counts is not None else confusion_counts(df, by), by)
    cm = counts if counts is not None else confusion_counts(df, by)
    return join_on(point_metrics(cm, by), lift(df, by), by)


def to_long(wide: DataFrame, by: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Wide metric columns to (by, metric, value)."""
    names = names or METRIC_NAMES
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
                                for c, label in names.items() if c in wide.columns])).alias("_m")
    return wide.select(*by, pairs).select(*by, "_m.*")


def lift_curve(df: DataFrame, by: list[str], points: int = 100) -> DataFrame:
    """Cumulative share of detractors captured and lift, read off at `points` even shares of the population."""
    ranked = df.select(*by, "id", (F.col("y") == 0).cast("long").alias("_pos"), (-F.col("p0")).alias("_s"))
    run = with_position(ranked, by, [F.col("_s").asc(), F.col("id").asc()], "_k", {"_cum": F.col("_pos")})
    totals = small_side(ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_pos").alias("_total")))
    rows = join_on(run, totals, by)
    # position k serves the grid points g with max(1, n * g div points) = k: a short integer range
    k, size, p = F.col("_k"), F.col("_n"), F.lit(points)
    def ceil_div(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b)
    first = F.when(k == 1, F.lit(1)).otherwise(ceil_div(k * p, size))
    last = F.least(p, ceil_div((k + 1) * p, size) - 1)
    marks = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    return (rows.withColumn("grid", F.explode(marks))
            .select(*by, "grid", F.col("_k").alias("k"),
                    ratio(F.col("_k"), size).alias("contacted"),
                    ratio(F.col("_cum"), F.col("_total")).alias("captured"),
                    F.try_divide(ratio(F.col("_cum"), F.col("_k")), ratio(F.col("_total"), size)).alias("lift")))


def ci_overlap(ci: DataFrame, model: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Do the intervals of two models overlap, per metric?"""
    left = ci.filter(F.col(model) == a).select(*by, "metric", F.col("ci_lo").alias("lo_a"), F.col("ci_hi").alias("hi_a"))
    right = ci.filter(F.col(model) == b).select(*by, "metric", F.col("ci_lo").alias("lo_b"), F.col("ci_hi").alias("hi_b"))
    both = (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    return join_on(left, right, [*by, "metric"]).withColumn("verdict", F.when(both, "overlap").otherwise("disjoint"))


def shift_delta(long: DataFrame, by: list[str], new: str = "silent_test", old: str = "respondent_test",
                limit: float = 0.05) -> DataFrame:
    """metric(new split) - metric(old split) and whether the shift is low."""
    wide = long.groupBy(*by, "metric").agg(F.max(F.when(F.col("split") == new, F.col("value"))).alias("value_new"),
                                           F.max(F.when(F.col("split") == old, F.col("value"))).alias("value_old"))
    delta = F.col("value_new") - F.col("value_old")
    return wide.withColumn("delta", delta).withColumn(
        "low_shift", F.when(delta.isNotNull(), F.abs(delta) < limit))


def model_delta(long: DataFrame, by: list[str], baseline: str, limit: float = 0.02) -> DataFrame:
    """Metric of every model minus the baseline model's; |delta| below the limit reads 'no gain'."""
    base = small_side(long.filter(F.col("model") == baseline).select(*by, "metric", F.col("value").alias("base")))
    delta = F.col("value") - F.col("base")
    return join_on(long.filter(F.col("model") != baseline), base, [*by, "metric"]).select(
        *by, "model", "metric", "value", "base", delta.alias("delta"),
        F.when(F.abs(delta) < limit, "no gain").when(delta > 0, "gain").otherwise("loss").alias("verdict"))


def champion(long: DataFrame, by: list[str], metric: str = "qwk") -> DataFrame:
    """Model with the best value of a metric; ties to the first name."""
    best = F.max(F.struct(F.col("value"), F.col("model")))
    worst_name = F.min(F.struct((-F.col("value")).alias("v"), F.col("model")))
    return (long.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(*by)
            .agg(best.getField("value").alias("value"), worst_name.getField("model").alias("model")))


def hybrid_modes(df: DataFrame) -> DataFrame:
    """Metrics before recalibration, after it, and for the hybrid (calibrated p, original prediction).

    `df` holds y, yp, p0..p2 and calibrated q0..q2 with their own argmax yq.
    """
    mode = lambda name, yp, p: F.struct(
        F.lit(name).alias("mode"), F.col(yp).cast("int").alias("yp"), F.col(p).alias("p0"))
    tagged = df.select("id", "y", F.explode(F.array(
        mode("before", "yp", "p0"), mode("after_full", "yq", "q0"), mode("after_hybrid", "yp", "q0"))).alias("_m"))
    tagged = tagged.select("id", "y", "_m.*")
    long = to_long(evaluate(tagged, ["mode"]), ["mode"])
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("value")))
    wide = long.filter(F.col("metric") != "balanced_acc").groupBy("metric").agg(
        at("before").alias("before"), at("after_full").alias("after_full"), at("after_hybrid").alias("after_hybrid"))
    return (wide.withColumn("delta_full", F.col("after_full") - F.col("before"))
            .withColumn("delta_hybrid", F.col("after_hybrid") - F.col("before")))

"""Attributions: linear coefficients, permutation importance, archetypes and counterfactual swaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.functions.hashing import uniform
from ordinalis.operators.fairness import melt_segments, transitions
from ordinalis.operators.features import flip_binary
from ordinalis.operators.ranking import top_k_per_group, with_position
from ordinalis.session import settle, small_side

MIN_GROUP = 20


def coefficient_table(spark: SparkSession, matrix, names: list[str]) -> DataFrame:
    """(class_idx, pos, feature, coef) of a fitted linear model: classes x features numbers."""
    rows = [(k, j, names[j], float(matrix[k, j])) for k in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "class_idx int, pos int, feature string, coef double")


def feature_std(df: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """(by, pos, std, n): population std of every vector slot, summarised without exploding the rows."""
    stats = df.groupBy(*by).agg(Summarizer.metrics("variance", "count").summary(F.col(features)).alias("_s"))
    n = F.col("_s.count")
    slots = stats.select(*by, n.alias("n"), F.posexplode(vector_to_array("_s.variance")).alias("pos", "_v"))
    return slots.select(*by, "pos", F.sqrt(F.col("_v") * (F.col("n") - 1) / F.col("n")).alias("std"), "n")


def _sign(x: Column) -> Column:
    return F.when(x > 0, "+").when(x < 0, "−").otherwise("0")


def linear_importance(coef: DataFrame, std: DataFrame) -> DataFrame:
    """|coef * std| per class and feature with its rank in the class."""
    out = coef.join(std.select("pos", "std"), "pos").withColumn("coef_times_std", F.col("coef") * F.col("std"))
    out = out.withColumn("abs_coef_times_std", F.abs("coef_times_std")).withColumn("sign", _sign(F.col("coef")))
    order = W.partitionBy("class_idx").orderBy(F.col("abs_coef_times_std").desc(), F.col("feature").asc())
    return out.withColumn("rank_in_class", F.row_number().over(order)).drop("pos")


def linear_contributions(coef: DataFrame, rows: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """coef of the predicted class times the feature value, for every row; the coefficient table is size-checked."""
    slots = rows.select(key, *(keep or []), F.col("yp").alias("class_idx"), F.posexplode(vector_to_array("features")).alias("pos", "feature_value"))
    out = slots.join(small_side(coef), ["class_idx", "pos"])
    contribution = F.col("coef") * F.col("feature_value")
    return out.select(key, *(keep or []), "class_idx", "feature", "feature_value", contribution.alias("contribution"),
                      F.abs(contribution).alias("abs_contribution"))


def linear_segment_importance(coef: DataFrame, df: DataFrame, segments: list[str], top: int = 15) -> DataFrame:
    """Strongest |coef * std within the group| per segment, group and class; small groups are left out."""
    keys = ["segment", "group"]
    std = feature_std(melt_segments(df, segments, ["features"]), keys).filter(F.col("n") >= MIN_GROUP)
    out = std.join(coef, "pos").withColumn("abs_contrib", F.abs(F.col("coef") * F.col("std")))
    best = top_k_per_group(out, [*keys, "class_idx"], [F.col("abs_contrib").desc(), F.col("feature").asc()], top)
    return best.select(*keys, "class_idx", "feature", "coef", F.col("std").alias("std_in_group"), "abs_contrib",
                       F.col("n").alias("n_in_group"), "rank")


def waterfall(contributions: DataFrame, key: str, value, k: int = 10) -> DataFrame:
    """Largest contributions of one row."""
    return (contributions.filter(F.col(key) == value)
            .orderBy(F.col("abs_contribution").desc(), F.col("feature").asc()).limit(k))


def pick_archetypes(scored: DataFrame, n: int = 1, key: str = "id") -> DataFrame:
    """Per true class the correctly classified rows with the highest probability of it; any row of the class if none is."""
    own = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2"))
    rows = scored.filter(F.col("y").isNotNull()).withColumn("p_class", own).withColumn(
        "correct", F.coalesce(F.col("y") == F.col("yp"), F.lit(False)))
    top = top_k_per_group(rows, ["y"], [F.col("correct").desc(), F.col("p_class").desc(), F.col(key).asc()], n)
    any_correct = F.max(F.col("correct").cast("int")).over(W.partitionBy("y"))  # at most n rows per class
    return top.withColumn("_any", any_correct).filter(F.col("correct") | (F.col("_any") == 0)).drop("_any")


# --- permutation importance --------------------------------------------------------------------------------------

def with_donor(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Give every row the feature vector of another row by a random permutation of the whole table.

    Two keyed-hash orders of the ids are matched by position: two narrow distributed sorts and equi-joins on unique keys,
    shared by all features.
    """
    ids = df.select(key)
    first = with_position(ids.withColumn("_u", uniform(seed, "perm1", F.col(key))), [], [F.col("_u").asc(), F.col(key).asc()], "_p")
    second = with_position(ids.withColumn("_u", uniform(seed, "perm2", F.col(key))), [], [F.col("_u").asc(), F.col(key).asc()], "_p")
    pairs = first.select(key, "_p").join(second.select(F.col(key).alias("_donor"), "_p"), "_p").drop("_p")
    donors = df.select(F.col(key).alias("_donor"), F.col("features").alias("_donated"))
    return df.join(pairs, key).join(donors, "_donor").drop("_donor")


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, names: list[str], key: str = "id",
                           by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(by, class_idx, feature, mean_abs_change, n, is_component, rank_in_class).

    For every feature the slot is replaced by the donor's and the mean absolute change of each class probability is
    taken.  All features are scored in one pass over (rows x features).
    """
    by = by or []
    base = settle(score(with_donor(df.select(key, *by, "features"), key, seed)))
    own, donated = vector_to_array("features"), vector_to_array("_donated")
    spread = base.select(*by, *[F.col(f"p{k}").alias(f"_own{k}") for k in range(3)],
                         own.alias("_own"), donated.alias("_given"),
                         F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("pos"))
    swapped = F.transform("_own", lambda v, i: F.when(i == F.col("pos"), F.col("_given").getItem(i)).otherwise(v))
    moved = score(spread.select(*by, "pos", "_own0", "_own1", "_own2", array_to_vector(swapped).alias("features")))
    wide = moved.groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("n"),
                                         *[F.avg(F.abs(F.col(f"p{k}") - F.col(f"_own{k}"))).alias(f"m{k}") for k in range(3)])
    arms = F.explode(F.array(*[F.struct(F.lit(k).alias("class_idx"), F.col(f"m{k}").alias("mean_abs_change")) for k in range(3)])).alias("_k")
    feature = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("pos") + 1)
    out = wide.select(*by, "n", feature.alias("feature"), arms).select(*by, "_k.class_idx", "feature", "_k.mean_abs_change", "n")
    order = W.partitionBy(*by, "class_idx").orderBy(F.col("mean_abs_change").desc(), F.col("feature").asc())
    return out.withColumn("is_component", F.col("feature").startswith("PC")).withColumn("rank_in_class", F.row_number().over(order))


def segment_permutation(score: Callable[[DataFrame], DataFrame], df: DataFrame, names: list[str], segments: list[str],
                        key: str = "id", top: int = 15) -> DataFrame:
    """Permutation importance within groups of at least MIN_GROUP rows."""
    long = df.withColumn("_seg", F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"`{s}`").cast("string").alias("group"))
                                           for s in segments]))
    table = permutation_importance(score, long.select(key, "features", F.explode("_seg").alias("_s"))
                                   .select(F.concat_ws("#", F.col(key).cast("string"), "_s.segment").alias(key), "features", "_s.*"),
                                   names, key, ["segment", "group"])
    return table.filter((F.col("n") >= MIN_GROUP) & (F.col("rank_in_class") <= top))


# --- counterfactual swap -------------------------------------------------------------------------------------------

def counterfactual_flip(df: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Swap each protected column in turn, re-score and count changed predictions.

    `predict` adds `yp` to raw rows.  Both scorings stay on the same row, so nothing is joined.
    """
    out = None
    for name in columns:
        before = predict(df).select(*[F.col(f"`{x}`") for x in df.columns], F.col("yp").alias("_yp"))
        after = predict(flip_binary(before, name, df)).select(F.lit(name).alias("segment"), F.col("_yp").alias("yp"), F.col("yp").alias("yp_flip"))
        out = after if out is None else out.unionByName(after)
    return transitions(out, ["segment"])

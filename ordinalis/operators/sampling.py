"""Random splits and samples from keyed hashes: independent of row order and partitioning, checkable in SQL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import RESPONSE_WEIGHTS, SEED
from ordinalis.functions.hashing import gaussian, uniform
from ordinalis.functions.scalar import sigmoid
from ordinalis.operators.prep import c
from ordinalis.operators.ranking import attach_thresholds, kth_element, top_k_per_group, with_position

RESPONDENTS = ("train", "val", "respondent_test")


def zscore(df: DataFrame, column: str) -> Column:
    """(x - mean) / sample std as a Column; a constant column gives 0.  The statistics are one scalar subquery."""
    x = c(column).cast("double")
    stats = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar()
    m, s = stats.getField("m"), stats.getField("s")
    return F.when(s.isNull() | (s == 0), F.lit(0.0)).otherwise((x - m) / s)


def propensity_features(df: DataFrame, tenure: str = "Tenure Months", age: str = "Age",
                        paperless: str = "Paperless Billing", payment: str = "Payment Method",
                        contract: str = "Contract") -> dict[str, Column]:
    """Inputs of the response model; absent columns take their neutral value."""
    text = lambda name: F.coalesce(F.lower(c(name).cast("string")), F.lit(""))
    flag = lambda name, cond: cond.cast("double") if name in df.columns else F.lit(0.5)
    return {
        "tenure": zscore(df, tenure) if tenure in df.columns else F.lit(0.0),
        "paperless_billing": flag(paperless, text(paperless) == "yes"),
        "autopay": flag(payment, text(payment).contains("automatic")),
        "age": zscore(df, age) if age in df.columns else F.lit(0.0),
        "month_to_month": flag(contract, text(contract) == "month-to-month")}


def response_propensity(df: DataFrame, key: str, weights: dict[str, float] | None = None, noise: float = 0.5,
                        seed: int = SEED) -> Column:
    """Probability of answering: sigmoid of the weighted inputs plus keyed Gaussian noise."""
    inputs = propensity_features(df)
    logit = gaussian(seed, "prop", c(key)) * noise
    for name, beta in (weights or RESPONSE_WEIGHTS).items():
        if name in inputs:
            logit = logit + inputs[name] * beta
    return sigmoid(logit)


def _share(size: float) -> Column:
    return F.bround(F.col("n") * F.lit(size))


def naive_split(df: DataFrame, key: str, label: str, train: float = 0.6, val: float = 0.2, seed: int = SEED,
                tag: str = "naive", last: str = "test") -> DataFrame:
    """(key, split): exact stratified shares by hash order within each class."""
    if train + val >= 1.0:
        raise ValueError(f"train + val = {train + val} leaves no room for a test split")
    keyed = df.select(c(key), c(label).alias("_y")).withColumn("_u", uniform(seed, tag, c(key)))
    cut = attach_thresholds(keyed, ["_y"], "_u", key, {"_train": _share(train), "_upto_val": _share(train) + _share(val)})
    return cut.select(c(key), F.when(F.col("_train"), "train").when(F.col("_upto_val"), "val").otherwise(last).alias("split"))


def weighted_sample(df: DataFrame, key: str, weight: Column, rate: float, seed: int = SEED) -> DataFrame:
    """(key, sampled): round(rate * n) ids drawn without replacement with probability proportional to `weight`.

    Exponential keys -ln(u) / w: keeping the smallest ones has the distribution of successive weighted draws.
    """
    keyed = df.select(c(key), weight.alias("_w")).withColumn("_e", -F.ln(F.lit(1.0) - uniform(seed, "wor", c(key))) / F.col("_w"))
    cut = attach_thresholds(keyed, [], "_e", key, {"sampled": _share(rate)})
    return cut.select(c(key), "sampled")


def response_biased_split(df: DataFrame, key: str, label: str, rate: float = 0.15, train: float = 0.6, val: float = 0.2,
                          seed: int = SEED) -> DataFrame:
    """(key, split): a biased sample of respondents split 60/20/20 within class, everyone else silent."""
    drawn = weighted_sample(df, key, response_propensity(df, key, seed=seed), rate, seed + 1)
    respondents = drawn.filter("sampled").join(df.select(c(key), c(label)), key)
    inner = naive_split(respondents, key, label, train, val, seed + 2, "resp", "respondent_test")
    return df.select(c(key)).join(inner, key, "left").select(c(key), F.coalesce("split", F.lit("silent_test")).alias("split"))


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = SEED) -> DataFrame:
    """About n ids keeping the class mix, at least one per class; everything when there are no more than n rows."""
    total = df.agg(F.count(c(label))).scalar()
    quota = F.when(total <= n, F.col("n")).otherwise(
        F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("n") / total))))
    keyed = df.filter(c(label).isNotNull()).select(c(key), c(label)).withColumn("_u", uniform(seed, "strat", c(key)))
    return attach_thresholds(keyed, [label], "_u", key, {"_in": quota}).filter("_in").select(c(key), c(label))


def sample_per_class(df: DataFrame, key: str, label: str, k: int, seed: int = SEED) -> DataFrame:
    """Up to k rows per class in hash order (k is a handful; tasks prune to k per class before the shuffle)."""
    keyed = df.filter(c(label).isNotNull()).withColumn("_u", uniform(seed, "class", c(key)))
    return top_k_per_group(keyed, [label], [F.col("_u").asc(), c(key).asc()], k, "_r").drop("_u", "_r")


def simple_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    return df.orderBy(uniform(seed, "simple", c(key)), c(key)).limit(n)


def bernoulli(key: str, p: float = 0.15, seed: int = SEED, tag: str = "ci") -> Column:
    return uniform(seed, tag, c(key)) < p


def fifo_bounds(df: DataFrame, key: str, batches: int = 12) -> list[int]:
    """Last key of every full chunk of ceil(n / batches) rows in key order: fewer than `batches` values, no sort."""
    size = F.ceil(F.col("n") / F.lit(batches))
    ks = {str(i): size * i for i in range(1, batches)}
    cuts = kth_element(df.select(F.col(key).alias("_k"), F.col(key).alias("_tie")), [], "_k", "_tie", ks)
    return sorted(r["k_score"] for r in cuts.select("k_score").collect())


def batch_number(key: str, bounds: list[int]) -> Column:
    """1-based batch of a key."""
    return reduce(add, [(F.col(key) > b).cast("int") for b in bounds], F.lit(1))


def fifo_batches(df: DataFrame, key: str, batches: int = 12, name: str = "batch_id") -> DataFrame:
    """Number rows in key order into chunks of ceil(n / batches); the last one may be short, empty ones do not occur."""
    if dict(df.dtypes)[key] in ("int", "bigint", "smallint", "tinyint"):
        return df.withColumn(name, batch_number(key, fifo_bounds(df, key, batches)))
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = with_position(df, [], [F.col(key).asc()], "_p")
    return placed.withColumn(name, (F.floor((F.col("_p") - 1) / F.ceil(total / F.lit(batches))) + 1).cast("int")).drop("_p")

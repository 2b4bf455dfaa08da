"""Association with a numeric target, leak verdicts, cross tables and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import LEAK_COLUMNS, STRONG_LEAK, WEAK_LEAK
from ordinalis.functions.scalar import ratio
from ordinalis.operators.prep import c, column_values, melt
from ordinalis.operators.ranking import exact_quantiles, join_on, with_position
from ordinalis.session import settle, small_side

VERDICTS = ("STRONG LEAK", "WEAK LEAK", "CONFIGURED", "CLEAN")


def numeric_columns(df: DataFrame, target: str) -> list[str]:
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if (t in numbers or t.startswith("decimal")) and n != target]


def categorical_columns(df: DataFrame, target: str) -> list[str]:
    numbers = numeric_columns(df, target)
    return [n for n in df.columns if n not in numbers and n != target]


def pearson(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pairwise-complete Pearson r of every column with the target: one pass, one output row per column."""
    def r(x: str) -> Column:
        # corr() itself fails on a constant column under ANSI arithmetic
        a = F.when(c(target).isNotNull(), c(x).cast("double"))
        b = F.when(c(x).isNotNull(), c(target).cast("double"))
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    wide = df.agg(*[r(x).alias(x) for x in columns])
    return melt(wide, {x: c(x) for x in columns}, "feature", "pearson_r")


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Spearman rho with average ranks.

    Rows collapse to (feature, x, t, count) first; ranks come from running counts over distinct values, and the
    correlation is a weighted Pearson over the collapsed rows.
    """
    long = melt(df.filter(c(target).isNotNull()), {x: c(x).cast("double") for x in columns}, "feature", "x",
                [c(target).cast("double").alias("t")])
    joint = settle(long.filter("x is not null").groupBy("feature", "x", "t").agg(F.count(F.lit(1)).alias("n")))
    def ranks(value: str, name: str) -> DataFrame:
        return _weighted_rank(joint, value, name)
    pairs = join_on(join_on(joint, ranks("x", "rx"), ["feature", "x"]), ranks("t", "rt"), ["feature", "t"])
    n, rx, rt = F.col("n"), F.col("rx"), F.col("rt")
    sums = pairs.groupBy("feature").agg(
        F.sum(n).alias("w"), F.sum(n * rx).alias("sx"), F.sum(n * rt).alias("st"), F.sum(n * rx * rx).alias("sxx"),
        F.sum(n * rt * rt).alias("stt"), F.sum(n * rx * rt).alias("sxt"))
    cov = F.col("sxt") - F.col("sx") * F.col("st") / F.col("w")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("w")
    vt = F.col("stt") - F.col("st") * F.col("st") / F.col("w")
    return sums.select("feature", F.try_divide(cov, F.sqrt(F.when((vx > 0) & (vt > 0), vx * vt))).alias("spearman_r"))


def _weighted_rank(joint: DataFrame, value: str, name: str) -> DataFrame:
    freq = joint.groupBy("feature", value).agg(F.sum("n").alias("w"))
    run = with_position(freq, ["feature"], [F.col(value).asc()], "_p", {"cum": F.col("w")})
    return run.select("feature", value, (F.col("cum") - F.col("w") + (F.col("w") + 1) / 2.0).alias(name))


def eta_squared(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One-way ANOVA R-squared per categorical column; NULL categories leave the between sum but not the total."""
    t = c(target).cast("double")
    totals = small_side(df.agg(F.count(t).alias("n"), F.avg(t).alias("m"), F.var_pop(t).alias("v")).withColumn("_k", F.lit(1)))
    long = melt(df, {x: c(x).cast("string") for x in columns}, "feature", "value", [t.alias("t")])
    groups = long.groupBy("feature", "value").agg(F.count("t").alias("gn"), F.avg("t").alias("gm"))
    joined = groups.withColumn("_k", F.lit(1)).join(totals, "_k")
    between = F.sum(F.when(F.col("value").isNotNull(), F.col("gn") * (F.col("gm") - F.col("m")) * (F.col("gm") - F.col("m"))))
    return joined.groupBy("feature").agg(
        F.count("value").alias("n_categories"),
        F.coalesce(F.try_divide(F.coalesce(between, F.lit(0.0)), F.max(F.col("n") * F.col("v"))), F.lit(0.0)).alias("eta_squared"),
        (F.count("value") == F.max("n")).alias("is_key_like"))


def verdict(score: Column, configured: Column) -> Column:
    return (F.when(configured, "CONFIGURED").when(score >= STRONG_LEAK, "STRONG LEAK")
            .when(score >= WEAK_LEAK, "WEAK LEAK").otherwise("CLEAN"))


def leak_audit(df: DataFrame, target: str, listed: tuple[str, ...] = LEAK_COLUMNS) -> DataFrame:
    """Every column's association with the target, strongest first, with a verdict."""
    numbers, labels = numeric_columns(df, target), categorical_columns(df, target)
    num = pearson(df, numbers, target).join(spearman(df, numbers, target), "feature", "left").select(
        "feature", F.lit("numeric").alias("type"), F.round("pearson_r", 3).alias("pearson_r"),
        F.round("spearman_r", 3).alias("spearman_r"),
        F.round(F.coalesce(F.abs("pearson_r"), F.lit(0.0)), 3).alias("score"))
    cat = eta_squared(df, labels, target).select(
        "feature", F.lit("categorical").alias("type"), "n_categories", F.round("eta_squared", 3).alias("eta_squared"),
        F.round("eta_squared", 3).alias("score"), "is_key_like")
    both = num.unionByName(cat, allowMissingColumns=True)
    configured = F.col("feature").isin(*listed)
    return (both.withColumn("in_drop_list", configured).withColumn("verdict", verdict(F.col("score"), configured))
            .orderBy(F.col("score").desc(), "feature"))


def leak_summary(audit: DataFrame) -> DataFrame:
    """Per verdict (all four present): number of features and their names; plus listed columns that look harmless."""
    # one row per column of the audited table, so the lists are as long as its schema at most
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("feature"))))
    arms = [F.struct(F.lit(v).alias("verdict"), F.count_if(F.col("verdict") == v).alias("n"),
                     names(F.col("verdict") == v).alias("features")) for v in VERDICTS]
    mild = F.col("in_drop_list") & (F.col("score") < WEAK_LEAK)
    arms.append(F.struct(F.lit("CONFIGURED BUT MILD").alias("verdict"), F.count_if(mild).alias("n"), names(mild).alias("features")))
    return audit.agg(F.array(*arms).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")


# --- counts and cross tables ------------------------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.filter(c(label).isNotNull()).groupBy(c(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(c(label))).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins as 'All'; the cube expands the counted cells, not the rows."""
    cells = df.groupBy(c(a).cast("string").alias("a"), c(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cube = cells.filter("a is not null and b is not null").cube("a", "b").agg(
        F.sum("n").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return cube.select(F.when(F.col("ga") == 1, "All").otherwise(F.col("a")).alias("a"),
                       F.when(F.col("gb") == 1, "All").otherwise(F.col("b")).alias("b"), "n")


def crosstab_rownorm(df: DataFrame, category: str, code: str, levels: int = 3) -> DataFrame:
    """Share of each class within a category, absent classes zero."""
    n = F.count(code)
    return df.groupBy(c(category).alias("category")).agg(
        *[ratio(F.count_if(F.col(code) == k), n).alias(f"share_{k}") for k in range(levels)])


def group_mean(df: DataFrame, category: str, target: str) -> DataFrame:
    return (df.groupBy(c(category).alias("category")).agg(F.avg(c(target)).alias("mean"), F.count(c(target)).alias("n"))
            .orderBy(F.col("mean").desc(), "category"))


FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def five_numbers(df: DataFrame, columns: list[str], by: str, exact: bool = True) -> DataFrame:
    """Box-plot figures per (column, class); `exact=False` uses a mergeable sketch in one pass."""
    long = melt(df, {x: c(x).cast("double") for x in columns}, "column", "x", [c(by).alias("class")]).filter("x is not null")
    if exact:
        return exact_quantiles(long, ["column", "class"], "x", FIVE)
    q = F.percentile_approx("x", F.array(*[F.lit(p) for p in FIVE.values()]), F.lit(10_000))
    out = long.groupBy("column", "class").agg(q.alias("_q"))
    return out.select("column", "class", *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(FIVE)])


def histogram(df: DataFrame, column: str, by: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts per class and equal-width bin 1..bins, the last bin closed on the right."""
    x = c(column)
    slot = F.least(F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins).cast("long"))
    return (df.filter(x.between(lo, hi)).groupBy(c(by).alias("class"), slot.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of one column."""
    base = df.select(c(column).cast("double").alias("x")).filter("x is not null").withColumn("_k", F.lit(1))
    moments = base.groupBy("_k").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return moments.join(exact_quantiles(base, ["_k"], "x", FIVE), "_k").drop("_k")


def summarize_splits(df: DataFrame, code: str, means: dict[str, str], by: str = "split") -> DataFrame:
    """Per split: rows, share of all rows, class shares and column means in one grouped aggregation."""
    n = F.count(F.lit(1))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(by).agg(
        n.alias("n"), F.round(ratio(n * 100, F.max(total)), 1).alias("pct"),
        *[F.round(ratio(F.count_if(c(code) == k) * 100, F.count(c(code))), 1).alias(f"pct_{k}") for k in range(3)],
        *[F.round(F.avg(c(x)), 1).alias(name) for name, x in means.items()])


def shift_table(df: DataFrame, responded: Column, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Respondents against silent: mean of numeric columns, share of the overall most frequent value of the others."""
    r = F.coalesce(responded, F.lit(False))
    wide = df.agg(*[F.struct(F.avg(F.when(r, c(x))).alias("a"), F.avg(F.when(~r, c(x))).alias("b")).alias(x) for x in numeric])
    num = melt(wide, {x: c(x) for x in numeric}, "feature", "_s").select(
        "feature", F.lit(None).cast("string").alias("level"), "_s.a", "_s.b")
    long = melt(df, {x: c(x).cast("string") for x in categorical}, "feature", "level", [r.alias("r")])
    per = settle(long.groupBy("feature", "level").agg(F.count_if("r").alias("nr"), F.count_if(~F.col("r")).alias("ns")))
    top = F.min(F.when(F.col("level").isNotNull(), F.struct((-(F.col("nr") + F.col("ns"))).alias("v"), F.col("level"), "nr", "ns")))
    cat = per.groupBy("feature").agg(top.alias("_t"), F.sum("nr").alias("r"), F.sum("ns").alias("s")).select(
        "feature", F.col("_t.level").alias("level"), ratio(F.col("_t.nr"), F.col("r")).alias("a"),
        ratio(F.col("_t.ns"), F.col("s")).alias("b"))
    both = num.unionByName(cat).withColumnsRenamed({"a": "respondents", "b": "silent"})
    diff = F.col("respondents") - F.col("silent")
    return both.withColumn("difference", diff).withColumn("relative_pct", F.try_divide(diff * 100, F.col("silent")))


def metric_pivot(long: DataFrame, rows: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    """(rows) x (column values) table of the mean of one metric."""
    return long.filter(F.col("metric") == metric).groupBy(*rows).pivot(column, values).agg(F.avg("value"))


def best_by_mean(long: DataFrame, group: str, metric: str) -> DataFrame:
    """Group with the best mean metric, first name on ties."""
    means = long.filter(F.col("metric") == metric).groupBy(group).agg(F.avg("value").alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("v"), F.col(group), F.col("mean")))
    return means.agg(best.alias("_b")).select(F.col(f"_b.{group}").alias(group), "_b.mean")


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    if exact:
        return column_values(df, columns).groupBy("column").agg(F.count("value").alias("n_unique"))
    wide = df.agg(*[F.approx_count_distinct(c(x)).alias(x) for x in columns])
    return melt(wide, {x: c(x) for x in columns}, "column", "n_unique")

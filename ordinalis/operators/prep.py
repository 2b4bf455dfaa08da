"""From raw tables to a modelling table: targets, imputation, dropped columns, checks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import CLASSES, CONSTANT_COLUMNS, LEAK_COLUMNS, SCORE_MAPS, TARGET_PREFIX
from ordinalis.functions.scalar import lookup, ratio


def c(name: str) -> Column:
    return F.col(f"`{name}`")


# --- targets ---------------------------------------------------------------------------------------------------

def target_column(mapping: str) -> str:
    return f"{TARGET_PREFIX}{mapping}"


def build_target(df: DataFrame, mapping: str = "baseline", source: str = "Satisfaction Score",
                 maps: dict | None = None) -> DataFrame:
    maps = maps or SCORE_MAPS
    if source not in df.columns:
        raise ValueError(f"column {source!r} not found")
    if mapping not in maps:
        raise ValueError(f"unknown mapping {mapping!r}; available {list(maps)}")
    return df.withColumn(target_column(mapping), lookup(maps[mapping], c(source).cast("int")))


def unmapped_scores(df: DataFrame, mapping: str = "baseline", source: str = "Satisfaction Score",
                    maps: dict | None = None) -> DataFrame:
    """Distinct non-null scores that the mapping does not cover, with their row counts."""
    label = lookup((maps or SCORE_MAPS)[mapping], c(source).cast("int"))
    return (df.filter(c(source).isNotNull() & label.isNull()).groupBy(c(source).alias("score"))
            .agg(F.count(F.lit(1)).alias("n")))


def assert_mapped(df: DataFrame, mapping: str = "baseline", source: str = "Satisfaction Score") -> DataFrame:
    bad = unmapped_scores(df, mapping, source).orderBy("score").limit(20).collect()
    if bad:
        raise ValueError(f"scores without a class under {mapping!r}: {[r.score for r in bad]}")
    return df


def add_all_targets(df: DataFrame, source: str = "Satisfaction Score", maps: dict | None = None) -> DataFrame:
    """All mappings in one projection."""
    maps = maps or SCORE_MAPS
    return df.withColumns({target_column(m): lookup(maps[m], c(source).cast("int")) for m in maps})


def melt(df: DataFrame, columns: dict[str, Column], name: str, value: str, keep: list[Column | str] = ()) -> DataFrame:
    """Long form (keep, name, value) of several same-typed expressions; a map-side explode."""
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias(name), e.alias(value)) for n, e in columns.items()])).alias("_m")
    out = df.select(*keep, arms)
    return out.select(*[c(x) for x in out.columns if x != "_m"], "_m.*")


def summarise_mappings(df: DataFrame, mappings: list[str]) -> DataFrame:
    """(mapping, class, n, pct) with zero rows for absent classes."""
    wide = df.agg(*[F.count_if(c(target_column(m)) == k).alias(f"{m}|{k}") for m in mappings for k in CLASSES])
    def total(m: str) -> Column:
        return sum((c(f"{m}|{k}") for k in CLASSES), F.lit(0))
    arms = F.explode(F.array(*[
        F.struct(F.lit(m).alias("mapping"), F.lit(k).alias("class"), c(f"{m}|{k}").alias("n"),
                 F.round(ratio(c(f"{m}|{k}") * 100, total(m)), 1).alias("pct")) for m in mappings for k in CLASSES])).alias("_m")
    return wide.select(arms).select("_m.*")


def nps_index(df: DataFrame, code: str, by: list[str] | None = None) -> DataFrame:
    """100 * (share of promoters - share of detractors)."""
    n = F.count(code)
    return df.groupBy(*(by or [])).agg(
        n.alias("n"), (ratio(F.count_if(F.col(code) == 2) * 100, n) - ratio(F.count_if(F.col(code) == 0) * 100, n)).alias("nps"))


def mapping_sensitivity(df: DataFrame, maps: dict[str, dict[int, str]], source: str = "Satisfaction Score") -> DataFrame:
    """Class counts and shares under alternative score maps: distinct scores are counted once, then mapped."""
    per_score = df.filter(c(source).isNotNull()).groupBy(c(source).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    labels = melt(per_score, {m: lookup(t, F.col("s")) for m, t in maps.items()}, "mapping", "class", ["n"])
    per_class = labels.filter("class is not null").groupBy("mapping", "class").agg(F.sum("n").alias("n"))
    totals = per_class.groupBy("mapping").agg(F.sum("n").alias("t"))
    return per_class.join(totals, "mapping").select("mapping", "class", "n", ratio(F.col("n") * 100, F.col("t")).alias("pct"))


def mapping_flips(df: DataFrame, a: str, b: str) -> DataFrame:
    n = F.count_if(c(a).isNotNull() & c(b).isNotNull())
    flipped = F.count_if(c(a) != c(b))
    return df.agg(n.alias("n"), flipped.alias("n_flipped"), ratio(flipped * 100, n).alias("pct_flipped"))


# --- imputation and dropping -----------------------------------------------------------------------------------

def impute_product(df: DataFrame, target: str = "Total Charges", a: str = "Tenure Months",
                   b: str = "Monthly Charges") -> DataFrame:
    if target not in df.columns:
        return df
    product = F.coalesce(c(a).cast("double"), F.lit(0.0)) * F.coalesce(c(b).cast("double"), F.lit(0.0))
    return df.withColumn(target, F.coalesce(c(target), product))


def impute_category(df: DataFrame, target: str = "Internet Type", value: str = "None") -> DataFrame:
    return df.withColumn(target, F.coalesce(c(target), F.lit(value))) if target in df.columns else df


def imputation_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each imputation fills."""
    present = [x for x in columns if x in df.columns]
    counts = df.agg(*[F.count_if(c(x).isNull()).alias(x) for x in present])
    return melt(counts, {x: c(x) for x in present}, "column", "n_imputed")


def drop_listed(df: DataFrame, listed: tuple[str, ...] = LEAK_COLUMNS + CONSTANT_COLUMNS) -> DataFrame:
    return df.drop(*[x for x in listed if x in df.columns])


def drop_report(df: DataFrame, listed: tuple[str, ...] = LEAK_COLUMNS + CONSTANT_COLUMNS) -> DataFrame:
    rows = [(x, "dropped" if x in df.columns else "not_in_data") for x in listed]
    return df.sparkSession.createDataFrame(rows, "column string, outcome string")


def build_dataset(raw: DataFrame) -> DataFrame:
    """Targets, imputations and drops in one lazy plan."""
    return drop_listed(impute_category(impute_product(add_all_targets(raw))))


def validate_dataset(df: DataFrame, key: str = "Customer ID", imputed=("Total Charges", "Internet Type"),
                     targets=("NPS_baseline", "NPS_alternative"), min_rows: int = 7000, min_columns: int = 30) -> DataFrame:
    """(check, passed, observed) for every invariant, from one aggregation."""
    leaks = [x for x in LEAK_COLUMNS if x in df.columns]
    constants = [x for x in CONSTANT_COLUMNS if x in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_distinct(c(key)).alias("_keys")]
    aggs += [F.count_if(c(x).isNull()).alias(f"null|{x}") for x in (*targets, *imputed) if x in df.columns]
    # levels seen, from conditional counts: the known classes plus one for anything else
    def levels(t: str) -> Column:
        seen = [F.count_if(c(t) == k) > 0 for k in CLASSES] + [F.count_if(c(t).isNotNull() & ~c(t).isin(*CLASSES)) > 0]
        return sum((s.cast("int") for s in seen), F.lit(0))
    aggs += [levels(t).alias(f"levels|{t}") for t in targets if t in df.columns]
    checks = [("no_leak_columns", F.lit(len(leaks)), F.lit(not leaks)),
              ("no_constant_columns", F.lit(len(constants)), F.lit(not constants)),
              ("unique_key", F.col("_rows") - F.col("_keys"), F.col("_rows") == F.col("_keys")),
              ("min_rows", F.col("_rows"), F.col("_rows") >= min_rows),
              ("min_columns", F.lit(len(df.columns)), F.lit(len(df.columns) >= min_columns))]
    for t in targets:
        if t in df.columns:
            checks += [(f"target_not_null:{t}", c(f"null|{t}"), c(f"null|{t}") == 0),
                       (f"target_levels:{t}", c(f"levels|{t}"), c(f"levels|{t}") == 3)]
        else:
            checks.append((f"target_present:{t}", F.lit(0), F.lit(False)))
    checks += [(f"imputed:{x}", c(f"null|{x}"), c(f"null|{x}") == 0) for x in imputed if x in df.columns]
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), o.cast("long").alias("observed"))
                               for n, o, p in checks])).alias("_c")
    return df.agg(*aggs).select(arms).select("_c.*")


def assert_valid(df: DataFrame, **options) -> DataFrame:
    failed = [r.check for r in validate_dataset(df, **options).filter("not passed").collect()]
    if failed:
        raise ValueError(f"dataset checks failed: {failed}")
    return df


def build_metadata(raw: DataFrame, final: DataFrame, imputed: list[str], seed: int = 42,
                   default_target: str = "NPS_alternative") -> DataFrame:
    """One self-describing row: shapes, maps, imputations, dropped columns, features, targets and types."""
    present = [x for x in imputed if x in raw.columns]
    filled = F.map_from_arrays(F.array(*[F.lit(x) for x in present]),
                               F.array(*[F.count_if(c(x).isNull()) for x in present]))
    dropped = [x for x in LEAK_COLUMNS + CONSTANT_COLUMNS if x in raw.columns]
    absent = [x for x in LEAK_COLUMNS + CONSTANT_COLUMNS if x not in raw.columns]
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    literal = lambda d: F.create_map(*[F.lit(z) for kv in d.items() for z in kv])
    maps = F.create_map(*[z for m, t in SCORE_MAPS.items() for z in (F.lit(m), literal({str(k): v for k, v in t.items()}))])
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), filled.alias("imputations")).select(
        F.current_timestamp().cast("string").alias("built_at"), F.lit(seed).alias("random_seed"), "n_rows",
        F.lit(len(raw.columns)).alias("n_raw_columns"), F.lit(len(final.columns)).alias("n_columns"),
        F.lit(default_target).alias("default_target"), maps.alias("score_maps"), "imputations",
        strings(dropped).alias("dropped"), strings(absent).alias("not_in_data"),
        strings([x for x in final.columns if not x.startswith(TARGET_PREFIX)]).alias("feature_columns"),
        strings([x for x in final.columns if x.startswith(TARGET_PREFIX)]).alias("target_columns"),
        literal(dict(final.dtypes)).alias("dtypes"))


# --- profiles --------------------------------------------------------------------------------------------------

def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): partial aggregation collapses repeated values before the one shuffle."""
    long = melt(df, {x: c(x).cast("string") for x in columns}, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, dtype, n_unique, n_null); `exact=False` swaps the distinct shuffle for sketches in a single pass."""
    columns = columns or df.columns
    types = lookup(dict(df.select(*[c(x) for x in columns]).dtypes), F.col("column"))
    if exact:
        out = column_values(df, columns).groupBy("column").agg(
            F.count("value").alias("n_unique"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    else:
        wide = df.agg(*[F.struct(F.approx_count_distinct(c(x)).alias("u"), F.count_if(c(x).isNull()).alias("z")).alias(x)
                        for x in columns])
        out = melt(wide, {x: c(x) for x in columns}, "column", "_s").select(
            "column", F.col("_s.u").alias("n_unique"), F.col("_s.z").alias("n_null"))
    return out.select("column", types.alias("dtype"), "n_unique", "n_null")


def missing_report(df: DataFrame) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c(x).isNull()).alias(x) for x in df.columns])
    long = melt(wide, {x: c(x) for x in df.columns}, "column", "n_missing", ["_n"])
    return long.filter("n_missing > 0").select("column", "n_missing", ratio(F.col("n_missing") * 100, F.col("_n")).alias("pct"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value, NULL counted as a value: min/max and null counts in one pass, no distinct."""
    wide = df.agg(*[F.struct(F.min(c(x)).cast("string").alias("a"), F.max(c(x)).cast("string").alias("b"),
                             F.count_if(c(x).isNull()).alias("z")).alias(x) for x in df.columns])
    long = melt(wide, {x: c(x) for x in df.columns}, "column", "_s")
    constant = (F.col("_s.a").isNull() | ((F.col("_s.a") == F.col("_s.b")) & (F.col("_s.z") == 0)))
    return long.filter(constant).select("column", F.col("_s.a").alias("value"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Unique keys and rows beyond the first of a key; a hot key is counted map-side before the shuffle."""
    per_key = df.groupBy(c(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"),
                       F.sum(F.col("n") - 1).alias("n_duplicates"))


# --- selections ------------------------------------------------------------------------------------------------

def feature_columns(df: DataFrame) -> list[str]:
    return [x for x in df.columns if not x.startswith(TARGET_PREFIX)]


def split_xy(df: DataFrame, target: str) -> DataFrame:
    """Features (everything but the targets) and the chosen target as `y`."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not found; available {[x for x in df.columns if x.startswith(TARGET_PREFIX)]}")
    return df.select(*[c(x) for x in feature_columns(df)], c(target).alias("y"))


def get_split(df: DataFrame, splits: DataFrame, kind: str, target: str, key: str = "Customer ID") -> DataFrame:
    """Rows of one split with features and target; an empty split is an error."""
    chosen = splits.filter(F.col("split") == kind)
    if not chosen.take(1):
        raise ValueError(f"no rows with split {kind!r}")
    return split_xy(df.join(chosen.select(c(key)), key, "left_semi"), target)


def cohort(df: DataFrame, filters: dict[str, object], score: str, k: int, key: str) -> DataFrame:
    """Top-k call list under equality filters, with the list's share of the whole population in percent.

    The list may be shorter than k; its share counts the rows it has.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df
    for name, value in filters.items():
        rows = rows.filter(c(name) == value)
    top = rows.orderBy(c(score).desc(), c(key).asc()).limit(k)
    found = F.least(F.lit(k), rows.agg(F.count(F.lit(1))).scalar())
    return top.withColumn("pct_of_population", ratio(F.lit(100.0) * found, total))


def lookup_row(ranked: DataFrame, key: str, value) -> DataFrame:
    """Scores and ranks of one id; rank percentile is (rank - 1) / population."""
    total = ranked.agg(F.count(F.lit(1))).scalar()
    ranks = [x for x in ranked.columns if x.startswith("rank_")]
    return ranked.filter(c(key) == value).select(
        "*", *[ratio(c(r) - 1, total).alias(f"{r}_pct") for r in ranks])


# --- joins and set operations ------------------------------------------------------------------------------------

def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids of each side lack a partner."""
    a = left.join(right, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("side"), "n")
    b = right.join(left, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("extra").alias("side"), "n")
    return a.unionByName(b)


def align(key: str, *tables: DataFrame) -> list[DataFrame]:
    """Restrict every table to the ids common to all."""
    common = tables[0].select(c(key)).distinct()
    for t in tables[1:]:
        common = common.join(t.select(c(key)), key, "left_semi")
    return [t.join(common, key, "left_semi") for t in tables]


def side_by_side(long: DataFrame, key: str, model: str, models: list[str], values: list[str]) -> DataFrame:
    """Per-model scores next to each other: one aggregation per id instead of a chain of joins."""
    aggs = [F.max(F.when(F.col(model) == m, F.col(v))).alias(f"{v}_{m}") for m in models for v in values]
    return long.groupBy(key).agg(*aggs)


def substitute(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take `columns` from `other` where it has the id, keep everything else."""
    renamed = other.select(key, *[F.col(x).alias(f"_new_{x}") for x in columns])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in columns else F.col(x) for x in base.columns])


def top_overlap(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """Shared and one-sided items of two short lists per group, with the overlap rate."""
    both = a.select(*by, item, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(*by, item, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    flags = both.groupBy(*by, item).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return flags.groupBy(*by).agg(
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("n_shared"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("n_only_a"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("n_only_b"),
        ratio(F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)), F.sum("in_a")).alias("overlap_rate"))


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(c(key)).join(b.select(c(key)), key, "left_anti").distinct()


def union_results(*tables: DataFrame) -> DataFrame:
    """Stack result tables; columns that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

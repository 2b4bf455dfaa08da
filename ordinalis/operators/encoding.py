"""Encoding plan, scaling, one-hot and ordinal codes, as DataFrame expressions and as an ML pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import GEO_COLUMNS, ONE_HOT_MAX_LEVELS
from ordinalis.operators.assoc import numeric_columns
from ordinalis.operators.prep import c, profile_columns
from ordinalis.operators.ranking import with_position


def encoding_plan(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, policy, encoding, n_unique): numeric, one-hot up to 8 levels, ordinal above, geography dropped."""
    numbers = set(numeric_columns(df.select(*[c(x) for x in columns]), ""))
    profile = profile_columns(df, columns).select("column", "n_unique")
    name = F.col("column")
    few = F.col("n_unique") <= ONE_HOT_MAX_LEVELS
    is_geo, is_number = name.isin(*GEO_COLUMNS), name.isin(*numbers) if numbers else F.lit(False)
    return profile.select(
        "column", F.when(is_geo, "dropped").when(is_number, "numeric").otherwise("categorical").alias("policy"),
        F.when(is_geo, "none").when(is_number, "scale").when(few, "onehot").otherwise("ordinal").alias("encoding"), "n_unique")


def classify_columns(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The plan as lists; one row per column comes to the driver."""
    rows = {r["column"]: r["encoding"] for r in encoding_plan(df, columns).collect()}
    names = {"numeric": "scale", "onehot": "onehot", "ordinal": "ordinal", "dropped": "none"}
    return {k: [x for x in columns if rows[x] == v] for k, v in names.items()}


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std with statistics of `fit_on`; constant columns are only centred."""
    source = fit_on if fit_on is not None else df
    stats = source.agg(F.struct(*[F.struct(F.avg(c(x).cast("double")).alias("m"), F.stddev_pop(c(x).cast("double")).alias("s"))
                                  .alias(f"c{i}") for i, x in enumerate(columns)])).scalar()
    out = {}
    for i, x in enumerate(columns):
        m, s = stats.getField(f"c{i}").getField("m"), stats.getField(f"c{i}").getField("s")
        out[x] = (c(x).cast("double") - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return df.withColumns(out)


def ordinal_dictionary(fit_on: DataFrame, column: str) -> DataFrame:
    """(level, code): levels in sorted order, numbered from 0 by distributed position."""
    levels = fit_on.filter(c(column).isNotNull()).select(c(column).alias("level")).distinct()
    return with_position(levels, [], [F.col("level").asc()], "_p").select("level", (F.col("_p") - 1).cast("int").alias("code"))


def ordinal_encode(df: DataFrame, column: str, fit_on: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace a string column by its sorted index; unknown and missing values give -1.

    `codes` is a stored dictionary; without it one is built from `fit_on` (or the table itself).  The dictionary is joined,
    never collected, so a column may have any number of levels.
    """
    if codes is None:
        codes = ordinal_dictionary(fit_on if fit_on is not None else df, column)
    out = df.join(codes, c(column) == F.col("level"), "left")
    return out.withColumn(column, F.coalesce("code", F.lit(-1))).drop("level", "code")


def encode_ordinals(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """Ordinal codes of several columns, fitted on `fit_on`; run it before the feature pipeline."""
    codes = {x: ordinal_dictionary(fit_on, x) for x in columns}
    for x in columns:
        df = ordinal_encode(df, x, codes=codes[x])
    return df


def feature_pipeline(plan: dict[str, list[str]], output: str = "features") -> Pipeline:
    """Scaled numbers, one-hot levels (unknown = all zeros) and ordinal codes assembled into one vector.

    Ordinal columns must have been coded by `encode_ordinals`; the indexer only sees columns with few levels.  Fitted with `.fit(train)`; the fitted model is saved and loaded with `save` / `PipelineModel.load`.
    """
    numbers, few, many = plan["numeric"], plan["onehot"], plan["ordinal"]
    fills = [f"coalesce(cast(`{x}` as double), 0.0) as `f_{x}`" for x in numbers]
    fills += [f"coalesce(cast(`{x}` as string), '__missing__') as `f_{x}`" for x in few]
    fills += [f"cast(`{x}` as double) as `f_{x}`" for x in many]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")]
    parts = []
    if numbers:
        stages += [VectorAssembler(inputCols=[f"f_{x}" for x in numbers], outputCol="_num"),
                   StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    if few:
        # one indexer for all columns: a single pass over the training rows
        stages.append(StringIndexer(inputCols=[f"f_{x}" for x in few], outputCols=[f"i_{x}" for x in few],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the invalid slot is the dropped one, so every level seen in training keeps its own column
        stages.append(OneHotEncoder(inputCols=[f"i_{x}" for x in few], outputCols=[f"o_{x}" for x in few], dropLast=True))
    parts += [f"o_{x}" for x in few] + [f"f_{x}" for x in many]
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages)


def encoded_names(model: PipelineModel, df: DataFrame, plan: dict[str, list[str]]) -> list[str]:
    """Names of the vector slots, read from the fitted stages."""
    labels = {}
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            labels.update({x[2:]: list(v) for x, v in zip(stage.getInputCols(), stage.labelsArray)})
    names = list(plan["numeric"])
    for x in plan["onehot"]:
        names += [f"{x}_{level}" for level in labels[x]]
    return names + list(plan["ordinal"])


def clean_columns(df: DataFrame, keep: list[str], output: str = "features") -> DataFrame:
    """Drop the helper columns of the pipeline."""
    return df.select(*[c(x) for x in keep], output)

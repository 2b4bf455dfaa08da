"""Writing results and reading them back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.sources.store import Store, rows_digest


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def save_splits(splits: DataFrame, strategy: str, path: str) -> DataFrame:
    """Append-free save of one strategy: only its own partition is overwritten."""
    (splits.withColumn("strategy", F.lit(strategy)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path))
    return load_splits(splits.sparkSession, strategy, path)


def load_splits(spark: SparkSession, strategy: str, path: str) -> DataFrame:
    """Partition-pruned read of one strategy."""
    return spark.read.parquet(path).filter(F.col("strategy") == strategy)


def stored_splits(rows: DataFrame, key: str, label: str, strategy: str, store: Store, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Splits of these ids and labels from the store, drawn once: the same rows get the same splits in every later job.

    `strategy` has to name all parameters of the draw, the seed included.  A changed, new or lost id or label draws anew.
    """
    return store.cached(f"splits-{strategy}", rows_digest(rows.select(key, label)), lambda: split(rows))


def inventory(spark: SparkSession, expected: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """(name, present, n_rows, n_columns) for every expected table."""
    spine = spark.createDataFrame([(n,) for n in expected], "name string")
    counted = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows",
                                                            F.lit(len(t.columns)).alias("n_columns"))
               for n, t in tables.items()]
    if not counted:
        return spine.select("name", F.lit(False).alias("present"), F.lit(0).cast("long").alias("n_rows"),
                            F.lit(0).alias("n_columns"))
    found = reduce(DataFrame.unionByName, counted)
    return spine.join(found, "name", "left").select(
        "name", F.col("n_rows").isNotNull().alias("present"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_columns", F.lit(0)).alias("n_columns"))

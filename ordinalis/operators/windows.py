"""Ordered operators on small result tables (trial logs, KPI series, importance tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.functions.scalar import drifting


def rank_first(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank_in_class") -> DataFrame:
    """Dense order within the group, the tie-break made explicit."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie).asc())))


def best_so_far(df: DataFrame, by: list[str], number: str, value: str, name: str = "best") -> DataFrame:
    return df.withColumn(name, F.max(value).over(
        W.partitionBy(*by).orderBy(number).rowsBetween(W.unboundedPreceding, 0)))


def severity(status: Column, previous: Column) -> Column:
    """ok inside the band or without a reference; warn on a first drift; alert when the previous batch drifted the same way."""
    return (F.when(~drifting(status), "ok").when(previous.isNotNull() & (previous == status), "alert").otherwise("warn"))


def escalate(df: DataFrame, cell: list[str], batch: str, status: str = "status", name: str = "severity") -> DataFrame:
    """Severity of each batch of a cell; a cell holds as many rows as there were batches."""
    previous = F.lag(status).over(W.partitionBy(*cell).orderBy(batch))
    return df.withColumn(name, severity(F.col(status), previous))

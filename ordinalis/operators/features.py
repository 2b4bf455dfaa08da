"""Derived customer features; every step is skipped when its source columns are absent and can be applied twice."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import ADDON_COLUMNS, POPULATION_LABELS, SERVICE_COLUMNS, TENURE_EDGES
from ordinalis.functions.scalar import flip, is_yes
from ordinalis.operators.prep import c
from ordinalis.operators.ranking import exact_quantiles

DERIVED = ("n_services", "n_addons", "has_security_bundle", "avg_monthly_charge", "charges_per_service", "tenure_bucket",
           "is_paperless_autopay", "pop_density_bucket", "has_extra_charges", "has_refund", "is_referrer", "received_offer")


def _count_yes(columns: list[str]) -> Column:
    return reduce(add, [is_yes(c(x)).cast("int") for x in columns])


def service_bundle(df: DataFrame) -> DataFrame:
    services = [x for x in SERVICE_COLUMNS if x in df.columns]
    addons = [x for x in ADDON_COLUMNS if x in df.columns]
    new = {}
    if services:
        new["n_services"] = _count_yes(services)
    if addons:
        new["n_addons"] = _count_yes(addons)
        new["has_security_bundle"] = (_count_yes(addons) == len(addons)).cast("int")
    return df.withColumns(new) if new else df


def financial_ratios(df: DataFrame) -> DataFrame:
    new = {}
    if {"Total Charges", "Tenure Months"} <= set(df.columns):
        months = F.greatest(F.coalesce(c("Tenure Months"), F.lit(0)), F.lit(1))
        new["avg_monthly_charge"] = F.round(c("Total Charges").cast("double") / months, 2)
    if {"Monthly Charges", "n_services"} <= set(df.columns):
        new["charges_per_service"] = F.round(c("Monthly Charges").cast("double") / F.greatest("n_services", F.lit(1)), 2)
    return df.withColumns(new) if new else df


def tenure_bucket(df: DataFrame) -> DataFrame:
    """Left-closed lifecycle stage; NULL or negative tenure reads 'unknown'."""
    if "Tenure Months" not in df.columns:
        return df
    months = c("Tenure Months")
    label = reduce(lambda acc, edge: acc.when(months >= edge[0], edge[1]), reversed(TENURE_EDGES), F)
    return df.withColumn("tenure_bucket", label.otherwise("unknown"))


def digital_engagement(df: DataFrame) -> DataFrame:
    paperless = is_yes(c("Paperless Billing")) if "Paperless Billing" in df.columns else F.lit(False)
    autopay = F.lit(False)
    if "Payment Method" in df.columns:
        autopay = F.coalesce(F.lower(c("Payment Method")).contains("automatic"), F.lit(False))
    return df.withColumn("is_paperless_autopay", (paperless & autopay).cast("int"))


def population_edges(df: DataFrame, column: str = "Population") -> Column:
    """Sorted distinct quartile edges (min, q1, median, q3, max) as one scalar subquery."""
    quarters = exact_quantiles(df.select(c(column).alias("x")).filter("x is not null"), [], "x",
                               {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0})
    return quarters.select(F.array_distinct(F.array("e0", "e1", "e2", "e3", "e4"))).scalar()


def quartile_bucket(df: DataFrame, column: str = "Population", name: str = "pop_density_bucket") -> DataFrame:
    """Right-closed quartile label.  Repeated edges, which leave fewer bins than labels, read 'unknown'."""
    if column not in df.columns:
        return df
    edges = population_edges(df, column)
    at = lambda i: F.try_element_at(edges, F.lit(i))
    x = c(column).cast("double")
    label = F.when(x <= at(2), POPULATION_LABELS[0])
    for i in (1, 2, 3):
        label = label.when(x <= at(i + 2), POPULATION_LABELS[i])
    return df.withColumn(name, F.when(F.size(edges) < 5, "unknown").when(x.isNull(), "unknown").otherwise(label))


def friction_flags(df: DataFrame) -> DataFrame:
    new = {name: (F.coalesce(c(src).cast("double"), F.lit(0.0)) > 0).cast("int")
           for name, src in (("has_extra_charges", "Total Extra Data Charges"), ("has_refund", "Total Refunds"))
           if src in df.columns}
    return df.withColumns(new) if new else df


def referrer_flag(df: DataFrame) -> DataFrame:
    if "Number of Referrals" not in df.columns:
        return df
    return df.withColumn("is_referrer", (F.coalesce(c("Number of Referrals"), F.lit(0)) > 0).cast("int"))


def offer_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("received_offer", c("Offer").isNotNull().cast("int")) if "Offer" in df.columns else df


def derive_all(df: DataFrame) -> DataFrame:
    """Twelve features in dependency order (ratios need the service count)."""
    steps = (service_bundle, financial_ratios, tenure_bucket, digital_engagement, quartile_bucket, friction_flags,
             referrer_flag, offer_flag)
    return reduce(lambda acc, step: step(acc), steps, df)


def flip_binary(df: DataFrame, column: str, values_of: DataFrame | None = None) -> DataFrame:
    """Swap the two values of a column (as seen in `values_of`); any other number of values leaves it alone."""
    source = values_of if values_of is not None else df
    stats = source.select(c(column)).agg(F.struct(
        F.min(c(column)).alias("a"), F.max(c(column)).alias("b"), F.count_distinct(c(column)).alias("n"))).scalar()
    swapped = flip(c(column), stats.getField("a"), stats.getField("b"))
    return df.withColumn(column, F.when(stats.getField("n") == 2, swapped).otherwise(c(column)))

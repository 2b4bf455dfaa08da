"""Isotonic regression of hits on scores: pool-adjacent-violators over range partitions.

Equal scores are one weighted point.  Every range partition pools its points to blocks of rising mean; pooled blocks of a
stretch stay pooled in any longer one, so the blocks of neighbouring stretches are pooled again, a bounded number at a
time, with the bounds moved by half a stretch each round, until two rounds in a row change nothing.  Means are compared as
whole numbers.  Block means of 0/1 hits are different fractions whose denominators add up to the number of rows, so there
are at most about 1.4 * rows^(2/3) blocks; nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.operators.ranking import with_position
from ordinalis.session import settle, small_side

STRETCH = 1 << 17   # blocks that are pooled together in one task
FEW_KNOTS = 200_000  # knots up to which the map goes to the tasks as two arrays
FIELDS = ["lo", "hi", "hits", "n"]


def pool(lo, hi, hits, n) -> tuple[list, list, list, list]:
    """Blocks of non-decreasing mean from neighbouring blocks in the order of their scores."""
    out_lo, out_hi, out_hits, out_n = [], [], [], []
    for a, b, s, w in zip(lo, hi, map(int, hits), map(int, n), strict=True):
        while out_n and out_hits[-1] * w >= s * out_n[-1]:
            a, s, w = out_lo.pop(), s + out_hits.pop(), w + out_n.pop()
            out_hi.pop()
        out_lo.append(a)
        out_hi.append(b)
        out_hits.append(s)
        out_n.append(w)
    return out_lo, out_hi, out_hits, out_n


def _pool_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools every run of equal `_run` of a sorted partition; a run may go on over several batches."""
    key, held = None, None
    for pdf in batches:
        for value, part in pdf.groupby("_run", sort=False):
            if held is not None and value != key:
                yield held
                held = None
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            blocks = pool(*[rows[f].tolist() for f in FIELDS])
            held = rows.head(len(blocks[0])).reset_index(drop=True).assign(**dict(zip(FIELDS, blocks, strict=True)))
            key = value
    if held is not None:
        yield held


def _pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pools neighbours of equal keys inside each partition of rows laid out by (keys, score)."""
    runs = rows.withColumn("_run", F.to_json(F.struct(*keys)))
    return settle(runs.mapInPandas(_pool_sorted, runs.schema).drop("_run"))


def fit(df: DataFrame, by: list[str], score: str, hit: str) -> DataFrame:
    """(by, lo, hi, hits, n): blocks of the monotone fit of 0/1 `hit` on `score`, per group.

    Rows without a score or a hit take no part; a group without any has no blocks.
    """
    keys = by or ["_all"]
    points = df if by else df.withColumn("_all", F.lit(0))
    points = points.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(hit).isNotNull()).groupBy(
        *keys, F.col(score).cast("double").alias("lo")).agg(F.sum(F.col(hit).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    points = points.select(*keys, "lo", F.col("lo").alias("hi"), "hits", "n")
    blocks = _pooled(points.repartitionByRange(*keys, "lo").sortWithinPartitions(*keys, "lo"), keys)
    total, calm, shift = blocks.count(), 0, 0
    while total > STRETCH and calm < 2:
        placed = with_position(blocks, keys, [F.col("lo").asc()], "_pos")
        placed = placed.withColumn("_stretch", F.floor((F.col("_pos") + shift) / STRETCH)).drop("_pos")
        laid = placed.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "lo")
        blocks = _pooled(laid, [*keys, "_stretch"]).drop("_stretch")
        left = blocks.count()
        total, calm, shift = left, calm + 1 if left == total else 0, STRETCH // 2 - shift
    if calm < 2:  # few blocks, of which a group may go into one task
        blocks = _pooled(blocks.repartition(*keys).sortWithinPartitions(*keys, "lo"), keys)
    return blocks if by else blocks.drop("_all")


def knots(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, q): the ends of every block with its mean; the map is linear between them and level outside."""
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(*by, F.explode(ends).alias("x"), (F.col("hits") / F.col("n")).alias("q"))


def apply(df: DataFrame, table: DataFrame, score: str, name: str, few: int = FEW_KNOTS) -> DataFrame:
    """Add the value at `score` of the map given by knots (x, q) as `name`; NULL for a NULL score and without knots.

    Few knots go to the tasks as two arrays. Otherwise rows and knots are laid out together by score, and the running
    number of knots says between which two a row lies: an equi-join, for which no group is gathered in a task.
    """
    if table.count() <= few:
        found = table.orderBy("x").toPandas()
        xs, qs = found["x"].to_numpy(), found["q"].to_numpy()

        @F.pandas_udf("double")
        def lookup(x: pd.Series) -> pd.Series:
            return pd.Series(np.interp(x, xs, qs) if len(xs) else np.nan, index=x.index).where(x.notna(), None)

        value = lookup(F.col(score).cast("double"))
        return df.withColumn(name, F.when(F.isnan(value), None).otherwise(value))
    numbered = with_position(table, [], [F.col("x").asc()], "_i").select("_i", F.struct("x", "q").alias("_k0"))
    after = numbered.select((F.col("_i") - 1).alias("_i"), F.col("_k0").alias("_k1"))
    spans = small_side(numbered.join(after, "_i", "full"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(F.col(score).cast("double").alias("_x"), F.lit(1).alias("_side"), row)
    marks = table.select(F.col("x").alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    placed = with_position(rows.unionByName(marks), [], [F.col("_x").asc_nulls_first(), F.col("_side").asc()], "_p",
                           {"_i": F.when(F.col("_side") == 0, 1).otherwise(0)})
    return placed.where("_side = 1").join(spans, "_i", "left").select("_row.*", value_between(F.col("_x")).alias(name))


def value_between(x: Column) -> Column:
    """Linear between the knots `_k0` and `_k1`, the outermost knot's value beyond them."""
    x0, q0, x1, q1 = (F.col(c) for c in ("_k0.x", "_k0.q", "_k1.x", "_k1.q"))
    inside = q0 + (q1 - q0) * (x - x0) / (x1 - x0)
    return F.when(x.isNull() | F.isnan(x), None).when(F.col("_k0").isNull(), q1).when(F.col("_k1").isNull(), q0).otherwise(inside)

"""Classification metrics as Column expressions over the nine confusion counts n00 ... n22.

The same expressions serve point estimates, bootstrap replicates, groups, batches and streams:
one grouped aggregation with map-side partial sums, then arithmetic on a handful of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordinalis.functions.scalar import ratio

K = 3
CELLS = tuple(f"n{i}{j}" for i in range(K) for j in range(K))


def counts(y: str = "y", yp: str = "yp") -> list[Column]:
    return [F.count_if((F.col(y) == i) & (F.col(yp) == j)).alias(f"n{i}{j}") for i in range(K) for j in range(K)]


def cell(i: int, j: int) -> Column:
    return F.col(f"n{i}{j}").cast("double")


def _sum(columns) -> Column:
    return reduce(add, columns)


def true_total(i: int) -> Column:
    return _sum(cell(i, j) for j in range(K))


def pred_total(j: int) -> Column:
    return _sum(cell(i, j) for i in range(K))


def total() -> Column:
    return _sum(cell(i, j) for i in range(K) for j in range(K))


def qwk() -> Column:
    """Quadratic weighted kappa; NULL when no disagreement is expected."""
    observed = _sum(cell(i, j) * ((i - j) ** 2) for i in range(K) for j in range(K) if i != j)
    expected = _sum(true_total(i) * pred_total(j) * ((i - j) ** 2) for i in range(K) for j in range(K) if i != j)
    return F.lit(1.0) - F.try_divide(observed * total(), expected)


def recall(i: int, undefined: float | None = 0.0) -> Column:
    """Recall of class i; `undefined` is the value when the class does not occur (None for NULL)."""
    value = ratio(cell(i, i), true_total(i))
    return value if undefined is None else F.coalesce(value, F.lit(undefined))


def precision(j: int) -> Column:
    return ratio(cell(j, j), pred_total(j))


def selection_rate(j: int) -> Column:
    return ratio(pred_total(j), total())


def macro_f1() -> Column:
    """Mean F1 over the labels seen in the truth or the predictions."""
    seen = _sum((true_total(i) + pred_total(i) > 0).cast("double") for i in range(K))
    f1 = _sum(F.coalesce(F.try_divide(cell(i, i) * 2.0, true_total(i) + pred_total(i)), F.lit(0.0))
              for i in range(K))
    return F.try_divide(f1, seen)


def balanced_accuracy() -> Column:
    """Mean recall over the labels seen in the truth."""
    seen = _sum((true_total(i) > 0).cast("double") for i in range(K))
    return F.try_divide(_sum(recall(i) for i in range(K)), seen)


def accuracy() -> Column:
    return ratio(_sum(cell(i, i) for i in range(K)), total())


# Named metrics usable wherever the nine counts are at hand.
METRICS = {
    "qwk": qwk,
    "macro_f1": macro_f1,
    "balanced_acc": balanced_accuracy,
    "detractor_recall": lambda: recall(0),
}

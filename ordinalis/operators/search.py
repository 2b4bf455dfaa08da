"""Search over model families and feature spaces by successive halving, refit of the best, and scores for every split.

Each trial is a seeded random point.  A rung fits the trials still alive on a growing, nested, stratified part of the training
rows (boosting rounds grow with it), each is judged on `val` by one aggregation, and the best third goes on.
The parts are shares, so they grow with the table; only one number per trial comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import SEED
from ordinalis.functions.hashing import uniform
from ordinalis.operators.evaluation import evaluate
from ordinalis.operators.models import FITTERS, Classifier, with_weights
from ordinalis.operators.ranking import attach_thresholds
from ordinalis.session import settle

RUNGS = (1 / 9, 1 / 3, 1.0)
PART_ROWS = 30_000   # rows that a task of a fit or of a judgement should have at least: with fewer it is mostly waiting
LOG = "space string, model string, number int, rung int, n_train long, value double, kept boolean, params string"


def _log_uniform(low: float, high: float) -> Callable[[random.Random], float]:
    return lambda r: math.exp(r.uniform(math.log(low), math.log(high)))


SPACES: dict[str, dict[str, Callable[[random.Random], object]]] = {
    "logistic": {"reg": _log_uniform(1e-4, 10.0), "elastic": lambda r: r.choice([0.0, 0.5, 1.0])},
    "ordinal": {"reg": _log_uniform(1e-4, 10.0)},
    "boosted": {"depth": lambda r: r.randint(2, 5), "iterations": lambda r: r.randint(10, 30), "step": _log_uniform(0.03, 0.3)}}


def draw_points(model: str, n: int, seed: int = SEED) -> list[dict]:
    """The first n points of a family; asking for more keeps the earlier ones."""
    r = random.Random(f"{seed}:{model}")
    return [{k: draw(r) for k, draw in SPACES[model].items()} for _ in range(n)]


def recipe(budgets: dict[str, int], spaces: list[str], *more: object, seed: int = SEED) -> str:
    """Digest of all that a search depends on beside its rows: the points, the spaces, the rungs, and what the caller adds."""
    parts = [[(m, draw_points(m, n, seed)) for m, n in sorted(budgets.items())], spaces, RUNGS, seed, more]
    return hashlib.md5(repr(parts).encode()).hexdigest()


def _at_rung(model: str, params: dict, share: float) -> dict:
    """Boosting rounds are the other resource that a rung cuts."""
    return params | {"iterations": max(3, math.ceil(params["iterations"] * share))} if model == "boosted" else params


def rung_rows(train: DataFrame, key: str = "id", label: str = "y", seed: int = SEED) -> DataFrame:
    """Flags _r0, _r1, ...: the first ceil(share * n) rows of each class in hash order, so that rungs are nested."""
    keyed = train.withColumn("_u", uniform(seed, "rung", F.col(key)))
    cuts = {f"_r{i}": F.ceil(F.col("n") * F.lit(s)) for i, s in enumerate(RUNGS)}
    flags = attach_thresholds(keyed.select(key, label, "_u"), [label], "_u", key, cuts)
    return train.join(flags.select(key, *cuts), key)


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """The n rows in at most as many partitions as PART_ROWS asks for; partitions are only put together, never split."""
    return df.coalesce(max(1, math.ceil(n / PART_ROWS)))


def halving(df: DataFrame, budgets: dict[str, int], spaces: list[str], metric: str = "qwk", parallel: int = 8,
            seed: int = SEED) -> tuple[DataFrame, dict[str, tuple[str, dict]]]:
    """(trial log, {space: (model, parameters) of its best trial}).

    `df` has id, y, split and one vector column for each space; the points of a family take the spaces in turn.  A family keeps
    ceil(a third) of its trials in each space after each rung, so no family leaves early.  Trials without a value rank last;
    ties go to the lower number and name.
    """
    if not spaces or len(spaces) > max(budgets.values(), default=0):
        raise ValueError(f"{budgets} leaves a feature space of {spaces} without a trial")
    spark = df.sparkSession
    train = settle(rung_rows(df.filter("split = 'train'").select("id", "y", *spaces), seed=seed))
    val = settle(df.filter("split = 'val'").select("id", "y", *spaces))
    val = in_parts(val, val.count())
    points = {m: draw_points(m, n, seed) for m, n in budgets.items()}
    alive = [(spaces[i % len(spaces)], m, i) for m in budgets for i in range(len(points[m]))]
    log, value = [], {}
    for rung, share in enumerate(RUNGS):
        part = settle(train.filter(f"_r{rung}").select("y", *spaces))
        n_train = part.count()
        weighed = in_parts(with_weights(part), n_train)  # one pass for the class sizes, not one a fit
        rows = {s: weighed.select("y", "_w", F.col(s).alias("features")) for s in spaces}

        def judge(trial: tuple[str, str, int]) -> float | None:
            """Fit and judge in one thread, so that one trial's plans are made while another one's tasks run."""
            s, m, i = trial
            model = FITTERS[m](rows[s], **_at_rung(m, points[m][i], share))  # noqa: B023
            out = model.score(val.select("id", "y", F.col(s).alias("features")))
            return evaluate(out, [], probabilities=False).first()[metric]

        with ThreadPoolExecutor(parallel) as pool:
            value = dict(zip(alive, pool.map(judge, alive), strict=True))
        rank = lambda t: (-(value.get(t) if value.get(t) is not None else -math.inf), t[2])  # noqa: E731, B023
        last, kept = rung == len(RUNGS) - 1, []
        for s in spaces:
            for m in budgets:
                mine = sorted((t for t in alive if t[:2] == (s, m)), key=rank)
                kept += mine[:1 if last else math.ceil(len(mine) / 3)]
        log += [(s, m, i, rung, n_train, value.get((s, m, i)), (s, m, i) in kept,
                 ", ".join(f"{k}={v:.6g}" for k, v in points[m][i].items())) for s, m, i in alive]
        alive = kept
    best = {s: min((t for t in alive if t[0] == s), key=lambda t: (rank(t)[0], t[1])) for s in spaces}
    return spark.createDataFrame(log, LOG), {s: (m, points[m][i]) for s, (_, m, i) in best.items()}


def refit(df: DataFrame, space: str, model: str, params: dict) -> Classifier:
    """The chosen point on all training rows."""
    train = settle(df.filter("split = 'train'").select("y", F.col(space).alias("features")))
    return FITTERS[model](in_parts(train, train.count()), **params)


def score_champions(df: DataFrame, best: dict[str, tuple[str, dict]]) -> DataFrame:
    """(id, split, y, model, yp, p0..p2): every row scored by the refitted champion of every space; `model` is space:family."""
    with ThreadPoolExecutor(len(best)) as pool:
        fitted = list(pool.map(lambda space: refit(df, space, *best[space]), best))
    parts = []
    for (space, (name, _)), model in zip(best.items(), fitted, strict=True):
        out = model.score(df.select("id", "split", "y", F.col(space).alias("features")))
        parts.append(out.select("id", "split", "y", F.lit(f"{space}:{name}").alias("model"), "yp", "p0", "p1", "p2"))
    return reduce(DataFrame.unionByName, parts)

"""The monotone fit against the formula it is defined by, in one stretch and in many, and its map by either way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinalis.operators import isotonic


def plain(points):
    """{x: fit}: the largest over j of the least over k of the mean of points j to k."""
    by_x = {}
    for x, h in points:
        s, n = by_x.get(x, (0, 0))
        by_x[x] = (s + h, n + 1)
    xs = sorted(by_x)
    s = np.cumsum([0] + [by_x[x][0] for x in xs])
    n = np.cumsum([0] + [by_x[x][1] for x in xs])
    mean = lambda j, k: (s[k + 1] - s[j]) / (n[k + 1] - n[j])
    least = {j: np.minimum.accumulate([mean(j, k) for k in range(len(xs) - 1, j - 1, -1)])[::-1] for j in range(len(xs))}
    return {x: max(least[j][i - j] for j in range(i + 1)) for i, x in enumerate(xs)}


def sample(n, seed, shape):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = round(rng.random(), 2 if shape == "ties" else 9)
        hit = {"noise": rng.random() < 0.3, "rising": rng.random() < x, "falling": rng.random() < 1 - x, "ties": rng.random() < x,
               "steps": rng.random() < (int(x * 7) / 7)}[shape]
        rows.append((["a", None, "b"][i % 3], x, int(hit)))
    return rows


@pytest.mark.parametrize("shape, stretch", [(s, 1 << 17) for s in ("noise", "rising", "falling", "ties", "steps")] + [("rising", 4), ("noise", 4)])
def test_fit_equals_formula(spark, distributed, monkeypatch, shape, stretch):
    monkeypatch.setattr(isotonic, "STRETCH", stretch)
    rows = sample(240, 11, shape)
    df = spark.createDataFrame(rows + [("a", None, 1), ("a", float("nan"), 1), ("b", 0.5, None)], "g string, x double, hit int").repartition(5)
    blocks = isotonic.fit(df, ["g"], "x", "hit").collect()
    for g in ("a", None, "b"):
        want = plain([(x, h) for k, x, h in rows if k == g])
        mine = sorted((b.lo, b.hi, b.hits / b.n) for b in blocks if b.g == g)
        assert sum(b.n for b in blocks if b.g == g) == sum(k == g for k, _, _ in rows)
        assert all(p[2] < q[2] and p[1] < q[0] for p, q in zip(mine, mine[1:]))
        for x, fit in want.items():
            (value,) = [m for lo, hi, m in mine if lo <= x <= hi]
            assert value == pytest.approx(fit, abs=1e-12)


def test_stretches_give_the_same_blocks(spark, monkeypatch):
    df = spark.createDataFrame(sample(3000, 5, "rising"), "g string, x double, hit int")
    want = sorted(map(tuple, isotonic.fit(df, [], "x", "hit").collect()))
    monkeypatch.setattr(isotonic, "STRETCH", 10)
    assert len(want) > 20 and sorted(map(tuple, isotonic.fit(df, [], "x", "hit").collect())) == want


def test_pool_one_pass():
    assert isotonic.pool([1, 2, 3, 4], [1, 2, 3, 4], [1, 0, 1, 1], [1, 1, 1, 1]) == ([1, 3], [2, 4], [1, 2], [2, 2])
    assert isotonic.pool([], [], [], []) == ([], [], [], [])
    big = 3 * 10**18
    assert isotonic.pool([1, 2], [1, 2], [big - 1, big], [big, big])[0] == [1, 2]  # means that doubles cannot tell apart


@pytest.mark.parametrize("few", [1000, 0])
def test_map(spark, few):
    table = spark.createDataFrame([(0.2, 0.1), (0.4, 0.1), (0.5, 0.6), (0.9, 1.0)], "x double, q double")
    asked = [(0, 0.0), (1, 0.2), (2, 0.3), (3, 0.45), (4, 0.5), (5, 0.7), (6, 0.9), (7, 5.0), (8, None), (9, float("nan")), (5, 0.7)]
    df = spark.createDataFrame([(i, x, "z", i, 1.0, 2.0) for i, x in asked], "id int, p double, `_x` string, `_i` int, q double, x double")
    out = isotonic.apply(df, table, "p", "f", few)
    assert out.columns == [*df.columns, "f"]
    got = sorted((r.id, r.f if r.f is None else round(r.f, 9)) for r in out.collect())
    assert got == sorted([(0, 0.1), (1, 0.1), (2, 0.1), (3, 0.35), (4, 0.6), (5, 0.8), (6, 1.0), (7, 1.0), (8, None), (9, None), (5, 0.8)], key=lambda r: (r[0], r[1]))
    assert {r.f for r in isotonic.apply(df, table.limit(0), "p", "f", few).collect()} == {None}
    one = isotonic.apply(df, table.limit(1), "p", "f", few)
    assert {r.f for r in one.where("p is not null and not isnan(p)").collect()} == {0.1}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double, hit int")
    blocks = isotonic.fit(df, ["g"], "x", "hit")
    assert blocks.count() == 0 and isotonic.knots(blocks, ["g"]).columns == ["g", "x", "q"]


def test_knots(spark):
    blocks = spark.createDataFrame([(0.1, 0.1, 1, 4), (0.3, 0.6, 1, 2)], "lo double, hi double, hits long, n long")
    assert sorted(map(tuple, isotonic.knots(blocks, []).select("x", F.col("q")).collect())) == [(0.1, 0.25), (0.3, 0.5), (0.6, 0.5)]

"""Hard negatives against a plain search, with odd rows, several blocks and slots of one score."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ordinalis.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, id long, score long, anchor_id long, j long, of string, pos long, slot long, found int"
CLASH = (1, 2, 3, 4, "x", 5, 6, 7)


def plain(rows, k=5, n=10):
    import numpy as np

    good = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731 - shorter vectors end in zeros
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, m) for j, m, w in good if j != i)
        for p, pid, _ in [o for o in others if o[2] == label][:k]:
            kept = [(s, j) for s, j, m in others if m != label and 30 * -p <= 100 * -s <= 90 * -p][:n]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(kept, 1)]
    return sorted(out)


def table(seed=3, size=700):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [round(rng.gauss(0, 1), 1) for _ in range(4)]) for i in range(size)]
    rows += [(i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1200)]                          # one vector many times: ties
    rows += [(None, 1, [1.0] * 4), (2000, None, [1.0] * 4), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 2, [float("nan")] * 4),
             (2004, 2, [float("inf")] * 4), (2100, 1, []), (2101, 0, [3.0]), (2102, 0, [1.0] * 9), (2200, 0, [2.0] * 9)]
    return rows + [(300, 1, [1.0, 1.0, 0.0, 0.0])] * 2 + [(301, 1, [1.0, 1.0, 0.0, 0.0])] * 3  # repeated rows


def frame(spark, rows):
    return spark.createDataFrame([r + CLASH for r in rows], SCHEMA)


def mine(df):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("block, gather", [(1 << 13, 1 << 19), (3, 50)])
def test_equals_plain(spark, monkeypatch, block, gather):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hn, "GATHER", gather)
    rows = table()
    want = plain(rows)
    assert len(want) > 300
    assert mine(frame(spark, rows).repartition(5)) == want


def test_empty_and_none_found(spark):
    assert mine(frame(spark, []).limit(0)) == []
    assert mine(frame(spark, [(None, 1, [1.0])])) == []
    assert mine(frame(spark, [(100, 1, [1.0]), (1, 1, [2.0])])) == []      # no row of another label
    assert mine(frame(spark, [(100, 1, [1.0]), (1, 1, [-2.0]), (2, 2, [-1.0])])) == []  # a window over a negative score is empty
    assert mine(frame(spark, [(100, 1, [0.0]), (1, 1, [0.0]), (2, 2, [5.0])])) == [(100, 1, 1, 2, 0, 0)]


def test_large_products_are_exact(spark):
    big = 3.0e6
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big * 0.5, 0.25]), (3, 2, [big * 0.5, 0.5])]
    assert mine(frame(spark, rows)) == plain(rows)
    with pytest.raises(Exception, match="does not fit"):
        mine(frame(spark, [(0, 1, [1e30]), (1, 1, [1e30])]))

import pytest
from pyspark.sql import functions as F

from ordinalis.operators import calibration as cal
from ordinalis.operators import evaluation as ev


def pairs(spark, rows):
    return spark.createDataFrame([(i, y, yp, *p) for i, (y, yp, *p) in enumerate(rows)],
                                 "id int, y int, yp int" + (", p0 double, p1 double, p2 double" if len(rows[0]) > 2 else ""))


def point(spark, rows):
    return ev.point_metrics(ev.confusion_counts(pairs(spark, rows)), []).first()


def test_perfect_prediction(spark):
    m = point(spark, [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2), (2, 2)])
    assert (m.qwk, m.macro_f1, m.balanced_acc, m.detractor_recall) == (1.0, 1.0, 1.0, 1.0)


def test_off_by_two_is_worse_than_off_by_one(spark):
    one = point(spark, [(0, 1), (1, 1), (2, 2), (0, 0)]).qwk
    two = point(spark, [(0, 2), (1, 1), (2, 2), (0, 0)]).qwk
    assert two < one


def test_undefined_values(spark):
    m = point(spark, [(1, 1), (1, 1)])
    assert m.qwk is None and m.detractor_recall == 0.0 and m.macro_f1 == 1.0


def test_macro_f1_ignores_unseen_labels(spark):
    m = point(spark, [(0, 0), (0, 1), (1, 1)])
    assert m.macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 2) and m.balanced_acc == pytest.approx(0.75)


def test_lift(spark):
    rows = [(0 if i < 10 else 1, 1, 1.0 - i / 100, 0.0, 0.0) for i in range(100)]
    r = ev.lift(pairs(spark, rows), []).first()
    assert r.lift_10 == pytest.approx(10.0) and r.lift_20 == pytest.approx(5.0)
    none = [(1, 1, 0.5, 0.5, 0.0)] * 10
    assert ev.lift(pairs(spark, none), []).first().lift_10 == 0.0


def test_lift_tie_goes_to_lower_id(spark):
    rows = [(1, 1, 0.5, 0.5, 0.0)] * 5 + [(0, 0, 0.5, 0.5, 0.0)] * 5
    assert ev.lift(pairs(spark, rows), [], {"l": 0.5}).first().l == 0.0


@pytest.mark.parametrize("force", [False, True])
def test_lift_curve_against_brute_force(spark, force, request):
    if force:
        request.getfixturevalue("distributed")
    n = 237
    rows = [((i * 13) % 3, 0, ((i * 37) % 50) / 50, 0.0, 0.0) for i in range(n)]
    order = sorted(range(n), key=lambda i: (-rows[i][2], i))
    hits = [rows[i][0] == 0 for i in order]
    got = {r.grid: r for r in ev.lift_curve(pairs(spark, rows), [], 20).collect()}
    assert sorted(got) == list(range(1, 21))
    for g, r in got.items():
        k = max(1, n * g // 20)
        assert r.k == k and r.captured == pytest.approx(sum(hits[:k]) / sum(hits))


def test_lift_curve_keeps_every_grid_point_of_a_short_table(spark):
    rows = [(0, 0, 0.9, 0.1, 0.0), (1, 1, 0.5, 0.5, 0.0), (0, 0, 0.1, 0.9, 0.0)]
    assert ev.lift_curve(pairs(spark, rows), [], 10).count() == 10


def test_bin_edges(spark):
    """0.3 lies below the third edge 0.30000000000000004; 1.0 belongs to the last bin."""
    df = pairs(spark, [(0, 0, 0.3, 0.7, 0.0), (1, 1, 0.0, 0.0, 1.0)])
    bins = {(r.class_idx, r.bin_id): r.n for r in cal.reliability_curve(df, []).collect() if r.n}
    assert bins[(0, 2)] == 1 and bins[(0, 0)] == 1 and bins[(2, 9)] == 1
    assert cal.reliability_curve(df, []).count() == 30


def test_calibrated_scores_have_small_error(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10 / 10 + 0.05).alias("p0")).select(
        "id", "p0", (1 - F.col("p0")).alias("p1"), F.lit(0.0).alias("p2"),
        F.when((F.floor(F.col("id") / 10) % 300) < F.col("p0") * 300, 0).otherwise(1).alias("y"))
    rep = {r.class_idx: r for r in cal.calibration_report(df, []).collect()}
    assert rep[0].ece < 0.01 and rep[2].brier == 0.0
    slow = {r.class_idx: r for r in cal.calibration_report(df, [], strategy="quantile").collect()}
    assert slow[0].brier == pytest.approx(rep[0].brier)


def test_hybrid_keeps_prediction_metrics(spark):
    rows = [(i, i % 3, (i * 7) % 3, ((i * 11) % 17) / 17, ((i * 5) % 13) / 13) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, yp int, p0 double, q0 double").withColumn("yq", F.lit(1))
    modes = {r.metric: r for r in ev.hybrid_modes(df).collect()}
    assert modes["qwk"].after_hybrid == modes["qwk"].before
    assert modes["lift@10"].after_hybrid == modes["lift@10"].after_full
    assert modes["detractor_recall"].after_full == 0.0

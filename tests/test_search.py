import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ordinalis.operators import search


@pytest.fixture(scope="module")
def rows(spark):
    """One space carries the class, the other is noise."""
    i = F.col("id")
    y = (i % 3).cast("int")
    split = F.when(F.floor(i / 3) % 5 < 3, "train").when(F.floor(i / 3) % 5 == 3, "val").otherwise("test")
    told = array_to_vector(F.array(y.cast("double") + ((i * 37) % 100) / 200.0, F.lit(1.0)))
    noise = array_to_vector(F.array(((i * 53) % 97) / 97.0, F.lit(1.0)))
    return spark.range(450).select("id", y.alias("y"), split.alias("split"), told.alias("told"), noise.alias("noise")).cache()


def test_points_are_seeded_and_nested():
    assert search.draw_points("boosted", 5) == search.draw_points("boosted", 9)[:5]
    assert search.draw_points("boosted", 5) != search.draw_points("boosted", 5, seed=1)
    a = search.recipe({"logistic": 3}, ["x"])
    assert a == search.recipe({"logistic": 3}, ["x"]) and len({a, search.recipe({"logistic": 4}, ["x"]), search.recipe({"logistic": 3}, ["x"], 8)}) == 3


def test_rungs_are_nested_and_stratified(rows):
    out = search.rung_rows(rows.filter("id <> 1 and (y < 2 or id < 12)"))
    assert out.filter("(_r0 and not _r1) or (_r1 and not _r2) or not _r2").count() == 0
    for y, n, n0, n1 in out.groupBy("y").agg(F.count(F.lit(1)), F.count_if("_r0"), F.count_if("_r1")).collect():
        assert n0 == -(-n // 9) and n1 == -(-n // 3), y


def test_halving_finds_the_space_that_tells(rows):
    log, best = search.halving(rows, {"logistic": 6, "ordinal": 4}, ["told", "noise"])
    got = log.collect()
    count = lambda **kw: sum(all(r[k] == v for k, v in kw.items()) for r in got)
    assert count(rung=0) == 10 and count(rung=0, space="told", model="logistic") == 3
    assert count(rung=1, space="told", model="logistic") == 1 and count(rung=2, kept=True) == 4
    assert {r.n_train for r in got if r.rung == 2} == {270} and {r.n_train for r in got if r.rung == 0} == {30}
    last = {(r.space, r.model): r.value for r in got if r.rung == 2 and r.kept}
    assert max(v for (s, _), v in last.items() if s == "told") > 0.8 > 0.3 > max(v for (s, _), v in last.items() if s == "noise")
    for space, (model, _) in best.items():
        assert last[space, model] == max(v for (s, _), v in last.items() if s == space)
    scores = search.score_champions(rows, best)
    assert scores.count() == 900 and scores.filter("abs(p0 + p1 + p2 - 1) > 1e-9 or yp is null").count() == 0
    again, same = search.halving(rows.repartition(5), {"logistic": 6, "ordinal": 4}, ["told", "noise"])
    key = ["space", "model", "number", "rung"]
    assert same == best and again.select(*key, F.round("value", 6)).exceptAll(log.select(*key, F.round("value", 6))).count() == 0


def test_fits_wait_for_few_tasks_and_weigh_classes_once(spark, rows, monkeypatch):
    seen = []
    real = search.FITTERS["logistic"]
    monkeypatch.setitem(search.FITTERS, "logistic", lambda df, **kw: (seen.append((df.rdd.getNumPartitions(), "_w" in df.columns)), real(df, **kw))[1])
    search.halving(rows.repartition(7), {"logistic": 2}, ["told"])
    assert seen and set(seen) == {(1, True)}
    assert search.in_parts(spark.range(0, 10, 1, 7), 10 * search.PART_ROWS).rdd.getNumPartitions() == 7  # never split


def test_a_space_without_trials_is_an_error(rows):
    with pytest.raises(ValueError):
        search.halving(rows, {"logistic": 1}, ["told", "noise"])
    with pytest.raises(ValueError):
        search.halving(rows, {}, ["told"])

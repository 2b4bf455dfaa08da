import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ordinalis.operators import evaluation as ev
from ordinalis.operators import explain, models
from ordinalis.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    """Feature 0 carries the class, feature 1 is noise, feature 2 is constant."""
    i = F.col("id")
    y = (i % 3).cast("int")
    x0 = y.cast("double") + ((i * 37) % 100) / 80.0
    x1 = ((i * 53) % 97) / 97.0
    split = F.when(F.floor(i / 3) % 5 < 3, "train").when(F.floor(i / 3) % 5 == 3, "val").otherwise("test")
    return spark.range(600).select("id", y.alias("y"), array_to_vector(F.array(x0, x1, F.lit(1.0))).alias("features"),
                                   split.alias("split"), F.when(i % 2 == 0, "a").otherwise("b").alias("seg")).cache()


@pytest.mark.parametrize("name,params", [("logistic", {}), ("ordinal", {}), ("boosted", {"depth": 2, "iterations": 4})])
def test_models_give_probabilities_and_learn(spark, rows, name, params):
    model = models.FITTERS[name](rows.filter("split = 'train'"), **params)
    out = model.score(rows.filter("split = 'test'"))
    assert out.filter("abs(p0 + p1 + p2 - 1) > 1e-9 or least(p0, p1, p2) < 0 or greatest(p0, p1, p2) > 1").count() == 0
    assert ev.evaluate(out, [], probabilities=False).first().qwk > 0.5
    path = scratch_path(spark, name)
    model.save(path)
    again = models.load_model(spark, path).score(rows.filter("split = 'test'"))
    assert out.select("id", "p0", "yp").exceptAll(again.select("id", "p0", "yp")).count() == 0


def test_class_weights_balance(rows):
    skew = rows.filter("y = 0 or id % 6 < 3")
    total = skew.withColumn("w", models.class_weight(skew)).groupBy("y").agg(F.sum("w").alias("w"))
    assert len({round(r.w, 6) for r in total.collect()}) == 1


def test_baselines_and_tuning(spark, rows):
    table = models.run_baselines(rows.withColumn("t", F.col("y")), {"only": "t"}, ["ordinal"]).collect()
    assert {r.split for r in table} == {"train", "val", "test"} and all(r.model == "ordinal" for r in table)
    log, best = models.tune(rows, "logistic", {"reg": [0.001, 100.0]})
    values = {r.params: r.value for r in log.collect()}
    assert len(values) == 2 and best == {"reg": 0.001}


def test_baselines_are_fitted_side_by_side(rows, monkeypatch):
    """Every fit waits for the others: one after another they would not get past the barrier."""
    import threading
    together = threading.Barrier(4, timeout=60)

    def fit(train, **_):
        assert "_w" in train.columns
        together.wait()
        return models.fit_logistic(train, iterations=2)
    monkeypatch.setattr(models, "FITTERS", {"one": fit, "two": fit})
    got = models.run_baselines(rows.withColumn("t", F.col("y")), {"a": "t", "b": "y"}).collect()
    assert {(r.target, r.model) for r in got} == {(t, m) for t in "ab" for m in ("one", "two")}


@pytest.mark.parametrize("how", [models.isotonic_recalibrate, models.platt_recalibrate])
def test_recalibration(rows, how):
    scored = models.fit_logistic(rows.filter("split = 'train'")).score(rows)
    out = how(scored.filter("split = 'val'"), scored.filter("split = 'test'"))
    assert out.filter("abs(q0 + q1 + q2 - 1) > 1e-9").count() == 0 and out.count() == 120
    assert out.filter("yp is null").count() == 0


def test_isotonic_is_monotone(spark):
    df = spark.range(300).select("id", (F.col("id") / 300).alias("p0"), F.lit(0.3).alias("p1"), F.lit(0.3).alias("p2"),
                                 F.when((F.col("id") * 17) % 300 < F.col("id"), 0).otherwise(1).alias("y"), F.lit(0).alias("yp"))
    q = [r.q0 for r in models.isotonic_recalibrate(df, df).withColumn("r", F.col("q0") / (F.col("q1") + F.col("q2"))).orderBy("id").collect()]
    assert all(a <= b + 1e-9 for a, b in zip(q, q[1:]))


def test_pca_is_centred_and_fitted_on_train(spark, rows):
    model = models.fit_pca(rows.filter("split = 'train'"), "features", 2)
    from pyspark.ml.functions import vector_to_array
    mean = model.transform(rows.filter("split = 'train'")).select(F.avg(vector_to_array("components")[0])).first()[0]
    assert mean == pytest.approx(0, abs=1e-9)
    first = models.pca_loadings(spark, model, 1).filter("component = 1").first()
    assert first.dim == 0 and first.rank == 1


def test_permutation_importance_finds_the_signal(rows):
    model = models.fit_logistic(rows.filter("split = 'train'"))
    table = explain.permutation_importance(model.score, rows.filter("split = 'test'"), ["signal", "PC1", "flat"]).collect()
    assert {r.feature for r in table if r.rank_in_class == 1} == {"signal"} and len(table) == 9
    assert all(r.mean_abs_change == 0 for r in table if r.feature == "flat")
    assert all(r.is_component == (r.feature == "PC1") for r in table)
    seg = explain.segment_permutation(model.score, rows.filter("split = 'test'"), ["signal", "PC1", "flat"], ["seg"])
    assert {(r.segment, r.group) for r in seg.collect()} == {("seg", "a"), ("seg", "b")}


def test_donor_is_a_permutation(rows):
    out = explain.with_donor(rows.select("id", "features"), "id")
    assert out.count() == 600
    given = [tuple(r[0].toArray()) for r in out.select("_donated").collect()]
    own = [tuple(r[0].toArray()) for r in rows.select("features").collect()]
    assert sorted(given) == sorted(own) and given != own


def test_linear_attributions(spark, rows):
    model = models.fit_logistic(rows.filter("split = 'train'"))
    coef = explain.coefficient_table(spark, model.stages[0].coefficientMatrix.toArray(), ["signal", "noise", "flat"])
    std = explain.feature_std(rows, [])
    top = explain.linear_importance(coef, std).filter("rank_in_class = 1 and class_idx <> 1").collect()
    assert {r.feature for r in top} == {"signal"}
    scored = model.score(rows.filter("id < 20"))
    contributions = explain.linear_contributions(coef, scored, "id")
    assert contributions.count() == 60
    assert explain.waterfall(contributions, "id", 3, 2).count() == 2
    groups = explain.linear_segment_importance(coef, rows.filter("id % 2 = 0 or id < 30"), ["seg"], 2)
    assert {r.group for r in groups.collect()} == {"a"}


def test_archetypes(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.9, 0.1, 0.0), (2, 0, 1, 0.95, 0.0, 0.0), (3, 1, 0, 0.2, 0.7, 0.0), (4, 1, 2, 0.0, 0.8, 0.0)],
                               "id int, y int, yp int, p0 double, p1 double, p2 double")
    got = {(r.y, r.id) for r in explain.pick_archetypes(df, 2).collect()}
    assert got == {(0, 1), (1, 4), (1, 3)}


def test_counterfactual_counts_changes(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 4 == 0 else "No", "x") for i in range(40)], "id int, s string, one string")
    predict = lambda d: d.withColumn("yp", F.when(F.col("s") == "Yes", 0).otherwise(1))
    got = {r.segment: r for r in explain.counterfactual_flip(df, ["s", "one"], predict).collect()}
    assert got["s"].n_changed == 40 and got["s"].detractor_to_other == 10 and got["one"].n_changed == 0


def test_with_text_keeps_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, y int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (3, None), (9, [5.0, 6.0])], "id long, embedding array<float>")
    got = {r.id: list(r.text_vector.toArray()) for r in models.with_text(df, vectors, "id").collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}

import pytest
from pyspark.sql import functions as F

from ordinalis.functions import confusion as cf
from ordinalis.operators import bootstrap as bs
from ordinalis.operators import fairness as fair


def noisy(spark, n=600):
    y = (F.col("id") % 3).cast("int")
    yp = F.when(F.col("id") % 5 < 3, y).otherwise((F.floor(F.col("id") / 5) % 3).cast("int"))
    return spark.range(n).select("id", y.alias("y"), yp.alias("yp"), ((F.col("id") * 37) % 101 / 101).alias("p0"),
                                 F.lit(0.2).alias("p1"), F.lit(0.1).alias("p2"), (F.col("id") % 2).cast("int").alias("g"))


def totals(r):
    return [r.n00 + r.n01 + r.n02, r.n10 + r.n11 + r.n12, r.n20 + r.n21 + r.n22]


@pytest.mark.parametrize("mode", ["multinomial", "index"])
def test_replicates_keep_class_sizes(spark, mode):
    df = noisy(spark)
    if mode == "index":
        reps = bs.weighted_counts(bs.index_weights(df, [], 5), [])
    else:
        reps = bs.multinomial_counts(df.groupBy().agg(*cf.counts()), [], 20)
    for r in reps.collect():
        assert totals(r) == [200, 200, 200]


@pytest.mark.parametrize("mode,b", [("multinomial", 300), ("index", 40)])
def test_interval_brackets_point(spark, mode, b):
    for r in bs.bootstrap_all(noisy(spark), ["g"], b, mode=mode).collect():
        assert r.ci_lo <= r.value <= r.ci_hi, r


def test_modes_agree(spark):
    a = {r.metric: r for r in bs.bootstrap_all(noisy(spark), [], 800).collect()}
    b = {r.metric: r for r in bs.bootstrap_all(noisy(spark), [], 200, mode="index").collect()}
    assert set(a) == set(b) == {"qwk", "macro_f1", "balanced_acc", "detractor_recall", "lift@10", "lift@20"}
    for m in ("qwk", "macro_f1", "detractor_recall"):
        width = a[m].ci_hi - a[m].ci_lo
        assert abs(a[m].ci_lo - b[m].ci_lo) <= 0.3 * width and abs(a[m].ci_hi - b[m].ci_hi) <= 0.3 * width


def test_replicates_do_not_depend_on_partitioning(spark):
    cm = noisy(spark).groupBy("g").agg(*cf.counts())
    a = sorted(map(tuple, bs.multinomial_counts(cm, ["g"], 30).collect()))
    b = sorted(map(tuple, bs.multinomial_counts(cm.coalesce(1), ["g"], 30).collect()))
    assert a == b


def test_without_probabilities_lift_is_skipped(spark):
    out = bs.bootstrap_all(noisy(spark).drop("p0", "p1", "p2"), [], 20, probabilities=False)
    assert {r.metric for r in out.collect()} == {"qwk", "macro_f1", "balanced_acc", "detractor_recall"}


def test_draws_are_one_row_a_drawn_row_and_follow_the_keyed_hash(spark):
    from ordinalis.functions.hashing import uniform
    df = noisy(spark, 90)
    drawn = bs.index_draws(df, ["g"], 4)
    assert drawn.count() <= 90 and drawn.select(F.sum(F.size("_bs"))).first()[0] == 4 * 90
    got = sorted((r.g, r.y, r.id, r.b, r.w) for r in bs.draw_weights(drawn).collect())
    groups = {}
    for r in df.orderBy("id").collect():
        groups.setdefault((r.g, r.y), []).append(r.id)
    u = {(r.b, r.y, r.j): r.u for r in spark.range(1, 91).withColumnRenamed("id", "j").crossJoin(spark.range(3).withColumnRenamed("id", "y"))
         .crossJoin(spark.range(1, 5).withColumnRenamed("id", "b")).withColumn("u", uniform(42, "boot", F.col("b"), F.col("y"), F.col("j"))).collect()}
    want = {}
    for (g, y), ids in groups.items():
        for b in range(1, 5):
            for j in range(1, len(ids) + 1):
                at = (g, y, ids[int(u[b, y, j] * len(ids))], b)
                want[at] = want.get(at, 0) + 1
    assert got == sorted((*k, w) for k, w in want.items())


def test_weighted_lift_orders_missing_and_tied_scores_as_the_plain_order_does(spark):
    rows = [(i, i % 3, 1 + i % 4, None if i % 17 == 0 else float("nan") if i % 19 == 0 else (i * 7 % 5) / 5, i % 2) for i in range(120)]
    df = spark.createDataFrame([(*r, b) for r in rows for b in (1, 2)], "id long, y int, w long, p0 double, g int, b int")
    key = lambda r: (0 if r[3] is None else 1, 0 if r[3] is None else float("inf") if r[3] != r[3] else -r[3], r[0])
    for out in bs.weighted_lift(df, ["g"]).collect():
        copies = [r for r in sorted((r for r in rows if r[4] == out.g), key=key) for _ in range(r[2])]
        base = sum(r[1] == 0 for r in copies) / len(copies)
        for name, share in (("lift_10", 0.1), ("lift_20", 0.2)):
            k = max(1, int(len(copies) * share))
            assert abs(out[name] - sum(r[1] == 0 for r in copies[:k]) / k / base) < 1e-12


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        bs.bootstrap_all(noisy(spark), [], 5, mode="jackknife")


def test_small_groups_have_no_interval(spark):
    df = spark.createDataFrame([("a", 0, 0)] * 4 + [("a", 1, 1)] * 20 + [("b", 0, 0)] * 10 + [("b", 1, 0)] * 10, "group string, y int, yp int")
    cm = df.groupBy("group").agg(*cf.counts())
    out = {(r.group, r.class_idx): r for r in bs.group_bootstrap(cm, bs.multinomial_counts(cm, ["group"], 50), ["group"]).collect()}
    assert out[("a", 0)].recall == 1.0 and out[("a", 0)].recall_ci_lo is None
    assert out[("b", 0)].recall_ci_lo is not None and out[("b", 2)].recall is None


def two_groups(spark):
    """Published arithmetic: recall 27/117 in one group against 491/852 in the other."""
    rows = [("Yes", 2, 2)] * 27 + [("Yes", 2, 1)] * 90 + [("No", 2, 2)] * 491 + [("No", 2, 1)] * 361
    return spark.createDataFrame(rows, "senior string, y int, yp int")


def test_published_disparities(spark):
    counts = fair.group_counts(two_groups(spark), ["senior"], [])
    r = fair.audit(counts, [], (2,)).first()
    assert round(r.di_worst, 3) == 0.400 and round(r.eod, 3) == 0.346
    assert (r.di_worst_group, r.di_reference_group, r.eod_max_group, r.eod_min_group) == ("Yes", "No", "No", "Yes")
    assert r.di_status == "biased" and r.verdict == "disparity"


def test_reference_group_and_undefined(spark):
    rates = fair.group_rates(fair.group_counts(two_groups(spark), ["senior"], []), [], (0, 2))
    di = {(r.group, r.class_idx): r for r in fair.disparate_impact(rates, [], "Yes").collect()}
    assert di[("No", 2)].di == pytest.approx((491 / 852) / (27 / 117)) and di[("Yes", 2)].di == 1.0
    assert di[("No", 0)].di_status == "undefined"


def test_tied_groups_pick_first_name(spark):
    df = spark.createDataFrame([("b", 0, 0), ("a", 0, 0)], "s string, y int, yp int")
    r = fair.audit(fair.group_counts(df, ["s"], []), [], (0,)).first()
    assert (r.di_worst_group, r.eod_max_group, r.eod_min_group) == ("a", "a", "a") and r.verdict == "fair"


def test_transitions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 1), (1, 2)], "yp int, yp_flip int")
    r = fair.transitions(df, []).first()
    assert (r.n, r.n_changed, r.detractor_to_other, r.other_to_detractor, r.promoter_to_other, r.other_to_promoter) == (5, 4, 1, 1, 1, 1)


def test_interval_brackets_the_point_of_a_rare_class(spark):
    """Scores of a rare class lie in a sliver of the range; the top tenth still has to be found in it."""
    rows = [(i, 0 if i < 100 else 1, 1, (4000 - i) / 4000 * 5e-4) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, y int, yp int, p0 double")
    hist = bs.cells_to_histogram(bs.score_cells(df, []), [])
    lifts = [r.lift_at_10 for r in bs.multinomial_lift(hist, [], 50, shares={"lift_at_10": 0.1}).collect()]
    assert min(lifts) > 9.5 and max(lifts) <= 10.5


def narrow(spark, n=4000):
    rows = [(i, 0 if i < n // 10 else 1 + i % 2, 1, 0.5019 - 0.0018 * i / n) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y int, yp int, p0 double")


def lift(table, metric="lift@10"):
    (row,) = [r for r in table.collect() if r.metric == metric]
    return row


def test_interval_of_a_narrow_score_range_equals_index_mode(spark):
    """All scores within 0.0018 of each other: the point lift is 10, and both modes say so."""
    df = narrow(spark)
    fast, exact = (lift(bs.bootstrap_all(df, [], n, mode=m)) for m, n in (("multinomial", 400), ("index", 20)))
    assert fast.value == exact.value == pytest.approx(10.0)
    assert 9.0 < fast.ci_lo <= 10.0 and fast.ci_hi == pytest.approx(exact.ci_hi, abs=0.5) and fast.ci_lo == pytest.approx(exact.ci_lo, abs=0.6)


def test_groups_have_their_own_edges(spark):
    wide = spark.range(900).select(F.lit("wide").alias("g"), F.col("id").cast("int"), (F.col("id") % 3).cast("int").alias("y"), F.lit(1).alias("yp"),
                                   (F.col("id") / 900).alias("p0"))
    df = narrow(spark).select(F.lit("narrow").alias("g"), "id", "y", "yp", "p0").unionByName(wide)
    df = df.unionByName(df.where("g = 'wide'").limit(5).withColumn("g", F.lit(None).cast("string")).withColumn("p0", F.lit(None).cast("double")))
    cells = bs.score_cells(df, ["g"])
    slots = {r.g: r.n for r in cells.select("g", "slot").distinct().groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert slots["wide"] == 900 and slots["narrow"] > 1500 and slots[None] == 1
    assert {r.slot for r in cells.where("g is null").collect()} == {bs.LIFT_BINS + 1}
    assert cells.groupBy("g").agg(F.max("slot").alias("m")).where("g is not null and m > 2047").count() == 0


@pytest.mark.parametrize("score, want", [(2.0, 0), (0.9, 0), (0.85, 1), (0.5, 1), (0.1, 2), (0.05, 3), (None, bs.LIFT_BINS + 1)])
def test_score_slot(spark, score, want):
    df = spark.createDataFrame([([0.9, 0.5, 0.1], score)], "e array<double>, p double")
    assert df.select(bs.score_slot(F.col("e"), F.col("p"))).first()[0] == want


def test_slots_count_the_edges_above(spark):
    edges = [1 - i / 2047 for i in range(2048)]
    df = spark.range(3000).select((F.col("id") / 2999).alias("p"), F.array(*[F.lit(e) for e in edges]).alias("e"))
    assert [sum(e > r.p for e in edges) for r in df.collect()[::97]] == [r.s for r in df.select(bs.score_slot(F.col("e"), F.col("p")).alias("s")).collect()[::97]]


def test_batch_sized_replicates_keep_rare_cells(spark):
    """A cell with 40 of 100,000 rows appears in about a third of the batches of 1,000, and the mean stays right."""
    cm = spark.createDataFrame([(49_960, 40, 0, 0, 30_000, 0, 0, 0, 20_000)], ", ".join(f"n{i}{j} long" for i in range(3) for j in range(3)))
    reps = bs.multinomial_counts(cm, [], 3000, batch=1000).toPandas()
    assert (reps[["n00", "n01", "n02"]].sum(axis=1) == 500).all() and (reps["n11"] == 300).all() and (reps["n22"] == 200).all()
    assert reps["n01"].mean() == pytest.approx(0.4, abs=0.06) and 0.25 < (reps["n01"] > 0).mean() < 0.42


def test_digests_of_many_positions_are_those_of_the_keyed_hash():
    import hashlib
    uniforms = bs._uniforms()
    for seed, b, y, first, n in ((42, 1, "0", 1, 1200), (42, 999, "2", 99_990, 30), (-7, 12, "1", 7, 1), (42, 1000, "1", 9_999_990, 20), (1, 7, "x" * 45, 5, 8)):
        want = [int(hashlib.md5(f"{seed}:boot:{b}:{y}:{j}".encode()).hexdigest()[:12], 16) / 2.0**48 for j in range(first, first + n)]
        assert uniforms(seed, b, y, first, n).tolist() == want


def test_draws_that_cross_chunks_and_blocks_are_the_same(spark, monkeypatch):
    df = noisy(spark, 200).withColumn("y", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("y"))).withColumn("g", F.when(F.col("g") == 1, 1))
    rows = lambda: sorted((r.g is None, r.id, r.b, r.w) for r in bs.index_weights(df, ["g"], 7).collect())
    whole = rows()
    for name, value in (("_CHUNK", 8), ("_BLOCK", 16), ("_STEP", 3)):
        monkeypatch.setattr(bs, name, value)
    assert rows() == whole and sum(r[3] for r in whole) == 7 * 196


@pytest.mark.parametrize("name", ["bootstrap_all_metrics", "ci_overlap", "report_table", "group_bootstrap"])
def test_interval_queries_draw_a_thousand_replicates(spark, tmp_path, monkeypatch, name):
    from ordinalis.plans import bootstrap as plans
    from ordinalis.plans.registry import ORACLES
    orders = spark.range(1, 61).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "100.5D + id AS o_totalprice", "'F' AS o_orderstatus",
                                           "date'2020-01-01' AS o_orderdate", "concat(id % 5 + 1, '-X') AS o_orderpriority")
    own = {"orders": orders, "customer": spark.range(7).selectExpr("id AS c_custkey", "'A' AS c_mktsegment", "id AS c_nationkey"),
           "nation": spark.range(7).selectExpr("id AS n_nationkey", "id % 2 AS n_regionkey"),
           "region": spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name")}
    for table, rows in own.items():
        rows.write.parquet(f"{tmp_path}/{table}.parquet")

    def asked(df, by, replicates, seed=42):
        raise InterruptedError(f"{df.count()} rows, {replicates} replicates")

    monkeypatch.setattr(bs, "index_draws", asked)
    with pytest.raises(InterruptedError, match=f"^{360 if name == 'group_bootstrap' else 120} rows, 1000 replicates$"):
        getattr(plans, name)(spark, str(tmp_path))
    assert "range(1, 1001)" in ORACLES[name]

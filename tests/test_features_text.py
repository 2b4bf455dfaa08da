import pytest
from pyspark.sql import functions as F

from ordinalis.constants import CLASSES
from ordinalis.operators import encoding, features, sampling, text
from ordinalis.session import scratch_path
from ordinalis.sources.store import Store

KEY = "Customer ID"


def customers(spark, n=200):
    i = F.col("id")
    pick = lambda values, e: F.element_at(F.array(*[F.lit(v) for v in values]), (e % len(values) + 1).cast("int"))
    yes = lambda k: pick(["Yes", "No", " yes ", "no"], F.floor(i / k))
    return spark.range(n).select(
        i.alias(KEY), (i % 72).cast("int").alias("Tenure Months"), (20 + i % 100).cast("double").alias("Monthly Charges"),
        (i * 17 % 8000).cast("double").alias("Total Charges"), yes(1).alias("Phone Service"), yes(2).alias("Online Security"),
        yes(3).alias("Online Backup"), yes(4).alias("Device Protection"), yes(5).alias("Tech Support"), yes(7).alias("Streaming TV"),
        yes(2).alias("Paperless Billing"), pick(["Electronic check", "Bank transfer (automatic)"], i).alias("Payment Method"),
        pick(["Month-to-month", "One year", "Two year"], i).alias("Contract"), (i % 6).cast("int").alias("Number of Referrals"),
        (18 + i % 60).cast("int").alias("Age"), F.when(i % 10 == 0, 5.0).alias("Total Refunds"), F.when(i % 2 == 0, "A").alias("Offer"),
        (i * 31 % 997).cast("int").alias("Population"), pick(["Fiber", "DSL", "None"], i).alias("Internet Type"),
        pick(CLASSES, F.floor(i / 2)).alias("NPS_baseline"))


def test_derive_is_idempotent(spark):
    once = features.derive_all(customers(spark))
    twice = features.derive_all(once)
    assert once.columns == twice.columns and once.exceptAll(twice).count() == 0
    assert once.filter("n_services > 6 or n_addons > 4").count() == 0
    assert once.filter("(n_addons = 4) <> (has_security_bundle = 1)").count() == 0


def test_absent_columns_are_skipped(spark):
    out = features.derive_all(customers(spark).select(KEY, "Tenure Months"))
    assert out.columns == [KEY, "Tenure Months", "tenure_bucket", "is_paperless_autopay"]
    assert out.filter("is_paperless_autopay = 1").count() == 0


def test_tenure_edges(spark):
    df = spark.createDataFrame([(0,), (6,), (7,), (24,), (25,), (48,), (49,), (None,), (-1,)], "`Tenure Months` int")
    got = [r.tenure_bucket for r in features.tenure_bucket(df).collect()]
    assert got == ["0-6m", "0-6m", "7-24m", "7-24m", "25-48m", "25-48m", "49m+", "unknown", "unknown"]


def test_population_quartiles(spark):
    got = features.quartile_bucket(spark.range(1, 101).select(F.col("id").alias("Population")))
    assert {r.pop_density_bucket: r["count"] for r in got.groupBy("pop_density_bucket").count().collect()} == {
        "Q1_rural": 25, "Q2": 25, "Q3": 25, "Q4_urban": 25}
    flat = features.quartile_bucket(spark.range(10).select(F.lit(3).alias("Population")))
    assert {r.pop_density_bucket for r in flat.collect()} == {"unknown"}


def test_zero_tenure_ratio(spark):
    df = spark.createDataFrame([(0, 10.0), (None, 10.0), (4, 10.0)], "`Tenure Months` int, `Total Charges` double")
    assert [r.avg_monthly_charge for r in features.financial_ratios(df).collect()] == [10.0, 10.0, 2.5]


def test_flip_binary(spark):
    df = spark.createDataFrame([("Yes", "a"), ("No", "b"), (None, "c")], "x string, y string")
    out = features.flip_binary(features.flip_binary(df, "x"), "y").collect()
    assert [tuple(r) for r in out] == [("No", "a"), ("Yes", "b"), (None, "c")]


def test_encoding(spark):
    df = customers(spark).withColumn("City", F.lit("c")).withColumn("Many", (F.col(f"`{KEY}`") % 12).cast("string"))
    plan = encoding.classify_columns(df, ["Age", "Contract", "Many", "City"])
    assert plan == {"numeric": ["Age"], "onehot": ["Contract"], "ordinal": ["Many"], "dropped": ["City"]}
    train = df.filter("Contract <> 'Two year' and Many <> '3'")
    coded = encoding.encode_ordinals(df, ["Many"], train)
    model = encoding.feature_pipeline(plan).fit(encoding.encode_ordinals(train, ["Many"], train))
    out = model.transform(coded).filter("Contract = 'Two year'").select("features").first().features.toArray()
    names = encoding.encoded_names(model, df, plan)
    assert names == ["Age", "Contract_Month-to-month", "Contract_One year", "Many"] and len(out) == 4
    assert list(out[1:3]) == [0.0, 0.0] and out[3] == -1.0
    coded = encoding.ordinal_encode(df.select(KEY, "Many"), "Many", df.filter("Many <> '3'"))
    assert coded.filter("Many = -1").count() == df.filter("Many = '3'").count()
    scaled = encoding.standard_scale(df, ["Age"]).agg(F.avg("Age"), F.stddev_pop("Age")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)


def test_splits(spark):
    df = customers(spark, 1000).select(KEY, "NPS_baseline", "Tenure Months", "Age", "Contract", "Payment Method", "Paperless Billing")
    naive = sampling.naive_split(df, KEY, "NPS_baseline").join(df, KEY)
    per = {(r.NPS_baseline, r.split): r["count"] for r in naive.groupBy("NPS_baseline", "split").count().collect()}
    for cls in CLASSES:
        n = sum(v for (c, _), v in per.items() if c == cls)
        assert per[(cls, "train")] == round(n * 0.6) and per[(cls, "val")] == round(n * 0.2)
    biased = sampling.response_biased_split(df, KEY, "NPS_baseline").join(df, KEY)
    counts = {r.split: r["count"] for r in biased.groupBy("split").count().collect()}
    assert sum(counts.values()) == 1000 and counts["silent_test"] == 850
    tenure = {r.s: r.t for r in biased.groupBy((F.col("split") == "silent_test").alias("s")).agg(F.avg("Tenure Months").alias("t")).collect()}
    assert tenure[False] > tenure[True]
    with pytest.raises(ValueError):
        sampling.naive_split(df, KEY, "NPS_baseline", 0.8, 0.2)


@pytest.mark.parametrize("sizes,n", [([100, 60, 40], 50), ([580, 250, 170], 100), ([50, 30, 20], 500)])
def test_stratified_sample(spark, sizes, n):
    rows = [(i, c) for i, c in enumerate(c for c, s in enumerate(sizes) for _ in range(s))]
    out = sampling.stratified_sample(spark.createDataFrame(rows, "id int, y int"), "id", "y", n)
    got = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    total = sum(sizes)
    want = {c: s if total <= n else max(1, round(n * s / total)) for c, s in enumerate(sizes)}
    assert got == want


def test_weighted_sample_prefers_heavy_rows(spark, distributed):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("w"))
    out = sampling.weighted_sample(df, "id", F.col("w"), 0.1).filter("sampled")
    heavy = out.filter("id % 2 = 0").count()
    assert out.count() == 200 and heavy > 160


def test_text_audit(spark):
    df = spark.createDataFrame([("a short text", "x"), ("a short text", "x"), ("The NPS promoter " * 40, "y"), ("", "y")], "t string, c string")
    audit = {(r.section, r.key): r.value for r in text.quality_audit(df, "t").collect()}
    assert audit[("total", "rows")] == 4 and audit[("char_length", "above_500")] == 1 and audit[("char_length", "below_30")] == 3
    assert audit[("word_length", "median")] == 3 and audit[("char_length", "min")] == 0
    assert {r.term: r.n for r in text.term_hits(df, "t").collect()} == {"nps": 1, "promoter": 1}
    assert text.duplicate_texts(df, "t").first().n_duplicates == 1
    top = [(r["class"], r.word, r.n) for r in text.top_words(df, "t", "c", 2).orderBy("class", "rank").collect()]
    assert top == [("x", "short", 2), ("x", "text", 2), ("y", "nps", 40), ("y", "promoter", 40)]
    assert {r["class"]: r.median_chars for r in text.length_by_class(df, "t", "c").collect()} == {"x": 12, "y": 340}


def test_prompts(spark):
    df = features.derive_all(customers(spark))
    out = text.build_prompts(df, KEY, "NPS_baseline", system_prompt="Be brief.")
    assert out.filter("user_prompt is null").count() == 0 and out.first().system_prompt == "Be brief."
    assert {r.n for r in text.label_leaks(out).collect()} == {0}
    share = out.agg(F.avg(F.col("counter_intuitive").cast("int"))).first()[0]
    assert 0.05 < share < 0.28
    bare = text.build_prompts(spark.createDataFrame([(1, "Passive")], "id int, NPS_baseline string"), "id").first().user_prompt
    assert "minimal services" in bare and "no recent issues flagged" in bare and "Contract: month-to-month" in bare
    with pytest.raises(ValueError):
        text.build_prompts(df, KEY, "absent")


def test_fingerprint_and_vectors(spark):
    df = spark.createDataFrame([(i, f"text number {i}" if i else "") for i in range(20)], "id int, t string")
    a = text.fingerprint(df, "id", "t", "m").first()
    assert a == text.fingerprint(df.orderBy(F.col("id").desc()).repartition(7), "id", "t", "m").first()
    assert a != text.fingerprint(df, "id", "t", "other").first()
    assert a != text.fingerprint(df.withColumn("t", F.when(F.col("id") == 3, "x").otherwise(F.col("t"))), "id", "t", "m").first()
    calls = []

    def compute(rows):
        calls.append(1)
        return text.embed(rows, "id", "t", 16)

    path = Store(spark, scratch_path(spark, "emb"))
    first = text.cached_embeddings(df, "id", "t", "m", path, compute)
    again = text.cached_embeddings(df, "id", "t", "m", path, compute)
    assert len(calls) == 1 and first.count() == again.count() == 20
    text.cached_embeddings(df.withColumn("t", F.lit("changed")), "id", "t", "m", path, compute)
    assert len(calls) == 2

    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = {r.id: list(r.embedding) for r in text.embed_with(df, "id", "t", encoder, 3).collect()}
    assert got[0] == [0.0, 0.0] and got[7] == [13.0, 1.0]
    checks = {r.check: r.value for r in text.embedding_checks(text.embed_with(df, "id", "t", encoder), "id", "embedding", df.select("id")).collect()}
    assert checks == {"dims": 2.0, "min_dim": 2.0, "max_dim": 2.0, "non_finite": 0.0, "varying_share": 1.0, "ids_without_vector": 0.0}

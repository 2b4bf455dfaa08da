import pytest
from pyspark.sql import functions as F

from ordinalis.operators import sampling, text
from ordinalis.session import scratch_path
from ordinalis.sources import sinks
from ordinalis.sources.store import Store


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"))


def test_second_call_reads(spark, store):
    made = []

    def compute():
        made.append(1)
        return spark.range(5)

    assert store.cached("t", "a", compute).count() == store.cached("t", "a", compute).count() == 5
    assert len(made) == 1 and store.find("t", "b") is None and store.latest("other") is None
    store.cached("t", "b", lambda: spark.range(7))
    assert store.latest("t").count() == 7 and [m["digest"] for m in store.manifests("t")] == ["a", "b"]


def test_crash_before_publishing_is_harmless(spark, store, monkeypatch):
    store.put("t", "old", spark.range(2))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", die)
        with pytest.raises(RuntimeError):
            store.put("t", "a", spark.range(5))
    assert store.find("t", "a") is None and store.latest("t").count() == 2
    assert store.sweep("t") == [], "what is younger than the grace stays"
    gone = store.sweep("t", grace=-60.0)
    assert len(gone) == 1 and gone[0].startswith("a-")
    assert store.cached("t", "a", lambda: spark.range(5)).count() == 5 and store.find("t", "old").count() == 2
    assert store.sweep("t", grace=-60.0) == []


def test_two_writers_of_one_digest(spark, store):
    store.put("t", "a", spark.range(5))
    assert store.put("t", "a", spark.range(5)).count() == 5
    assert len(store.manifests("t")) == 1 and len(store.sweep("t", grace=-60.0)) == 1 and store.find("t", "a").count() == 5


def test_lost_data_are_made_again(spark, store):
    store.put("t", "a", spark.range(5))
    folder = store.manifests("t")[0]["folder"]
    store._fs().delete(store._path("data", "t", folder), True)
    assert store.find("t", "a") is None and store.latest("t") is None
    assert store.cached("t", "a", lambda: spark.range(6)).count() == 6


def test_each_text_is_encoded_once(spark, store):
    seen = []

    def encode(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return rows.select("digest", F.array(F.length("text").cast("float")).alias("embedding"))

    rows = [(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, ""), (5, "b")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("digest", F.lit("clash")).withColumn("embedding", F.lit(0))
    got = sorted((r.id, list(r.embedding)) for r in text.encoded_once(df, "id", "t", "m", store, encode).collect())
    assert got == [(1, [2.0]), (2, [1.0]), (3, [2.0]), (4, [0.0]), (5, [0.0]), (5, [1.0])] and seen == [["", "aa", "b"]]
    text.encoded_once(df, "id", "t", "m", store, encode)
    assert len(seen) == 1
    more = df.withColumn("t", F.when(F.col("id") == 2, "new").otherwise(F.col("t")))
    assert text.encoded_once(more, "id", "t", "m", store, encode).count() == 6 and seen[1:] == [["new"]]
    assert text.encoded_once(df, "id", "t", "m", store, encode).count() == 6 and len(seen) == 2
    assert text.encoded_once(df.limit(0), "id", "t", "other", store, encode).count() == 0
    text.encoded_once(df, "id", "t", "third", store, encode)
    assert seen[-1] == ["", "aa", "b"], "another model shares nothing"


def test_splits_are_drawn_once(spark, store):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("y"))
    drawn = []

    def split(df):
        drawn.append(1)
        return sampling.naive_split(df, "id", "y")

    first = sinks.stored_splits(rows, "id", "y", "s", store, split)
    again = sinks.stored_splits(rows.orderBy(F.col("id").desc()).repartition(5), "id", "y", "s", store, split)
    assert len(drawn) == 1 and first.exceptAll(again).count() == 0 and again.count() == 100
    sinks.stored_splits(rows.filter("id > 0"), "id", "y", "s", store, split)
    sinks.stored_splits(rows.withColumn("y", F.lit(1)), "id", "y", "s", store, split)
    assert len(drawn) == 3

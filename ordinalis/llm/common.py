"""Helpers shared by the training-data operators."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinalis.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators: space and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Remove the shuffles of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it: cuts lineage, survives lost executors, and computes everything once.

    The shuffles of the write are removed when it ends: nothing reads them again, and a collection of the driver's heap, which
    would remove them some time, comes too late for disks that many steps fill.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, "llm"), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as every word-based operator here does."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shingles_of(words: Column, size: int = 5) -> Column:
    """Distinct word shingles; a text of fewer words is one shingle, one without words has none."""
    several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(size - 1)),
                                           lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))
    return (F.when(F.size(words) >= size, several)
            .when(F.size(words) > 0, F.array(F.array_join(words, " ")))
            .otherwise(F.array().cast("array<string>")))


def signed64(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def hash64(data: bytes) -> int:
    return signed64(xxhash.xxh64_intdigest(data))


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component being the smallest node reached.

    Alternates large-star and small-star steps: each is one grouped minimum and one join, both keyed by node, so the
    work stays with the edges and takes about log(n) rounds. Nodes without edges do not appear. Every round is
    written to the shared folder. A hub's rows are split by the adaptive skew join.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v and u is not null and v is not null")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")
        ).select("s.u", "s.v").where("u <> v").distinct()
        e = settle(small)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def bucket_links(keyed: DataFrame, confirm, pivots: int = 64, describe=None, near=None) -> DataFrame:
    """Confirmed links (a, b) between members of common buckets, enough to give the right components.

    `keyed` has (key, c): bucket and member. `confirm(pairs)` returns the pairs (a, b) that hold. Every member is compared
    with its bucket's smallest member first. A bucket stays open while members that have not been compared with each other
    lie in different components; its members are then compared with the next `pivots` smallest ones, and so on until no
    bucket is open. A group of copies thus costs one comparison per member, and no pair that could join two components is
    left out.

    `describe(members)` gives a short mark (c, mark) for each member (c) of a bucket of several, and `near(mark, mark)` is false only
    for pairs that cannot hold: those are left out before anything is moved for them. There are many times more of them than of others.
    """
    # Dealt out once, for the groups and for the join: bands are many times the rows they come from. The condition is one that
    # the join would add on its side, which would make two shuffles of one.
    keyed = keyed.select("key", "c").where("key is not null and c is not null").repartition("key")
    low = keyed.groupBy("key").agg(F.min("c").alias("m"), F.count("*").alias("size")).where("size > 1")
    stars = settle(keyed.join(low, "key").where("c <> m"))
    first = stars.select(F.col("m").alias("a"), F.col("c").alias("b")).distinct()
    if describe is not None:
        marks = describe(stars.select(F.explode(F.array("m", "c")).alias("c")).distinct())
        for side in ("a", "b"):
            first = first.join(marks.select(F.col("c").alias(side), F.col("mark").alias(f"mark_{side}")), side)
        first = first.where(near(F.col("mark_a"), F.col("mark_b"))).select("a", "b")
    tried = settle(first)
    links = settle(confirm(tried))
    left = stars.where("size > 2").select("key", "c")
    while True:
        roots = components(links).select(F.col("node").alias("of"), F.col("component").alias("root"))
        placed = left.join(roots, F.col("c") == F.col("of"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        opened = settle(placed.join(mixed, "key"))
        if opened.isEmpty():
            return links
        place = F.row_number().over(Window.partitionBy("key").orderBy("c"))
        heads = settle(opened.withColumn("place", place).where(F.col("place") <= pivots)
                       .select("key", F.col("c").alias("p"), F.col("root").alias("proot")))
        if describe is None:
            met = opened.join(heads, "key").where("p < c and root <> proot")
        else:
            met = opened.join(marks, "c").join(heads.join(marks.select(F.col("c").alias("p"), F.col("mark").alias("pmark")), "p"), "key").where(
                (F.col("p") < F.col("c")) & (F.col("root") != F.col("proot")) & near(F.col("pmark"), F.col("mark")))
        pairs = met.select(F.col("p").alias("a"), F.col("c").alias("b")).distinct()
        fresh = settle(pairs.join(tried, ["a", "b"], "left_anti"))
        links = settle(links.unionByName(confirm(fresh)))
        tried = settle(tried.unionByName(fresh))
        last = heads.groupBy("key").agg(F.max("p").alias("last"))
        left = opened.join(last, "key").where("c > last").select("key", "c")

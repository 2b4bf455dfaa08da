"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import ascii_lower, settle, shingles_of, words_of
from ordinalis.session import small_side

SHINGLE = 5
#: Smallest hashes kept of an item. A document that holds three quarters of an item misses all of them with a chance of
#: 0.25 ** 16; items of up to this many shingles are searched by all of theirs.
SKETCH = 16


def hashes_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles, in text order; a shorter text gives one, an empty text none."""
    return F.when(F.size(words) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(size - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared) where a document holds at least `percent` of an item's shingles.

    Items are partitioned by size (powers of two of their shingle number). Each keeps its smallest hashes, and a partition's
    largest kept hash bounds what of a document is looked at for it, so long items cost little and short ones miss nothing.
    Documents with too few shingles for a partition are not searched for it. Candidates share a kept hash; the share is
    then taken on the shingle strings of the whole texts.

    The item side is broadcast only when its counted rows are few, otherwise it joins by sort-merge, where a hot shingle is
    split. Texts without words, and items without words, match nothing; items of fewer than five words match only documents
    of the same words. Rows without an id are not reported; repeated rows count once; empty tables give an empty result.
    Other columns are not read.
    """
    items = settle(benchmark.select(F.col(item_id).alias("item_id"), words_of(ascii_lower(F.col(item_text))).alias("w"))
                   .select("item_id", shingles_of(F.col("w"), SHINGLE).alias("shingles"), F.array_distinct(hashes_of(F.col("w"))).alias("h"))
                   .distinct()).where("item_id is not null and size(h) > 0")
    sketches = items.select(F.size("h").alias("q"), F.floor(F.log2(F.size("h"))).cast("int").alias("part"),
                            "item_id", F.explode(F.slice(F.array_sort("h"), 1, SKETCH)).alias("h"))
    parts = sketches.groupBy("part").agg(F.max("h").alias("most"), F.min("q").alias("least")).orderBy("part").collect()  # 64 at most
    if not parts:
        return items.select(F.lit(None).cast(dict(docs.dtypes)[doc_id]).alias("doc_id"), "item_id", F.lit(0).alias("n_item"),
                            F.lit(0).alias("n_shared")).limit(0)

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    # Arrays get a column before lambdas use them, and no filter on what is derived from them: pushed down, it would
    # compute them anew for every element.
    hashed = texts.select("doc_id", words_of(ascii_lower(F.col("text"))).alias("w")).select("doc_id", hashes_of(F.col("w")).alias("h"))
    # A document enters a partition with the hashes below the partition's bound, if it is long enough.
    bound = F.lit(None).cast("bigint")
    for p in parts:
        bound = F.greatest(bound, F.when(F.size("h") * 100 >= p["least"] * percent, F.lit(p["most"])))
    probes = hashed.select("doc_id", F.explode(F.filter("h", lambda x: x <= bound)).alias("h"))
    candidates = settle(probes.join(small_side(sketches.select("h", "item_id")), "h").select("doc_id", "item_id").distinct())

    found = texts.join(small_side(candidates), "doc_id").join(small_side(items.select("item_id", F.col("shingles").alias("want"))), "item_id")
    worded = found.select("doc_id", "item_id", "want", words_of(ascii_lower(F.col("text"))).alias("w"))
    counted = worded.select("doc_id", "item_id", F.size("want").alias("n_item"), F.size(F.array_intersect("want", shingles_of(F.col("w"), SHINGLE))).alias("n_shared"))
    return (counted.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
            .where(100 * F.col("n_shared") >= percent * F.col("n_item")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    gone = contaminated(docs, benchmark, percent, doc_id, text).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(small_side(gone), docs[doc_id] == F.col("__gone"), "left_anti")

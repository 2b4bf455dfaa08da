"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import components, settle
from ordinalis.session import small_side

SHINGLE = 5
#: A signature has SYMBOLS b-bit symbols (b = 16) in chunks of CHUNK. Pairs that differ in at most MAX_DISTANCE symbols are
#: found for certain: by the pigeonhole principle one of the 16 chunks then has at most one error, so the keys of a chunk
#: with each one of its symbols left out must meet. At similarity 0.75, 16 symbols differ in the mean and more than 31 in
#: about one pair of 100,000.
SYMBOLS, CHUNK, MAX_DISTANCE = 64, 4, 31
ERRORS = MAX_DISTANCE // (SYMBOLS // CHUNK)
#: Buckets up to this size list the pairs that are still open; larger ones are compared block by block.
SMALL_BUCKET, BLOCK = 32, 256
#: Shingles are also counted in so many equal parts of the hash range: the sum of the smaller counts bounds an intersection.
PARTS = 512
MEMORY_WORDS = 500_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Turns texts into sets of 64-bit shingle hashes; remembers word hashes up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        size = min(SHINGLE, len(h))
        key = np.full(n, size, np.uint64)
        for j in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
        return np.unique(_mix(key))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of permuted hashes, of each its low 16 bits after mixing."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (_MULTIPLIERS[:, None] * shingles[None, i:i + 4096]).min(1))
    return (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of all chunks of signatures (rows of 64-bit chunks) with one symbol left out: chunk number, place of the gap
    and the other three symbols, exactly."""
    v = sig.view(np.uint64)
    keys = []
    for gap in range(CHUNK):
        low = v & np.uint64((1 << 16 * gap) - 1)
        high = v >> np.uint64(16 * (gap + 1)) << np.uint64(16 * gap) if gap < CHUNK - 1 else np.uint64(0)
        place = (np.arange(v.shape[-1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gap)) << np.uint64(48)
        keys.append(place | low | high)
    return np.stack(keys, -1).reshape(*v.shape[:-1], -1).view(np.int64)


def keys_of(sig: Column) -> Column:
    """The same keys as an array column."""
    def of(v: Column, i: Column) -> Column:
        keys = []
        for gap in range(CHUNK):
            low = v.bitwiseAND(F.lit((1 << 16 * gap) - 1))
            high = F.shiftleft(F.shiftrightunsigned(v, 16 * (gap + 1)), 16 * gap) if gap < CHUNK - 1 else F.lit(0)
            keys.append(F.shiftleft((i * CHUNK + gap).cast("bigint"), 48).bitwiseOR(low).bitwiseOR(high.cast("bigint")))
        return F.array(*keys)
    return F.flatten(F.transform(sig, of))


def part_counts(shingles: np.ndarray) -> bytes:
    """Shingles in each part of the hash range, as bytes; a count above 254 is written as 255 and means any."""
    return np.minimum(np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        n, digest, tag, sigs, parts = [], [], [], [], []
        for text in batch.column("text"):
            s = shingler(text.as_py())
            d = hashlib.md5(s.tobytes()).digest() if len(s) else None
            sig = signature(s) if len(s) else None
            n.append(len(s))
            digest.append(d)
            tag.append(int.from_bytes(d[:4], "little", signed=True) if d else None)
            sigs.append(sig.view(np.int64) if d else None)
            parts.append(part_counts(s) if d else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(tag, pa.int32()),
             pa.array(sigs, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names=["id", "n", "digest", "tag", "sig", "parts"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sets = [shingler(t.as_py()) for t in batch.column("text")]
        tags = [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:4], "little", signed=True) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(tags, pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
            names=["id", "tag", "shingles"])


def _close_pairs(percent: int):
    def pairs(block: pd.DataFrame) -> pd.DataFrame:
        """Open pairs of two blocks of a bucket, or within one: near by signature, and alike enough by their part counts.

        A pair is left to the first bucket that both members are in, so it comes up once.
        """
        block = block.reset_index(drop=True)
        chunks = np.stack(block["sig"].to_numpy()).astype(np.int64)
        sig, keys = chunks.view(np.uint16), chunk_keys(chunks)
        parts = np.frombuffer(b"".join(block["parts"]), np.uint8).reshape(len(block), PARTS)
        home, root, n = block["home"].to_numpy(), block["root"].to_numpy(), block["n"].to_numpy()
        low, high, own = block["lo"].iloc[0], block["hi"].iloc[0], int(np.flatnonzero(keys[0] == block["key"].iloc[0])[0])
        left, right = np.flatnonzero(home == low), np.flatnonzero(home == high)
        a, b = [], []
        for i in left:
            others = right[right > i] if low == high else right
            others = others[root[others] != root[i]]
            others = others[(sig[others] != sig[i]).sum(1) <= MAX_DISTANCE]
            others = others[(keys[others] == keys[i]).argmax(1) == own]
            most = np.minimum(parts[others], parts[i]).sum(1, dtype=np.int64)
            any_ = ((parts[others] == 255) & (parts[i] == 255)).any(1)
            others = others[any_ | ((100 + percent) * most >= percent * (n[others] + n[i]))]
            a += [i] * len(others)
            b += others.tolist()
        ids, tags = block["id"], block["tag"]
        return pd.DataFrame({"aid": ids[a].to_numpy(), "atag": tags[a].to_numpy(), "bid": ids[b].to_numpy(), "btag": tags[b].to_numpy()})

    return pairs


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents with equal shingle sets are one class, represented by the smallest id. Classes meet in the buckets of the
    multi-index. A first round compares every member of a bucket with its smallest; confirmed pairs are united. Only
    buckets that still hold several components go on: the open pairs of small ones are listed, large ones are compared in
    blocks by their signatures and by a bound on their intersections, and only pairs that pass both and lie in different
    components are confirmed. So a group of copies costs one comparison per member, documents that share one passage are
    told apart without being paired, and no link between components is lost.

    Null, empty and blank texts have no shingles and link with nothing. Rows that share an id are one node of the graph.
    Rows with a null id keep a null component and stay. An empty table gives an empty one; other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["id"]
    signed = settle(base.mapInArrow(_sign, f"id {kind}, n bigint, digest binary, tag int, sig array<bigint>, parts binary"))
    usable = signed.where("n > 0 and id is not null")
    classes = settle(usable.groupBy("digest").agg(F.min_by(F.struct("id", "tag", "n", "sig", "parts"), "id").alias("r")))
    reps = classes.select(F.struct("r.id", "r.tag").alias("c"), "r.n", "r.sig", "r.parts")
    same = usable.join(classes.select("digest", F.col("r.id").alias("rep")), "digest").where("id <> rep").select(
        F.col("rep").alias("a"), F.col("id").alias("b"))

    keyed = reps.select("c", "n", F.explode(keys_of(F.col("sig"))).alias("key"))
    low = keyed.groupBy("key").agg(F.min(F.struct("c", "n")).alias("m"), F.count("*").alias("size")).where("size > 1")
    stars = keyed.join(low, "key").where("c <> m.c").where(
        F.least("n", "m.n") * 100 >= F.greatest("n", "m.n") * percent)
    tried = settle(_ordered(stars.select(F.col("m.c").alias("a"), F.col("c").alias("b"))))
    links = settle(confirm(base, tried, percent))

    # Buckets of at least three members in which not all belong together yet.
    roots = components(links.select("a", "b")).select(F.col("node").alias("of"), F.col("component").alias("root"))
    placed = keyed.join(low.where("size > 2").select("key", "size"), "key").join(roots, F.col("c") == F.col("of"), "left").select(
        "key", "size", "c", "n", F.coalesce("root", "c").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_ = settle(placed.join(mixed, "key"))
    small = (open_.where(F.col("size") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("c", "n", "root")).alias("m"))
             .select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(
                 F.filter("m", lambda y: (x["c"] < y["c"]) & (x["root"] != y["root"])
                          & (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent)),
                 lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))).alias("p"))
             .select("p.a", "p.b"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    large = open_.where(F.col("size") > SMALL_BUCKET).join(reps.select(F.col("c").alias("of"), "sig", "parts"), F.col("c") == F.col("of")).select(
        "key", F.col("c.id").alias("id"), F.col("c.tag").alias("tag"), F.xxhash64("root").alias("root"), "n", "sig", "parts", blocks.alias("nb"),
        F.pmod(F.xxhash64("c"), blocks).cast("int").alias("home"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn(
        "lo", F.least("home", "other")).withColumn("hi", F.greatest("home", "other"))
    near = dealt.groupBy("key", "lo", "hi").applyInPandas(_close_pairs(percent), f"aid {kind}, atag int, bid {kind}, btag int").select(
        F.struct(F.col("aid").alias("id"), F.col("atag").alias("tag")).alias("a"),
        F.struct(F.col("bid").alias("id"), F.col("btag").alias("tag")).alias("b"))
    fresh = settle(_ordered(small.unionByName(near)).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(settle(confirm(base, fresh, percent)))

    edges = same.unionByName(links.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    found = components(edges)
    return (signed.join(found, F.col("id") == F.col("node"), "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def confirm(base: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. Sets are made again from the texts of the documents in question."""
    ids = pairs.select(F.col("a.id").alias("want")).unionByName(pairs.select(F.col("b.id").alias("want"))).distinct()
    wanted = base.join(small_side(ids), F.col("id") == F.col("want"), "left_semi")
    kind = dict(base.dtypes)["id"]
    sets = settle(wanted.mapInArrow(_sets, f"id {kind}, tag int, shingles array<bigint>").where("tag is not null").dropDuplicates(["id", "tag"])
                  .select(F.struct("id", "tag").alias("c"), "shingles"))
    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b")
    # 100 * shared >= percent * (a + b - shared), with the intersection taken once
    return both.where((100 + percent) * F.size(F.array_intersect("sa", "sb")) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def drop_near_duplicates(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group: that with the smallest id."""
    gone = near_duplicates(docs, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(small_side(gone), docs[doc_id] == F.col("__gone"), "left_anti")

"""Stratified bootstrap intervals, resampling within each true class.

`multinomial` mode never touches rows again after one aggregation: given its class, drawing n_c rows with replacement
only changes the cell counts, which are Multinomial(n_c, cell shares).  A thousand replicates cost a thousand rows of
nine numbers per group, whatever the table size.

`index` mode draws every row index with a keyed hash, so it is exact for any metric and reproducible in SQL; it costs
(replicates x rows) and is meant for checks and mid-sized groups. Its draws are made and sent in bulk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ordinalis.functions import confusion as cf
from ordinalis.functions.scalar import ratio
from ordinalis.operators.evaluation import LIFT_SHARES, METRIC_NAMES, confusion_counts, evaluate, to_long, top_share_size
from ordinalis.operators.ranking import join_on, with_position
from ordinalis.session import settle, small_side

BLOCK = 50          # replicates drawn from one copy of a histogram
LIFT_BINS = 2047    # score bins of the multinomial lift, of about equally many rows in every group
SKETCH = 20_000     # accuracy of the sketch that gives their edges: rank error rows / SKETCH, far below a bin
_CHUNK = 1 << 12    # rows of a class that are brought together with their draws; at most 2^16
_BLOCK, _STEP = 1 << 16, 50  # positions and replicates drawn at once
_TASKS = 4096       # most tasks that draw


def _spread_replicates(df: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """One row per (group, replicate) with a seed that depends on the group and replicate only."""
    out = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    out = out.withColumn("_seed", F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in by], F.col("b")))
    # an explicit number of partitions: the rows are few but costly, and AQE would merge them into one task
    cores = df.sparkSession.sparkContext.defaultParallelism
    return out.repartition(cores, *[F.col(k) for k in by], F.col("b"))


def _generator():
    """Seed -> numpy generator; nested, so that tasks get it by value and need not import this package."""
    def make(seed: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=int(seed) & (2**63 - 1)))
    return make


def multinomial_counts(cm: DataFrame, by: list[str], replicates: int = 1000, seed: int = 42, batch: int | None = None) -> DataFrame:
    """Confusion counts of bootstrap replicates, (by, b, n00 ... n22).

    With `batch` each replicate has about that many rows: class sizes are scaled and rounded, cells are drawn from their
    exact shares, so that cells rarer than one in a batch still appear now and then.
    """
    rows = _spread_replicates(cm.select(*by, *cf.CELLS), by, replicates, seed)
    cells, size, rng = list(cf.CELLS), cf.K, _generator()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf[cells].to_numpy(dtype=np.int64).reshape(-1, size, size)
            sizes = counts.sum(axis=2)
            shares = counts / np.maximum(sizes, 1)[:, :, None]
            shares[:, :, -1] = 1.0 - shares[:, :, :-1].sum(axis=2)
            shares = np.clip(shares, 0.0, 1.0)
            if batch is not None:
                sizes = np.rint(sizes * (batch / np.maximum(sizes.sum(axis=1, keepdims=True), 1))).astype(np.int64)
            for i, s in enumerate(pdf["_seed"].to_numpy()):
                counts[i] = rng(s).multinomial(sizes[i], shares[i])
            pdf[cells] = counts.reshape(-1, size * size)
            yield pdf.drop(columns="_seed")

    schema = rows.drop("_seed").schema
    return rows.mapInPandas(draw, schema)


def score_edges(df: DataFrame, by: list[str], bins: int = LIFT_BINS) -> DataFrame:
    """(by, _edges): descending lower edges of score bins that hold about equally many rows of the group.

    They are scores that occur, taken from a mergeable quantile sketch, so a group of scores however close together, rare
    or tied has its own bins; a group of few distinct scores has a bin for each.
    """
    grid = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    sketch = F.percentile_approx(F.col("p0").cast("double"), grid, F.lit(SKETCH))
    return df.groupBy(*by).agg(F.sort_array(F.array_distinct(sketch), asc=False).alias("_edges"))


def score_slot(edges: Column, score: Column, bins: int = LIFT_BINS) -> Column:
    """Number of edges above the score, by halving; rows without a score come after all bins."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bins.bit_length()))])
    above = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) > score, at + step).otherwise(at))
    return F.when(score.isNull(), F.lit(bins + 1)).otherwise(above)


def score_cells(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, slot, y, yp, n): one pass over the rows for the edges and one for the counts, all that the multinomial bootstrap needs.

    At most (LIFT_BINS + 2) * 9 rows per group; slot 0 holds the highest scores.
    """
    keys = by or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, "p0", "y", "yp")
    binned = join_on(rows, small_side(score_edges(rows, keys)), keys)
    slot = score_slot(F.col("_edges"), F.col("p0").cast("double"))
    return binned.groupBy(*keys, slot.alias("slot"), "y", "yp").agg(F.count(F.lit(1)).alias("n")).select(*by, "slot", "y", "yp", "n")


def cells_to_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts from score cells."""
    n = F.col("n")
    return cells.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when((F.col("y") == i) & (F.col("yp") == j), n)), F.lit(0)).alias(f"n{i}{j}")
        for i in range(cf.K) for j in range(cf.K)], F.sum("n").alias("n_rows"))


def cells_to_histogram(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group three arrays of class counts over the slots, highest scores first."""
    per_slot = cells.groupBy(*by, "slot").agg(*[
        F.coalesce(F.sum(F.when(F.col("y") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(cf.K)])
    packed = F.sort_array(F.collect_list(F.struct("slot", *[f"c{k}" for k in range(cf.K)])))  # at most LIFT_BINS + 2 items
    out = per_slot.groupBy(*by).agg(packed.alias("_h"))
    return out.select(*by, *[F.col(f"_h.c{k}").alias(f"h{k}") for k in range(cf.K)])


def multinomial_lift(hist: DataFrame, by: list[str], replicates: int = 1000, seed: int = 42,
                     shares: dict[str, float] | None = None) -> DataFrame:
    """Lift of bootstrap replicates from score histograms; the bin that holds the cut counts pro rata.

    So do rows that tie at the cut, where the point lift takes the lower ids: with large ties the interval need not hold the point.
    """
    shares = shares or LIFT_SHARES
    blocks = -(-replicates // BLOCK)
    rows = _spread_replicates(hist, by, blocks, seed)   # one row per (group, block of replicates)
    names, levels, step, make = list(shares), list(shares.values()), BLOCK, _generator()
    histograms = [f"h{k}" for k in range(cf.K)]

    def block(seed_value: int, arrays: list[np.ndarray], size: int) -> np.ndarray:
        rng = make(seed_value)
        drawn = [rng.multinomial(a.sum(), a / max(a.sum(), 1), size=size) if a.sum() else np.zeros((size, len(a)), int)
                 for a in arrays]
        hits, everyone = drawn[0], drawn[0] + drawn[1] + drawn[2]
        n, positives = int(everyone[0].sum()), int(hits[0].sum())
        if not n or not positives:
            return np.zeros((size, len(names)))
        upto, upto_hits = everyone.cumsum(axis=1), hits.cumsum(axis=1)
        at = np.arange(size)
        out = []
        for share in levels:
            k = max(1, int(n * share))
            cut = (upto < k).sum(axis=1)
            before = upto[at, cut] - everyone[at, cut]
            top = upto_hits[at, cut] - hits[at, cut] + hits[at, cut] * (k - before) / everyone[at, cut]
            out.append((top / k) / (positives / n))
        return np.stack(out, axis=1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first = (row["b"] - 1) * step + 1
                size = min(step, replicates - first + 1)
                arrays = [np.asarray(row[h], dtype=np.int64) for h in histograms]
                out = pd.DataFrame(block(row["_seed"], arrays, size), columns=names)
                for name in by:
                    out[name] = row[name]
                out["b"] = np.arange(first, first + size, dtype=np.int32)
                yield out[[*by, "b", *names]]

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, "b").schema]
                       + [f"{n} double" for n in names])
    return rows.mapInPandas(draw, fields)


def _uniforms():
    """(seed, b, y, first, n) -> `hashing.uniform(seed, "boot", b, y, j)` of the n positions j from `first`; nested like `_generator`.

    The digests are made for many positions at once: of one replicate and class only the digits of j differ between them.
    """
    constants = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
    turns = [x for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in r * 4]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    lanes, tails = 1 << 15, {}

    def first_words(prefix: bytes, tail: list, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """The first two words of the digests of prefix + digits; `tail` has the words of the digits, None where there are none."""
        size = next(len(x) for x in tail if x is not None)
        padded = np.frombuffer(prefix + bytes(64 - len(prefix)), "<u4").tolist()
        m = [int(p) if t is None else t | np.uint32(p) for p, t in zip(padded, tail, strict=True)]
        m[14] = 8 * (len(prefix) + digits)
        a, b, c, d = (np.full(size, x, np.uint32) for x in start)
        f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
        for i in range(64):
            if i < 16:
                k = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                k = 7 * i % 16
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            if isinstance(m[k], int):
                np.add(f, np.uint32((constants[i] + m[k]) & 0xFFFFFFFF), out=f)
            else:
                np.add(f, m[k], out=f)
                np.add(f, np.uint32(constants[i]), out=f)
            np.left_shift(f, np.uint32(turns[i]), out=g)
            np.right_shift(f, np.uint32(32 - turns[i]), out=f)
            np.bitwise_or(f, g, out=f)
            np.add(f, b, out=a)  # the old a is not needed any more
            a, b, c, d = d, a, b, c
        return a + np.uint32(start[0]), b + np.uint32(start[1])

    def tail_of(length: int, low: int, high: int) -> tuple[list, int]:
        """Words of the digits of low ... high - 1, all of one length, behind a prefix of `length` bytes, and how many digits they are."""
        key = (length, low, high)
        if key not in tails:
            if len(tails) > 64:
                tails.clear()
            j, digits = np.arange(low, high), len(str(low))
            text = np.zeros((high - low, 64), np.uint8)
            for i in range(digits):
                text[:, length + i] = 48 + j // 10**(digits - 1 - i) % 10
            text[:, length + digits] = 128
            words = np.ascontiguousarray(text.view("<u4").T)
            used = range(length // 4, (length + digits) // 4 + 1)
            tails[key] = [words[i] if i in used else None for i in range(16)], digits
        return tails[key]

    def uniforms(seed: int, b: int, y: str, first: int, n: int) -> np.ndarray:
        prefix, out, low = f"{seed}:boot:{b}:{y}:".encode(), [], first
        while low < first + n:
            high = min(first + n, low + lanes, 10 ** len(str(low)))
            if len(prefix) + len(str(low)) > 55:  # more than one block
                out.append([int(hashlib.md5(prefix + str(j).encode()).hexdigest()[:12], 16) for j in range(low, high)])
            else:
                one, two = first_words(prefix, *tail_of(len(prefix), low, high))
                out.append(one.byteswap().astype(np.uint64) << np.uint64(16) | two.byteswap() >> np.uint32(16))
            low = high
        return np.concatenate(out).astype(np.float64) / 2.0**48 if out else np.zeros(0)
    return uniforms


def _picks(replicates: int, seed: int):
    """Draws of `_STEP` replicates and `_BLOCK` positions of a class, sent to the chunks of rows they fall on.

    The draws of a chunk are one row: how many each replicate makes, and the places in the chunk, replicate by replicate. Groups share
    the uniforms of a class, as these do not depend on the group.
    """
    uniforms, step, length, chunk = _uniforms(), _STEP, _BLOCK, _CHUNK

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (x for batch in batches for x in batch.to_pylist()):
            many = min(step, replicates - unit["b0"] + 1)
            first = unit["block"] * length
            most = min(length, max(x["_nc"] for x in unit["of"]) - first)
            u = np.stack([uniforms(seed, unit["b0"] + i, unit["y"], first + 1, most) for i in range(many)])
            for x in unit["of"]:
                mine = u[:, :min(length, x["_nc"] - first)]
                pick = np.floor(mine * x["_nc"]).astype(np.int64).ravel()
                to = pick // chunk
                to = to.astype(np.uint16) if x["_nc"] <= chunk << 16 else to
                order = np.argsort(to, kind="stable")
                to, places = to[order].astype(np.int64), (pick % chunk).astype(np.uint16)[order]
                ends = np.flatnonzero(np.append(np.diff(to), 1)) + 1
                starts, replicate = np.append(0, ends[:-1]), order // mine.shape[1]
                each = [np.bincount(replicate[i:j], minlength=many).astype(np.uint32).tobytes() for i, j in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), x["_g"])), pa.array(to[starts]), pa.array(np.full(len(ends), unit["b0"], np.int32)),
                     pa.array(each, pa.binary()), pa.array([places[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())],
                    names=["_g", "_chunk", "b0", "each", "places"])
    return picks


def _drawn_rows(replicates: int):
    """The rows of a chunk that are drawn, each with the sorted replicates that drew it."""
    chunk, base = _CHUNK, replicates + 1

    def drawn(rows: pa.Table, draws: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.int64)]
        for b0, each, places in zip(*(draws.column(c).to_pylist() for c in ("b0", "each", "places")), strict=True):
            each = np.frombuffer(each, np.uint32)
            keys.append(np.frombuffer(places, np.uint16).astype(np.int64) * base + np.repeat(np.arange(b0, b0 + len(each)), each))
        keys = np.concatenate(keys)
        keys = np.sort(keys.astype(np.uint32) if chunk * base < 1 << 32 else keys)
        place, b = keys // base, (keys % base).astype(np.int32)
        used, size = np.unique(place, return_counts=True)
        at = np.argsort(rows.column("_j").to_numpy())  # a chunk has all positions of its range
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(b))
        return rows.drop_columns(["_chunk", "_g", "_j"]).take(pa.array(at[used])).append_column("_bs", lists)
    return drawn


def index_draws(df: DataFrame, by: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """Rows with `_bs`, the replicates that drew them in order, one entry a draw; n_c draws within each class.

    Draws travel in bulk, two bytes each, to the chunk of rows that they fall on: a row of their own for each would be most of the work.
    """
    keys = [*by, "y"]
    placed = with_position(df.filter(F.col("y").isNotNull()), keys, [F.col("id").asc()], "_j")
    sizes = small_side(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc")).withColumn("_g", F.monotonically_increasing_id()))
    rows = join_on(placed, sizes.select(*keys, "_g"), keys).withColumn("_chunk", F.floor((F.col("_j") - 1) / _CHUNK).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_nc") - 1) / _BLOCK).cast("long"))
    units = sizes.select("_g", "_nc", F.col("y").cast("string").alias("y"), F.explode(blocks).alias("block")).groupBy("y", "block").agg(
        F.collect_list(F.struct("_g", "_nc")).alias("of"))
    units = settle(units.withColumn("b0", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(_STEP)))))
    # a number of partitions that AQE leaves alone: the rows are few but costly
    units = units.repartition(min(max(units.count(), 1), _TASKS), "y", "block", "b0")
    draws = units.mapInArrow(_picks(replicates, seed), "_g bigint, _chunk bigint, b0 int, each binary, places binary")
    own = rows.drop("_chunk", "_g", "_j")
    schema = StructType([*own.schema.fields, StructField("_bs", ArrayType(IntegerType()))])
    return rows.groupBy("_g", "_chunk").cogroup(draws.groupBy("_g", "_chunk")).applyInArrow(_drawn_rows(replicates), schema)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace `_bs` by its different replicates and how often each comes."""
    for batch in batches:
        lists = batch.column("_bs")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        b, row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        keys = np.sort(row << 32 | b)
        first = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, np.int64)
        w, keys = np.diff(np.append(first, len(keys))), keys[first]
        ends = np.append(0, np.cumsum(np.bincount(keys >> 32, minlength=len(sizes))))
        pairs = pa.StructArray.from_arrays([pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(w, pa.int64())], names=["b", "w"])
        own = [i for i, name in enumerate(batch.schema.names) if name != "_bs"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                                         names=[*[batch.schema.names[i] for i in own], "_bw"])


def draw_weights(drawn: DataFrame) -> DataFrame:
    """Rows with the number of times `w` they are drawn in replicate `b`."""
    own = [f for f in drawn.schema.fields if f.name != "_bs"]
    pair = StructType([StructField("b", IntegerType()), StructField("w", LongType())])
    weighed = drawn.mapInArrow(_run_lengths, StructType([*own, StructField("_bw", ArrayType(pair))]))
    return weighed.select(*[F.col(f"`{f.name}`") for f in own], F.inline("_bw"))


def index_weights(df: DataFrame, by: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """Rows with the number of times `w` they are drawn in replicate `b`; n_c draws within each class."""
    return draw_weights(index_draws(df, by, replicates, seed))


def weighted_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    cells = [F.coalesce(F.sum(F.when((F.col("y") == i) & (F.col("yp") == j), F.col("w"))), F.lit(0)).alias(f"n{i}{j}")
             for i in range(cf.K) for j in range(cf.K)]
    return rows.groupBy(*by, "b").agg(*cells)


def with_slots(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add `_slot`, the score bin of a row in the order of falling scores; rows without a score come first, as in the order of -p0."""
    keys = by or ["_all"]
    keyed, score = rows if by else rows.withColumn("_all", F.lit(0)), F.col("p0").cast("double")
    edges = small_side(score_edges(keyed.filter(score.isNotNull() & ~F.isnan(score)), keys))
    slot = F.when(score.isNull(), -1).when(F.isnan(score), LIFT_BINS + 2).otherwise(score_slot(F.col("_edges"), score))
    return join_on(keyed, edges, keys, "left").select(*[F.col(f"`{x}`") for x in rows.columns], slot.alias("_slot"))


def weighted_lift(rows: DataFrame, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """Lift per replicate with row weights: the row that straddles the cut counts for the copies that fit.

    Weights are summed per score bin; only the rows of the bin that holds a cut are put in order.
    """
    shares = shares or LIFT_SHARES
    keys = [*by, "b"]
    rows = rows if "_slot" in rows.columns else with_slots(rows, by)
    hits = F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0))
    cells = settle(rows.groupBy(*keys, "_slot").agg(F.sum("w").alias("_w"), hits.alias("_h")))
    upto = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)  # at most LIFT_BINS + 4 rows a replicate
    run = cells.withColumns({"_cw": F.sum("_w").over(upto), "_ch": F.sum("_h").over(upto), "n": F.sum("_w").over(W.partitionBy(*keys)),
                             "_pos": F.sum("_h").over(W.partitionBy(*keys))})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_which"), top_share_size(share).alias("_k")) for name, share in shares.items()]))
    cuts = run.withColumn("_cut", wanted).select(*keys, "_slot", "n", "_pos", "_cut.*", (F.col("_cw") - F.col("_w")).alias("_before"),
                                                 (F.col("_ch") - F.col("_h")).alias("_got"), "_cw")
    cuts = small_side(cuts.filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_cw"))).drop("_cw"))
    found = join_on(rows.select(*keys, "_slot", "id", "y", "w", (-F.col("p0")).alias("_s")),
                    cuts.select(*keys, "_slot", "_which", (F.col("_k") - F.col("_before")).alias("_room")), [*keys, "_slot"])
    placed = with_position(found, [*keys, "_which"], [F.col("_s").asc(), F.col("id").asc()], "_p", {"_cum": F.col("w")})
    room = F.least(F.col("w"), F.greatest(F.lit(0), F.col("_room") - (F.col("_cum") - F.col("w"))))
    inside = placed.groupBy(*keys, "_which").agg(F.sum(F.when(F.col("y") == 0, room).otherwise(0)).alias("_in"))
    lift = F.coalesce(F.try_divide(ratio(F.col("_got") + F.col("_in"), F.col("_k")), ratio(F.col("_pos"), F.col("n"))), F.lit(0.0))
    each = join_on(cuts, inside, [*keys, "_which"]).withColumn("_lift", lift)
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == name, F.col("_lift"))).alias(name) for name in shares])


def intervals(values: DataFrame, by: list[str], ci: float = 0.95) -> DataFrame:
    """Percentile interval over replicates; a group holds as many rows as there are replicates."""
    alpha = (1.0 - ci) / 2
    q = F.percentile("value", F.array(F.lit(alpha), F.lit(1.0 - alpha)))
    return (values.groupBy(*by, "metric").agg(q.alias("_q"))
            .select(*by, "metric", F.try_element_at("_q", F.lit(1)).alias("ci_lo"),
                    F.try_element_at("_q", F.lit(2)).alias("ci_hi")))


def replicate_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    wide = counts.select(*by, "b", *[expr().alias(name) for name, expr in cf.METRICS.items()])
    return to_long(wide, [*by, "b"])


def bootstrap_all(df: DataFrame, by: list[str], replicates: int = 1000, ci: float = 0.95, seed: int = 42,
                  mode: str = "multinomial", probabilities: bool = True) -> DataFrame:
    """(by, metric, value, ci_lo, ci_hi, n_resamples, ci) for all metrics; every metric sees the same replicates."""
    counts = None
    if mode == "index":
        slim = df.select(*by, "id", "y", "yp", *(["p0"] if probabilities else []))
        drawn = draw_weights(settle(index_draws(with_slots(slim, by) if probabilities else slim, by, replicates, seed)))  # read by both metric families
        reps = replicate_metrics(weighted_counts(drawn, by), by)
        lifts = weighted_lift(drawn, by) if probabilities else None
    elif mode == "multinomial":
        if probabilities:
            df = settle(df.select(*by, "id", "y", "yp", "p0"))  # read for edges, cells and the point lift
            cells = settle(score_cells(df, by))
            counts = settle(cells_to_counts(cells, by))
            lifts = multinomial_lift(cells_to_histogram(cells, by), by, replicates, seed)
        else:
            counts, lifts = settle(confusion_counts(df, by)), None
        reps = replicate_metrics(multinomial_counts(counts, by, replicates, seed), by)
    else:
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    if lifts is not None:
        reps = reps.unionByName(to_long(lifts, [*by, "b"]))
    point = to_long(evaluate(df, by, probabilities, counts), by)
    point = point.filter(F.col("metric").isin(*METRIC_NAMES.values()))
    return (join_on(point, intervals(reps, by, ci), [*by, "metric"], "left")
            .withColumn("n_resamples", F.lit(replicates)).withColumn("ci", F.lit(ci)))


def group_bootstrap(counts: DataFrame, replicate_counts: DataFrame, by: list[str], classes=(0, 2), ci: float = 0.95,
                    min_class: int = 5) -> DataFrame:
    """Recall and selection rate per (by, class) with intervals; NULL intervals for small groups."""
    def arms(with_n: bool):
        return F.explode(F.array(*[F.struct(
            F.lit(k).alias("class_idx"),
            *([cf.total().cast("long").alias("n_total"), cf.true_total(k).cast("long").alias("n_class")] if with_n else []),
            cf.recall(k, None).alias("recall"), cf.selection_rate(k).alias("selection_rate")) for k in classes])).alias("_k")

    point = counts.select(*by, arms(True)).select(*by, "_k.*")
    reps = replicate_counts.select(*by, "b", arms(False)).select(*by, "b", "_k.*")
    alpha = (1.0 - ci) / 2
    probs = F.array(F.lit(alpha), F.lit(1.0 - alpha))
    bands = reps.groupBy(*by, "class_idx").agg(F.percentile("recall", probs).alias("_r"),
                                               F.percentile("selection_rate", probs).alias("_s"))
    enough = (F.col("n_class") >= min_class) & (F.col("n_total") >= 3 * min_class)
    out = join_on(point, bands, [*by, "class_idx"], "left")
    for name, src, i in (("recall_ci_lo", "_r", 1), ("recall_ci_hi", "_r", 2),
                         ("selection_rate_ci_lo", "_s", 1), ("selection_rate_ci_hi", "_s", 2)):
        out = out.withColumn(name, F.when(enough, F.try_element_at(src, F.lit(i))))
    return out.drop("_r", "_s")

"""Hard negatives: for each (anchor, positive), the best rows of other labels inside a window below the positive's score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinalis.llm.common import settle
from ordinalis.operators.ranking import with_position
from ordinalis.session import scratch_path

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Anchors and vector components in a block, and scores that a task holds at once.
BLOCK_ANCHORS = 1 << 13
BLOCK_VALUES = 1 << 20
SCORE_VALUES = 1 << 22
#: Candidates that a task gathers before it prunes them.
GATHER = 1 << 19
#: Largest number that doubles hold with all their neighbours.
EXACT = 1 << 53


def quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, offsets, values) of the rows that take part, vectors one after another as floor(scale * x)."""
    vec = batch.column("vec").cast(pa.list_(pa.float64()))
    flat, ends = vec.flatten(), vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.cumsum(np.r_[0, ~np.isfinite(x)])
    stop = np.cumsum(ends)
    start = stop - ends
    ok = (bad[stop] == bad[start]) & ~vec.is_null().to_numpy(zero_copy_only=False)
    for name in ("id", "label"):
        ok &= ~batch.column(name).is_null().to_numpy(zero_copy_only=False)
    x = np.floor(scale * np.where(np.isfinite(x), x, 0.0))
    keep = np.repeat(ok, ends)
    ids, labels = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[ok] for n in ("id", "label"))
    return ids, labels, np.r_[0, np.cumsum(ends[ok])], x[keep]


def matrix(offsets: np.ndarray, values: np.ndarray, rows: slice, width: int) -> np.ndarray:
    """Rows of packed vectors as a matrix; what lies beyond `width` is cut, shorter ones end in zeros."""
    start, stop = offsets[rows.start:rows.stop], offsets[rows.start + 1:rows.stop + 1]
    out = np.zeros((len(start), width))
    size = np.minimum(stop - start, width)
    if (size == width).all() and (stop - start == width).all():
        return values[start[0]:stop[-1]].reshape(len(start), width) if len(start) else out
    for i, (s, n) in enumerate(zip(start, size, strict=True)):
        out[i, :n] = values[s:s + n]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products: as doubles while every partial sum is exact, as Python integers beyond."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(rows.shape[1], 1)
    if top < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in rows], object) @ np.array([[int(v) for v in a] for a in anchors], object).T
    if max(map(abs, exact.ravel()), default=0) >= 1 << 63:
        raise OverflowError("an inner product does not fit into a long")
    return exact.astype(np.int64)


class TopSlots:
    """The first k rows of every (anchor, slot), highest score first, then smallest id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.cells = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.floor = np.full(anchors * slots, np.iinfo(np.int64).min)
        self.last = np.full(anchors * slots, np.iinfo(np.int64).max)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, cells: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor[cells]
        good = (score > floor) | ((score == floor) & (ids < self.last[cells]))
        if good.any():
            self.parts.append((cells[good], score[good], ids[good]))
            self.waiting += int(good.sum())
        if self.waiting > GATHER:
            self.prune()

    def prune(self) -> None:
        if self.parts:
            cells, score, ids = (np.concatenate(x) for x in zip((self.cells, self.score, self.ids), *self.parts, strict=True))
            order = np.lexsort((ids, -score, cells))
            cells, score, ids = cells[order], score[order], ids[order]
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            place = np.arange(len(cells)) - np.repeat(first, np.diff(np.r_[first, len(cells)]))
            keep = place < self.k
            full = place == self.k - 1
            self.floor[cells[full]], self.last[cells[full]] = score[full], ids[full]
            self.cells, self.score, self.ids = cells[keep], score[keep], ids[keep]
            self.parts, self.waiting = [], 0


class Block:
    """A bounded block of anchors: ids, labels, vectors, and descending upper limits with the lowest score that matters."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.uppers: np.ndarray | None = None
        self.lowest: np.ndarray | None = None

    def limits(self, windows: list[tuple[int, int, int]]) -> Block:
        """`windows`: (anchor, lower, upper). Equal upper limits share a slot; unused slots lie below every score."""
        least = np.iinfo(np.int64).min
        by_anchor: dict[int, set[int]] = {}
        self.lowest = np.full(len(self.ids), np.iinfo(np.int64).max)
        for j, lower, upper in windows:
            by_anchor.setdefault(j, set()).add(upper)
            self.lowest[j] = min(self.lowest[j], lower)
        slots = max((len(u) for u in by_anchor.values()), default=1)
        self.uppers = np.full((len(self.ids), slots), least)
        for j, found in by_anchor.items():
            self.uppers[j, :len(found)] = sorted(found, reverse=True)
        return self


def combine(batches: Iterator[pa.RecordBatch], block: Block, scale: float, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """A task's first k rows of every (anchor, slot): rows of the anchor's label, or of the others inside its slots."""
    width = block.vectors.shape[1]
    slots = 1 if same else block.uppers.shape[1]
    top = TopSlots(len(block.ids), slots, k)
    of_label = {v: np.flatnonzero(block.labels == v) for v in np.unique(block.labels)}
    step = max(1, SCORE_VALUES // max(width, len(block.ids), 1))
    for batch in batches:
        ids, labels, offsets, values = quantised(batch, scale)
        for at in range(0, len(ids), step):
            rows = slice(at, min(at + step, len(ids)))
            x, rid, rlabel = matrix(offsets, values, rows, width), ids[rows], labels[rows]
            for value in np.unique(rlabel):
                mine = np.flatnonzero(rlabel == value)
                j = of_label.get(value, np.empty(0, np.int64))
                if not same:
                    j = np.setdiff1d(np.arange(len(block.ids)), j, assume_unique=True)
                if not len(j):
                    continue
                s = products(x[mine], block.vectors[j])
                if same:
                    good = (s >= top.floor[j]) & (rid[mine][:, None] != block.ids[j])
                else:
                    good = (s <= block.uppers[j, 0]) & (s >= block.lowest[j])
                r, c = np.nonzero(good)
                score, anchor = s[r, c], j[c]
                slot = 0 if same else (block.uppers[anchor] >= score[:, None]).sum(1) - 1
                top.add(anchor * slots + slot, score, rid[mine][r])
    top.prune()
    yield pa.RecordBatch.from_arrays([pa.array(top.cells // slots), pa.array(top.cells % slots), pa.array(top.score), pa.array(top.ids)],
                                     names=["anchor", "slot", "score", "id"])


def _best(rows: DataFrame, block, scale: float, k: int, same: bool) -> DataFrame:
    """First k rows of every (anchor, slot) of a block over the whole table: combiners in the tasks, then one merge."""
    found = rows.mapInArrow(lambda batches: combine(batches, block.value, scale, k, same), "anchor long, slot long, score long, id long")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, lower_percent: int = 30,
                   upper_percent: int = 90, scale: float = 256.0, row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Hard negatives of every row for which `anchors` holds, against all rows.

    A component x counts as floor(scale * x), a score is the integer inner product. An anchor's positives are its first
    `positives` other rows of its label, by score and then smaller id. For each of them come the first `negatives` rows of
    other labels with lower_percent * p <= 100 * s <= upper_percent * p, p being the positive's score.

    Upper limits of an anchor's positives cut the scores into disjoint slots, so one pass keeps the first rows of each slot,
    however much the windows overlap; a window's answer is then the start of its slot and all lower ones in order, cut at
    its lower limit. Anchors come in blocks of bounded size, the only thing that is broadcast; a block costs two passes over
    the rows, whose tasks send at most k rows for each anchor and slot. Labels and copies are no groups of any shuffle.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of different lengths are
    compared as if filled up with zeros (an empty one scores 0). Other rows are those of another id; repeated rows each
    count, repeated anchors give their rows again. An empty table gives an empty one. Other columns are not read. A score
    beyond a long is an error.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vec"),
                       F.coalesce(anchors, F.lit(False)).alias("wanted"))
    usable = F.col("wanted") & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    usable &= ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # Numbers without a single task; they cut the anchors into blocks.
    chosen = settle(with_position(base.where(usable).select("id", "label", "vec"), [], [F.col("id")], "pos"))
    n, width = chosen.agg(F.count("*"), F.max(F.size("vec"))).first()
    per_block = min(BLOCK_ANCHORS, max(1, BLOCK_VALUES // max(width or 1, 1)))
    base, path = base.drop("wanted"), scratch_path(spark, "hard_negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for at in range(0, n, per_block):
        part = chosen.where(F.col("pos").between(at + 1, at + per_block)).orderBy("pos").drop("pos").toArrow().combine_chunks()
        ids, labels, offsets, values = quantised(part.to_batches()[0], scale)
        block = Block(ids, labels, matrix(offsets, values, slice(0, len(ids)), width))
        best = settle(_best(base, spark.sparkContext.broadcast(block), scale, positives, True))
        windows = []  # at most `positives` for each anchor of the block
        for r in best.select("anchor", "id", "score").collect():
            lower, upper = -(-lower_percent * r["score"] // 100), upper_percent * r["score"] // 100
            if lower <= upper:  # empty above a negative score
                windows.append((r["anchor"], r["id"], r["score"], lower, upper))
        if not windows:
            continue
        sent = spark.sparkContext.broadcast(block.limits([(j, lower, upper) for j, _, _, lower, upper in windows]))
        slots = _best(base, sent, scale, negatives, False)
        # Slots descend in score, so an anchor's list from a slot on is the merged suffix that answers that slot's windows.
        merged = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "score", "id"))).alias("found"))
        asked = spark.createDataFrame([(j, int(ids[j]), p, s, lower, int((block.uppers[j] > upper).sum())) for j, p, s, lower, upper in windows],
                                      "j long, anchor_id long, positive_id long, positive_score long, lower long, cut int")
        first = F.slice(F.filter("found", lambda f: f["slot"] >= F.col("cut")), 1, negatives)
        inside = F.filter(first, lambda f: f["score"] >= F.col("lower"))
        out = asked.join(merged, F.col("j") == F.col("anchor")).select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "f"))
        out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("f.id").alias("negative_id"), "positive_score",
                   F.col("f.score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)

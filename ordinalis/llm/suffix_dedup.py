"""Removal of repeated byte strings: suffix arrays over the surroundings of content-defined anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import settle, signed64
from ordinalis.session import small_side

#: Length of the strings, of the grams that anchors are chosen by, and of the blocks that suffixes are sorted by.
LENGTH, GRAM, BLOCK = 200, 32, 32
#: A string has REACH + 1 grams; its anchors are those of the smallest hash. Equal strings have equal anchors at equal places.
REACH = LENGTH - GRAM
#: An anchor's context: the bytes of all strings it can be an anchor of. Blocks are aligned to the anchor.
CONTEXT = REACH + LENGTH
COLUMNS = range(REACH % BLOCK, CONTEXT - BLOCK + 1, BLOCK)
#: Blocks that lie within any string of LENGTH bytes, however it is placed.
WHOLE = (LENGTH - BLOCK + 1) // BLOCK
#: Different contexts of one anchor that are sorted in one task; larger groups are split by the middles that strings at near
#: shifts share: first at two slots of shifts, then, where a middle is itself too frequent, at slots within these.
GROUP, SLOTS = 10_000, (91, 13)
#: Contexts handled at once.
BATCH = 4000

_BYTE = np.random.default_rng(20240613).integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` along the last axis, by doubling; equal windows have equal hashes."""
    out, done, power, piece, width = None, 0, 1, _BYTE[x], 1
    while True:
        if size & width:
            if out is None:
                out, done = piece, width
            else:
                n = x.shape[-1] - done - width + 1
                out = out[..., :n] * np.uint64(pow(int(_STEP), width, 1 << 64)) + piece[..., done:done + n]
                done += width
        if width * 2 > size:
            return _mix(out)
        n = piece.shape[-1] - width
        piece = piece[..., :n] * np.uint64(pow(int(_STEP), width, 1 << 64)) + piece[..., width:width + n]
        width *= 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """Minimum or maximum of all windows of `size`."""
    width = 1
    while width * 2 <= size:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[:len(x) - (size - width)], x[size - width:])


def anchors_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors: grams whose hash is the smallest of some string that holds them."""
    if len(x) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(x, GRAM)
    low = sliding(h, REACH + 1, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    places = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), REACH + 1, np.maximum) == h)
    return places, h[places]


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order, by linear grouping.

    Suffixes start in groups of their first symbol. Groups are taken in descending order. From each member a pointer goes
    to the previous suffix of a smaller group; the suffixes pointed at have a member's string as the next factor of their
    Lyndon prefix, so they move up behind their group, those pointed at most often to the top. When all groups are taken,
    a group holds the suffixes of one Lyndon prefix. Reading the array from its start then puts each suffix's predecessors
    along their pointers at the next free place of their groups. The text's last symbol must be its only smallest one.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for at, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                stay = size[old] - len(moved)
                if stay:
                    new = top = old + stay
                    chosen = set(moved)
                    holes = [place[j] for j in moved if place[j] < new]
                    for at in range(top, top + len(moved)):
                        other = order[at]
                        if other not in chosen:
                            hole = holes.pop()
                            j = order[hole]
                            order[hole], place[other] = other, hole
                            order[at], place[j] = j, at
                    for j in moved:
                        group[j] = new
                    size[new], size[old] = len(moved), stay
        end = start
    out, taken, free = [-1] * n, [False] * n, [0] * n
    out[0] = n - 1
    taken[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not taken[j]:
            g = group[j]
            out[g + free[g]] = j
            free[g] += 1
            taken[j] = True
            j = previous[j]
    return out


def context_row(data: bytes, place: int) -> tuple[int, bytes]:
    """Bytes before the anchor, and the context as far as the text goes."""
    left = min(REACH, place)
    return left, data[place - left:place + LENGTH]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text; equal contexts of a text are one row with their places."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            places, keys = anchors_of(np.frombuffer(data, np.uint8))
            for p, k in zip(places.tolist(), keys.view(np.int64).tolist(), strict=True):
                left, context = context_row(data, p)
                for column, value in zip(rows, (i, k, p, signed64(xxhash.xxh64_intdigest(context, left))), strict=True):
                    column.append(value)
        index = pa.array(rows[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(index), batch.column("rid").take(index), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()),
             pa.array(rows[3], pa.int64())], names=["id", "rid", "key", "place", "digest"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, digest, n, left, context = [], [], [], [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                before, piece = context_row(data, w["place"])
                key.append(w["key"])
                digest.append(w["digest"])
                n.append(w["n"])
                left.append(before)
                context.append(piece)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.int16()),
                                          pa.array(context, pa.binary())], names=["key", "digest", "n", "before", "context"])


def aligned(contexts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows with their anchors in column REACH, and the length after the anchor."""
    x = np.zeros((len(contexts), CONTEXT), np.uint8)
    after = np.array([len(c) for c in contexts], np.int64) - before
    for row, c, b in zip(x, contexts, before, strict=True):
        row[REACH - b:REACH - b + len(c)] = np.frombuffer(c, np.uint8)
    return x, after


def candidates(groups: np.ndarray, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Contexts with WHOLE blocks in a row that stand elsewhere in their group: neighbours in one suffix array of all."""
    blocks = window_hashes(x, BLOCK)[:, list(COLUMNS)]
    columns = np.array(list(COLUMNS)) - REACH
    valid = (columns[None] >= -before[:, None]) & (columns[None] + BLOCK <= after[:, None])
    blocks = _mix(blocks + groups[:, None].astype(np.uint64) * _STEP)
    # Symbols: the end is 0, a context's end and blocks that are cut off are unique, equal blocks of a group are equal.
    _, rank = np.unique(blocks[valid], return_inverse=True)
    m, width = blocks.shape
    text = np.arange(1, m * (width + 1) + 1).reshape(m, width + 1)
    text[:, :width][valid] = m * (width + 1) + 1 + rank
    flat = np.append(text.ravel(), 0)
    order = np.array(suffix_array(flat.tolist()))
    padded = np.append(flat, np.zeros(WHOLE, flat.dtype))
    same = np.ones(len(order) - 1, bool)
    for k in range(WHOLE):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    hit = np.zeros(m, bool)
    hit[np.concatenate([order[1:][same], order[:-1][same]]) // (width + 1)] = True
    return hit


def repeated_range(groups: np.ndarray, n: np.ndarray, x: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last shift (bytes before the anchor) between low and high at which a context's string stands elsewhere too; -1 if none."""
    h = window_hashes(x, LENGTH)[:, ::-1]  # column = shift
    shift = np.arange(REACH + 1)
    valid = (shift[None] <= np.minimum(before, high)[:, None]) & (shift[None] >= np.maximum(LENGTH - after, low)[:, None])
    key = _mix(h + (groups[:, None].astype(np.uint64) * np.uint64(REACH + 1) + shift[None].astype(np.uint64)) * _STEP)
    _, inverse = np.unique(key[valid], return_inverse=True)
    rows = np.broadcast_to(np.arange(len(x))[:, None], valid.shape)[valid]
    again = np.zeros(valid.shape, bool)
    again[valid] = np.bincount(inverse, n[rows])[inverse] > 1
    some = again.any(1)
    return np.where(some, again.argmax(1), -1), np.where(some, REACH - again[:, ::-1].argmax(1), -1)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated strings for contexts that come sorted by group; a group never spans two runs."""
    held: list[dict] = []

    def run(rows: list[dict]) -> pa.RecordBatch:
        rows = list({(r["grp"], r["digest"]): r for r in rows}.values())
        names = {g: k for k, g in enumerate(dict.fromkeys(r["grp"] for r in rows))}
        groups = np.array([names[r["grp"]] for r in rows], np.int64)
        n, before, low, high = (np.array([r[c] for r in rows], np.int64) for c in ("n", "before", "low", "high"))
        x, after = aligned([r["context"] for r in rows], before)
        hit = candidates(groups, x, before, after) | (n > 1)
        at = np.flatnonzero(hit)
        first, last = repeated_range(groups[at], n[at], x[at], before[at], after[at], low[at], high[at])
        at, first, last = at[first >= 0], first[first >= 0], last[first >= 0]
        return pa.RecordBatch.from_arrays([pa.array([rows[i]["key"] for i in at], pa.int64()), pa.array([rows[i]["digest"] for i in at], pa.int64()),
                                           pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "digest", "first", "last"])

    for batch in batches:
        held += batch.to_pylist()
        if len(held) >= BATCH:
            cut = len(held)
            while cut > 0 and held[cut - 1]["grp"] == held[-1]["grp"]:
                cut -= 1
            if cut:
                yield run(held[:cut])
                held = held[cut:]
    if held:
        yield run(held)


def slots_of(contexts: DataFrame, size: int) -> DataFrame:
    """(key, digest, grp, low, high): the slots of `size` shifts in which a context has strings between `low` and `high`,
    grouped by the bytes that all strings of the slot share. The bytes themselves stay behind."""
    first = F.greatest(F.col("low"), F.lit(LENGTH) - F.length("context") + F.col("before"))
    last = F.least(F.col("high"), F.col("before").cast("int"))
    start = (F.floor(first / size) * size).cast("int")
    cut = contexts.where(first <= last).withColumn("slot", F.explode(F.sequence(start, last, F.lit(size))))
    end = F.least(F.col("slot") + F.lit(size - 1), F.lit(REACH))
    # Contexts with strings in a slot hold all of its middle, which is thus the same for all.
    middle = F.substring("context", F.col("before") - F.col("slot") + 1, F.lit(LENGTH) - end + F.col("slot"))
    return cut.select("key", "digest", F.xxhash64("key", "slot", middle).alias("grp"), F.col("slot").alias("low"), end.alias("high"))


def split(hot: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Contexts of large groups in groups of at most GROUP, and those that are left over, both None where there are none.

    Each is (grp, key, digest, n, before, context, low, high). A middle that stands in one context only tells that the
    context's strings at these shifts stand nowhere else, so only contexts that share one are read again.
    """
    small, asked = None, hot.withColumns({"low": F.lit(0), "high": F.lit(REACH)})
    for size in SLOTS:
        cut = settle(slots_of(asked, size))
        rows = cut.groupBy("grp").agg(F.count("*").alias("rows")).where("rows > 1")
        shared = settle(cut.join(rows, "grp"))
        fits = hot.join(shared.where(F.col("rows") <= GROUP), ["key", "digest"]).select(*_SOLVABLE)
        small = fits if small is None else small.unionByName(fits)
        left = shared.where(F.col("rows") > GROUP)
        if left.isEmpty():
            return small, None
        asked = hot.join(left, ["key", "digest"]).select(*_SOLVABLE)
    return small, asked


_SOLVABLE = ("grp", "key", "digest", "n", "before", "context", "low", "high")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            gone = merged([(s["a"], min(s["b"], len(data))) for s in spans or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"a": a, "b": b} for a, b in gone]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
             pa.array(cols[4], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every document; `removed` lists byte spans.

    A byte goes if it lies in a 200-byte string of its text that starts anywhere else in the table too, overlaps included.
    Every such string has an anchor chosen by its content alone, so equal strings meet at equal anchors. Anchors that occur
    once drop out on eight bytes each. For the rest, equal contexts are one row with a count; the different contexts of an
    anchor are sorted as suffixes of blocks, and neighbours are then compared string by string, so the result is exact.
    An anchor with more than GROUP different contexts is split by the middles that strings at near shifts share, of which
    only hashes are brought together, and what is still larger is counted string by string: no task sees an unbounded group.

    A null text is empty; texts shorter than 200 bytes lose nothing. Rows that share id and text count as two places and
    get equal results. Rows without an id are documents like others; an empty table gives an empty one. Other columns are
    not read.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.hash(text).alias("rid"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["id"]
    anchors = settle(base.mapInArrow(_anchor_rows, f"id {kind}, rid int, key bigint, place int, digest bigint"))
    often = anchors.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    members = settle(anchors.join(often, "key"))
    kinds = settle(members.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "rid", "place")).alias("at")))
    sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"))

    sought = kinds.join(sizes.where("kinds > 1"), "key")
    by_doc = settle(sought.groupBy(F.col("at.id").alias("of"), F.col("at.rid").alias("ofr")).agg(
        F.collect_list(F.struct("key", "digest", "n", F.col("at.place").alias("place"))).alias("wanted")))
    read = base.join(small_side(by_doc.select("ofr").distinct()), F.col("rid") == F.col("ofr"), "left_semi")
    read = read.join(by_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("ofr"))).select("text", "wanted")
    found = read.mapInArrow(_contexts, "key bigint, digest bigint, n bigint, before smallint, context binary")
    # Alike contexts side by side: they take a fraction of the space.
    contexts = settle(found.repartition("key").sortWithinPartitions("key"))

    large = small_side(sizes.where(F.col("kinds") > GROUP).select("key"))
    small = contexts.join(large, "key", "left_anti").select(F.col("key").alias("grp"), "*", F.lit(0).alias("low"), F.lit(REACH).alias("high"))
    rest = None
    if not large.isEmpty():
        parts, rest = split(contexts.join(large, "key", "left_semi"))
        small = small.unionByName(parts)
    solved = small.repartition("grp").sortWithinPartitions("grp").mapInArrow(_solve, "key bigint, digest bigint, first int, last int")

    if rest is not None:
        # Strings of slots that are still large, one row for each shift.
        shifts = rest.withColumn("shift", F.explode(F.sequence("low", "high"))).where(
            (F.col("shift") <= F.col("before")) & (F.length("context") - F.col("before") + F.col("shift") >= LENGTH))
        strings = shifts.select("key", "digest", "n", "shift", F.md5(F.substring("context", F.col("before") - F.col("shift") + 1, F.lit(LENGTH))).alias("s"))
        again = strings.groupBy("key", "shift", "s").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
        solved = solved.unionByName(strings.join(again, ["key", "shift", "s"]).select(
            "key", "digest", F.col("shift").cast("int").alias("first"), F.col("shift").cast("int").alias("last")))

    ranges = solved.groupBy("key", "digest").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # Contexts that occur twice repeat as a whole, up to the ends of the text.
    verdicts = kinds.where("n > 1").select("key", "digest", F.lit(0).alias("first"), F.lit(REACH).alias("last")).unionByName(
        kinds.where("n = 1").select("key", "digest").join(ranges, ["key", "digest"]))
    spans = members.join(verdicts, ["key", "digest"]).select(
        "id", "rid", F.greatest(F.col("place") - F.col("last"), F.lit(0)).alias("a"), (F.col("place") - F.col("first") + LENGTH).alias("b")
    ).groupBy(F.col("id").alias("of"), F.col("rid").alias("ofr")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = small_side(spans)
    joined = base.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("ofr")), "left").select("id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<a: bigint, b: bigint>>")

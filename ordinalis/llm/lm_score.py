"""Cross-entropy difference: how much likelier a document is under a target model than under a background model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import hash64, settle
from ordinalis.session import small_side

#: Distinct words a task counts before it passes them on.
COUNTER_WORDS = 200_000
#: Tokens counted at once.
GROUP_TOKENS = 500_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.update(words(text.as_py()))
            if len(seen) > COUNTER_WORDS:
                yield rows()
                seen.clear()
    yield rows()


class Pairs:
    """Numbers of the (previous word, word) pairs of texts. Words outside the vocabulary are word 0; a text starts after word `size`."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {w.encode(): i + 1 for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary) + 1

    def __call__(self, text: str | None) -> np.ndarray:
        get = self.ids.get
        ids = np.array([self.size, *[get(w, 0) for w in words(text)]], np.int64)
        return ids[:-1] * self.size + ids[1:]


def log_model(counts: np.ndarray, mass: float) -> np.ndarray:
    """Log probabilities of a word after a word, flat: pair counts smoothed by `mass` observations of the word frequencies."""
    size = counts.shape[1]
    single = (counts.sum(0) + 1.0) / (counts.sum() + size)
    return np.log((counts + mass * single) / (counts.sum(1, keepdims=True) + mass)).ravel()


def vocabulary_of(docs: DataFrame, size: int, text: str = "text") -> list[str]:
    """The most frequent words of the whole table, one less than `size`; equal counts in the order of the words."""
    counted = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(_count_words, "word string, n bigint")
    return [r["word"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 1).collect()]


#: Words whose hash a task remembers.
KNOWN_WORDS = 200_000


def _text_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with its different (previous word, word) pairs. Words are 64-bit hashes; a text starts after the empty word."""
    known: dict[bytes, int] = {}
    start = hash64(b"")
    cell = pa.struct([("prev", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        tokens, ends, prev, word, count = [], [0], [], [], []
        for text in batch.column("text"):
            w = words(text.as_py())
            if len(known) > KNOWN_WORDS:
                known.clear()
            for x in w:
                if x not in known:
                    known[x] = hash64(x)
            ids = [known[x] for x in w]
            found = Counter(zip([start, *ids[:-1]], ids, strict=False))
            tokens.append(len(w))
            ends.append(ends[-1] + len(found))
            prev += [k[0] for k in found]
            word += [k[1] for k in found]
            count += found.values()
        cells = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (prev, word, count)], fields=list(cell))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("row", "doc_id", "target")], pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)],
            names=["row", "doc_id", "target", "n_tokens", "cells"])


def _whole_scores(flagged: DataFrame, mass: float) -> DataFrame:
    """Scores under models of every word. Counts stay tables, which grow with the texts and are joined to each text's pairs."""
    id_type = dict(flagged.dtypes)["doc_id"]
    texts = settle(flagged.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _text_pairs, f"row bigint, doc_id {id_type}, target boolean, n_tokens bigint, cells array<struct<prev: bigint, word: bigint, n: bigint>>"))
    each = texts.select("row", "target", F.explode("cells").alias("c")).select("row", "target", "c.prev", "c.word", "c.n")
    sums = [F.sum("n").alias("b"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t")]
    counts = settle(each.groupBy("prev", "word").agg(*sums))
    after = counts.groupBy("prev").agg(F.sum("b").alias("pb"), F.sum("t").alias("pt"))
    single = settle(counts.groupBy("word").agg(F.sum("b").alias("wb"), F.sum("t").alias("wt")))
    distinct, all_b, all_t = single.agg(F.count("*"), F.coalesce(F.sum("wb"), F.lit(0)), F.coalesce(F.sum("wt"), F.lit(0))).first()

    def log(n: str, whole: int, one: str, prev: str):
        share = (F.col(one) + 1.0) / F.lit(float(whole + distinct + 1))
        return F.ln((F.col(n) + mass * share) / (F.col(prev) + mass))

    logs = counts.join(after, "prev").join(single, "word").select("prev", "word", log("t", all_t, "wt", "pt").alias("lt"), log("b", all_b, "wb", "pb").alias("lb"))
    losses = each.select("row", "prev", "word", "n").join(logs, ["prev", "word"]).groupBy("row").agg(
        *[(-F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(name) for c, name in (("lt", "target_loss"), ("lb", "background_loss"))])
    return texts.select("row", "doc_id", "n_tokens").join(losses, "row", "left").drop("row")


def lm_scores(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = 1024, mass: float = 50.0, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for every document.

    Two bigram models share one vocabulary, the most frequent words of all documents, and the same smoothing. The background
    model counts every text, the target model the texts of `target_ids` (one column of ids). Losses are mean negative log
    likelihoods of a token; the difference is target minus background, so the lowest documents are the most target-like.
    All words and pairs of all texts are counted, by partial sums in the tasks. What is brought together and broadcast is
    bounded by the vocabulary: its words, and two tables of its size squared (17 MB at 1024).

    With `vocabulary` None every word counts as itself: nothing is broadcast, and the models are tables of all pairs.

    Texts without words have 0 tokens and null losses. Rows of a null id count as background. Repeated ids score each row.
    Empty tables give empty results. Other columns are not read.
    """
    wanted = small_side(target_ids.select(F.col(target_ids.columns[0]).alias("want")).where("want is not null").distinct())
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if vocabulary is None:
        flags = base.join(wanted, F.col("doc_id") == F.col("want"), "left").select("doc_id", "text", F.col("want").isNotNull().alias("target"))
        return _whole_scores(flags, mass).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    spark = docs.sparkSession
    pairs = spark.sparkContext.broadcast(Pairs(vocabulary_of(docs, vocabulary, text)))
    size = pairs.value.size
    flagged = base.where("text is not null").join(wanted, F.col("doc_id") == F.col("want"), "left").select(F.col("want").isNotNull().alias("target"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cells = pairs.value, (size + 1) * size
        total = np.zeros((2, cells), np.int64)
        for batch in batches:
            held: tuple[list, list] = ([], [])
            waiting = 0
            for text_, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                held[bool(target)].append(number(text_.as_py()))
                waiting += len(held[bool(target)][-1])
                if waiting > GROUP_TOKENS:
                    _add(total, held, cells)
                    held, waiting = ([], []), 0
            _add(total, held, cells)
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1, used]), pa.array(total.sum(0)[used])], names=["pair", "target", "background"])

    found = flagged.mapInArrow(count, "pair bigint, target bigint, background bigint").groupBy("pair").agg(
        F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
    models = []
    for side in ("target", "background"):
        counts = np.zeros((size + 1) * size, np.float64)
        counts[found["pair"].to_numpy()] = found[side].to_numpy()
        models.append(log_model(counts.reshape(size + 1, size), mass))
    shared = spark.sparkContext.broadcast(np.stack(models))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, logs = pairs.value, shared.value
        for batch in batches:
            out = []
            for text_ in batch.column("text"):
                p = number(text_.as_py())
                out.append((len(p), -float(logs[0][p].mean()), -float(logs[1][p].mean())) if len(p) else (0, None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()),
                 pa.array([o[2] for o in out], pa.float64())], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    scored = base.mapInArrow(score, f"doc_id {dict(base.dtypes)['doc_id']}, n_tokens bigint, target_loss double, background_loss double")
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def _add(total: np.ndarray, held: tuple[list, list], cells: int) -> None:
    for side, parts in enumerate(held):
        if parts:
            total[side] += np.bincount(np.concatenate(parts), minlength=cells)

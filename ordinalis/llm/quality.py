"""Quality rules: figures of one text, and lines that too many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.common import LOWER, UPPER, hash64, settle

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 8
_FOLD = bytes.maketrans((UPPER + "123456789").encode(), (LOWER + "0" * 9).encode())
_ZEROS = re.compile(rb"0+")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more. Hashes pick the windows, the words decide."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(maybe):
        seen.setdefault(tuple(words[i:i + size]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered[i] += 1
                covered[i + size] -= 1
    return int((np.cumsum(covered) > 0).sum())


def normal_line(line: bytes) -> bytes:
    """Lower-cased, runs of white space as one blank, runs of digits as one zero."""
    return _ZEROS.sub(b"0", b" ".join(line.split()).translate(_FOLD))


def text_figures(text: str | None) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words by hash of normalised line."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    by_line: dict[int, int] = {}
    for x in lines:
        h = hash64(normal_line(x))
        by_line[h] = by_line.get(h, 0) + len(x.split())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), by_line


_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_figures(t.as_py()) for t in batch.column("text")]
        out = {"doc_id": batch.column("doc_id"), "host": batch.column("host"), "rid": batch.column("rid")}
        out |= {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(_NAMES)}
        out["lines"] = pa.array([[{"h": h, "w": w} for h, w in r[5].items()] for r in rows], _LINES)
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def quality(docs: DataFrame, max_docs: int = 10, max_share: float = 0.005, least_left: float = 0.5, least_words: int = 20,
            max_repeat_percent: int = 30, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Rule figures and a verdict for every document.

    Lines are normalised and hashed; for each host the distinct documents that hold a line are counted over the whole
    table. A line above both limits (more than `max_docs` documents and more than `max_share` of the host's documents)
    is removed wherever that host has it. A document fails the base rules with fewer than `least_words` words, or when
    more than `max_repeat_percent` of its words lie in repeated windows; it is depleted when removal leaves fewer than
    `least_words` words or less than `least_left` of them. `kept` needs neither.

    Lines are counted from rows (host, line, document) with partial sums, so that a line in every document is no hot
    group. A null text has no words and fails; a null host is a host of its own; rows that agree in id, text and host
    are one document and get the same result; an empty table gives an empty one. Other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text", "host"))
    kind = dict(base.dtypes)
    schema = (f"doc_id {kind['doc_id']}, host {kind['host']}, rid bigint, " + ", ".join(f"{n} bigint" for n in _NAMES)
              + ", lines array<struct<h: bigint, w: bigint>>")
    figures = settle(base.mapInArrow(_figures, schema))
    lines = figures.select("host", "rid", F.explode("lines").alias("l")).select("host", "rid", "l.h", "l.w")
    hosts = figures.groupBy("host").agg(F.count_distinct("rid").alias("host_docs"))
    counts = lines.groupBy("host", "h").agg(F.count_distinct("rid").alias("n_docs")).where(F.col("n_docs") > max_docs)
    frequent = counts.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(
        F.col("n_docs") > F.col("host_docs") * F.lit(max_share)).select(F.col("host").alias("of"), F.col("h").alias("fh"))
    removed = (lines.join(frequent, (F.col("h") == F.col("fh")) & F.col("host").eqNullSafe(F.col("of")))
               .select("rid", "h", "w").distinct()
               .groupBy(F.col("rid").alias("r")).agg(F.sum("w").alias("removed")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < least_words) | (left < least_left * F.col("n_words")))
    return (figures.drop("lines", "host").join(removed, F.col("rid") == F.col("r"), "left")
            .withColumn("n_removed_words", F.coalesce("removed", F.lit(0)))
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)
            .select("doc_id", *_NAMES, "base_failed", "kept", "n_removed_words"))

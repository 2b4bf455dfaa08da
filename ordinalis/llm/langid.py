"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordinalis.llm.toxicity import held_out

#: Bytes of a window. Texts are cut into windows one after the other; the last is filled up with zero bytes.
WINDOW = 128
WIDTHS = (2, 3, 4, 5)
#: Windows the network sees at once.
GROUP = 128


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray          # 256 x dim
    filters: list[np.ndarray]  # for each width: width x dim x filters
    shift: np.ndarray          # all filters
    out: np.ndarray            # all filters x languages
    bias: np.ndarray           # languages


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 6, filters: int = 8, steps: int = 400, batch: int = 256, rate: float = 0.01,
          seed: int = 11) -> Network:
    """Fit on windows of labelled texts; languages weigh equally. Max pooling sends each gradient to one window place."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    total = filters * len(WIDTHS)
    net = Network(languages, rng.normal(0, 0.5, (256, dim)), [rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)) for w in WIDTHS],
                  np.zeros(total), rng.normal(0, total**-0.5, (total, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return net
    data = [windows_of(t.encode("utf-8", "surrogatepass")) for t in texts]
    x = np.concatenate(data)
    y = np.repeat([languages.index(g) for g in langs], [len(d) for d in data])
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    params = [net.embed, *net.filters, net.shift, net.out, net.bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        want = rng.integers(0, len(languages), batch)
        rows = np.array([by[k][rng.integers(len(by[k]))] for k in want])
        b = x[rows]
        e = net.embed[b]
        pooled, places = [], []
        for w, f in zip(WIDTHS, net.filters, strict=True):
            a = sum(e[:, j:WINDOW - w + 1 + j] @ f[j] for j in range(w))
            places.append(a.argmax(1))
            pooled.append(np.take_along_axis(a, places[-1][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + net.shift
        h = np.maximum(raw, 0)
        d = softmax(h @ net.out + net.bias)
        d[np.arange(batch), want] -= 1
        d /= batch
        dh = (d @ net.out.T) * (raw > 0)
        grads = [np.zeros_like(net.embed), *[np.zeros_like(f) for f in net.filters], dh.sum(0), h.T @ d, d.sum(0)]
        for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            part = dh[:, i * filters:(i + 1) * filters]
            for j in range(w):
                at = b[np.arange(batch)[:, None], places[i] + j]          # batch x filters
                grads[1 + i][j] = np.einsum("bfd,bf->df", net.embed[at], part)
                np.add.at(grads[0], at.ravel(), (part[:, :, None] * f[j].T[None]).reshape(-1, dim))
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """Applies a network. Embedding and filters are folded into tables of what a byte, or a pair of bytes, adds."""

    def __init__(self, net: Network):
        self.net = net
        one = [[(net.embed @ f[j]).astype(np.float32) for j in range(len(f))] for f in net.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
        # For each width: tables for the pairs of places 0, 1 and 2, 3, then for a last single place.
        self.pairs = [[pair(t[j], t[j + 1]) for j in range(0, len(t) - 1, 2)] for t in one]
        self.single = [t[-1] if len(t) % 2 else None for t in one]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for windows. Places come first in memory, so that pooling runs over whole rows."""
        out = []
        for i in range(0, len(x), GROUP):
            b = np.ascontiguousarray(x[i:i + GROUP].T).astype(np.intp)
            q = b[:-1] << 8 | b[1:]
            top = []
            for w, pairs, single in zip(WIDTHS, self.pairs, self.single, strict=True):
                n = WINDOW - w + 1
                a = pairs[0].take(q[:n], 0)
                for j, table in enumerate(pairs[1:], 1):
                    a += table.take(q[2 * j:2 * j + n], 0)
                if single is not None:
                    a += single.take(b[w - 1:w - 1 + n], 0)
                top.append(a.max(0))
            out.append(softmax(np.maximum(np.concatenate(top, 1) + self.net.shift, 0) @ self.net.out + self.net.bias))
        return np.concatenate(out)


def labelled_sample(docs: DataFrame, per_language: int, chars: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    most: int = 200) -> list[tuple[str, str]]:
    """At most `per_language` pieces of text of each language outside the held-out fold, each of at most `chars` characters.

    Rows are taken by hash of their id, the piece from a place that the hash chooses; at most `most` languages are learned,
    the most frequent ones. This bounds training only.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id).alias("k")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("id")))
    languages = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "id"))
    picked = F.broadcast(rows.where(F.col("lang").isin(languages)).withColumn("place", place).where(F.col("place") <= per_language).select("id", "k").distinct())
    texts = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    room = F.greatest(F.length("text") - F.lit(chars), F.lit(0))
    piece = F.col("text").substr((F.pmod(F.col("k"), room + 1) + 1).cast("int"), F.lit(chars))
    found = texts.join(picked, F.col("of") == F.col("id")).where("lang is not null and text is not null")
    taken = found.select("k", "id", piece.alias("piece"), "lang").orderBy("k", "id", "piece").limit(per_language * len(languages))
    return [(r["piece"], r["lang"]) for r in taken.collect()]


def identify(docs: DataFrame, per_language: int = 1000, chars: int = 600, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text.

    All windows of a text are classified and their probabilities averaged; the score is the mean of the best language.
    Texts that are null or hold no letter are `und` with score 0. Without labelled rows every text is `und`. Rows without an
    id are not held out and not learned from. Repeated rows get equal results; an empty table gives an empty one. The network
    is broadcast; its size does not depend on the data but for 32 numbers a language.
    """
    sample = labelled_sample(docs, per_language, chars, doc_id, text, lang)
    net = train([t for t, _ in sample], [g for _, g in sample])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            names, scores = predict(reader, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def predict(reader: Reader, texts: list[str | None], group_bytes: int = 1 << 22) -> tuple[list[str], list[float]]:
    """Languages and scores of texts, whose windows are classified in groups of bounded size."""
    languages = reader.net.languages
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if todo:
            p = reader(np.concatenate([w for _, w in todo]))
            start = np.cumsum([0] + [len(w) for _, w in todo])
            mean = np.add.reduceat(p, start[:-1]) / np.diff(start)[:, None]
            for (i, _), m in zip(todo, mean, strict=True):
                names[i], scores[i] = languages[int(m.argmax())], float(min(1.0, m.max()))
            todo.clear()

    held = 0
    for i, text in enumerate(texts):
        if text and languages and any(map(str.isalpha, text)):
            todo.append((i, windows_of(text.encode("utf-8", "surrogatepass"))))
            held += todo[-1][1].size
            if held > group_bytes:
                flush()
                held = 0
    flush()
    return names, scores

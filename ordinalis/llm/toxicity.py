"""Toxicity scores from subword bags: n-gram embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ".,;:!?\"'()[]{}«»…-"
#: Words of a bag; a text is scored in consecutive bags, so a short insult in a long text isn't averaged away.
BAG_WORDS = 16
#: Lengths in bytes of the subwords, and the factor of the mean before the softmax.
GRAMS = (3, 4, 5, 6)
SCALE = 20.0
#: Characters whose words are looked up together.
GROUP_CHARS = 2_000_000
#: Words whose gradients are summed at once.
PART_WORDS = 1 << 19
#: Distinct words whose scores a task remembers at once.
MEMORY_WORDS = 300_000


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_table(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of all words in a row, the start of each word's buckets, and their number.

    Words are stripped of punctuation and get end marks, so that even one letter has an n-gram.
    """
    parts = [b"<%b>" % w.strip(EDGES).encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts) + bytes(GRAMS[-1]), np.uint8).astype(np.uint32)
    n = len(data) - GRAMS[-1]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    grams, valid, h = np.empty((n, len(GRAMS)), np.uint32), np.empty((n, len(GRAMS)), bool), np.zeros(n, np.uint32)
    for k in range(GRAMS[-1]):
        h = h * np.uint32(0x01000193) + (data[k:k + n] + np.uint32(1))
        if k + 1 in GRAMS:
            j = GRAMS.index(k + 1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            grams[:, j], valid[:, j] = (mixed ^ (mixed >> np.uint32(13))) % np.uint32(buckets), left > k
    first = np.cumsum(sizes) - sizes
    count = np.add.reduceat(valid.sum(1), first) if len(words) else np.zeros(0, np.int64)
    # An empty word is "<>": it keeps one bucket, its own.
    valid[first, 0] = True
    count = np.maximum(count, 1)
    return grams[valid].astype(np.int64), np.cumsum(count) - count, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x 2
    bias: np.ndarray     # 2
    text: np.ndarray     # log-odds of a text: constant, factor of its highest bag, factor of the log of its number of bags
    empty: float         # score of a text without a word, the share of toxic texts


    def bucket_scores(self) -> tuple[np.ndarray, float, np.ndarray, float]:
        """Log-odds that a bucket adds to a bag's mean, the constant, the text's, and the score of an empty text: averaging and
        softmax are linear in the first two."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return SCALE * (self.vectors @ w).astype(np.float64), float(self.bias[1] - self.bias[0]), self.text, self.empty


class Sample:
    """Texts as word numbers cut into bags, and the subwords of every distinct word; texts without a word are left out."""

    def __init__(self, texts: list[str], labels: list[int], buckets: int):
        known: dict[str, int] = {}
        words, starts, docs, kept, at, bags = [], [], [], [], 0, 0
        for text, y in zip(texts, labels, strict=True):
            ids = np.array([known.setdefault(w, len(known)) for w in tokens(text)], np.int32)
            if len(ids):
                words.append(ids)
                starts.append(np.arange(at, at + len(ids), BAG_WORDS))
                docs.append(bags)
                kept.append(y)
                at, bags = at + len(ids), bags + len(starts[-1])
        self.words, self.starts, self.docs, self.y, self.n_words = words, starts, docs, np.array(kept, np.float64), len(known)
        grams, self.gram_start, self.gram_n = word_table(list(known), buckets)
        self.grams = grams.astype(np.int32)

    def texts_with(self, buckets: int) -> np.ndarray:
        """For each class and bucket the texts that hold it."""
        holds = np.zeros((2, buckets), np.int64)
        for ids, y in zip(self.words, self.y, strict=True):
            ids = np.unique(ids)
            holds[int(y), np.unique(self.grams[_ranges(self.gram_start[ids], self.gram_n[ids])])] += 1
        return holds

    def parts(self, words: int = PART_WORDS):
        """Runs of whole texts of a bounded number of words: word numbers, bag starts, text starts among the bags, classes."""
        i = 0
        while i < len(self.words):
            j, size = i, 0
            while j < len(self.words) and (j == i or size + len(self.words[j]) <= words):
                size += len(self.words[j])
                j += 1
            flat, starts = np.concatenate(self.words[i:j]), np.concatenate(self.starts[i:j])
            docs = np.array(self.docs[i:j])
            yield slice(i, j), flat, starts - starts[0], docs - docs[0]
            i = j


def train(texts: list[str], labels: list[int], buckets: int = 1 << 18, dim: int = 4, epochs: int = 40, rate: float = 0.05,
          least: int = 5, seed: int = 7, held: float = 0.2, toxic_share: float | None = None) -> Model:
    """Fit embeddings and softmax together on whole-text labels, then the log-odds of a text.

    A text is toxic if any of its bags is (noisy or), so that the loss of a toxic text flows to the bags that explain it.
    The first direction starts at how much likelier a subword's presence makes the toxic class, shrunk where few texts have it.
    A share `held` of the texts takes no part in that: on them a text's log-odds are fitted to its highest bag and its number of
    bags, also of texts joined to long ones, so that length alone makes no text toxic; `toxic_share` is the share of toxic texts to expect there, by default that of
    the texts given. Gradients are summed over parts of bounded size.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (buckets, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.array([2.0, -2.0], np.float32)
    order = rng.permutation(len(texts))
    cut = int(len(texts) * held) if min(sum(labels), len(labels) - sum(labels)) >= 40 else 0
    pick = lambda index: Sample([texts[i] for i in index], [labels[i] for i in index], buckets)
    sample = pick(order[cut:])
    y = sample.y
    if not len(y) or len(set(y)) < 2:
        # Nothing to tell apart: the prior alone decides.
        share = float(y.mean()) if len(y) else 0.0
        odds = np.log((share + 1e-3) / (1 - share + 1e-3)) / 2
        return Model(np.zeros_like(vectors), np.zeros_like(weights), np.array([-odds, odds], np.float32), np.array([0.0, 1.0, 0.0]), share)
    grams, gram_start, gram_n = sample.grams, sample.gram_start, sample.gram_n
    word_of = np.repeat(np.arange(sample.n_words, dtype=np.int32), gram_n)
    holds = sample.texts_with(buckets)
    ratio = np.log((holds[1] + 0.5) / (y.sum() + 1)) - np.log((holds[0] + 0.5) / ((1 - y).sum() + 1))
    seen = holds[0] + holds[1]
    # Subwords of few texts learn nothing: they would only tell single texts apart.
    vectors *= (common := seen >= max(least, 0.002 * len(y)))[:, None]
    vectors[:, 0], weights[0] = common * ratio * seen / (seen + 5.0), (-0.5, 0.5)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, weights, bias)]
    for epoch in range(1, epochs + 1):
        word_vec = np.stack([np.add.reduceat(vectors[grams, k], gram_start) for k in range(dim)], 1)
        d_word, d_weights, d_bias = np.zeros((sample.n_words, dim)), np.zeros_like(weights), np.zeros_like(bias)
        for rows, flat, starts, docs in sample.parts():
            size = np.add.reduceat(gram_n[flat], starts).astype(np.float32)
            mean = np.stack([np.add.reduceat(word_vec[flat, k], starts) for k in range(dim)], 1) / size[:, None]
            logits = SCALE * mean @ weights + bias
            z = (logits[:, 1] - logits[:, 0]).astype(np.float64)
            clean = np.add.reduceat(-np.logaddexp(0, z), docs)  # log of the chance that no bag is toxic
            pull = np.where(y[rows] > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
            dz = (np.repeat(share[rows] * pull, np.diff(np.append(docs, len(starts)))) / (1 + np.exp(-z))).astype(np.float32)
            d_logits = np.stack([-dz, dz], 1)
            d_mean = SCALE * (d_logits @ weights.T) / size[:, None]
            bag_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
            for k in range(dim):
                d_word[:, k] += np.bincount(flat, d_mean[bag_of, k], sample.n_words)
            d_weights += SCALE * mean.T @ d_logits
            d_bias += d_logits.sum(0)
        d_vec = np.zeros_like(vectors)
        for at in range(0, len(grams), PART_WORDS):
            part = slice(at, at + PART_WORDS)
            for k in range(dim):
                d_vec[:, k] += np.bincount(grams[part], d_word[word_of[part], k], buckets)
        d_vec *= common[:, None]
        for param, grad, (m, v) in zip((vectors, weights, bias), (d_vec, d_weights, d_bias), moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            param -= rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    expected = float(np.mean(labels)) if toxic_share is None else toxic_share
    model = Model(vectors, weights, bias, np.array([0.0, 1.0, 0.0]), expected)
    if cut and 0 in (labels[i] for i in order[:cut]):
        scorer = Scorer(*model.bucket_scores())
        top, bags = scorer.highest([texts[i] for i in order[:cut]])
        top, bags, y, weight = joined(top, bags, np.array([labels[i] for i in order[:cut]], np.float64), rng)
        some = bags > 0
        model.text = text_odds(top[some], np.log(bags[some]), y[some], weight[some], expected)
    return model


def joined(top: np.ndarray, bags: np.ndarray, y: np.ndarray, rng: np.random.Generator, factors=(4, 16, 64),
           part: float = 0.05) -> tuple[np.ndarray, ...]:
    """The texts' (highest bag, bags, class, weight), and those of each text joined with 3, 15 and 63 clean ones, which weigh `part`
    each: long texts of either class are among them, and do not outweigh the others."""
    clean = np.flatnonzero(y == 0)
    tops, sizes = [top], [bags]
    for f in factors:
        more = clean[rng.integers(0, len(clean), (len(y), f - 1))]
        tops.append(np.maximum(top, top[more].max(1)))
        sizes.append(bags + bags[more].sum(1))
    weight = np.repeat([1.0] + [part] * len(factors), len(y))
    return np.concatenate(tops), np.concatenate(sizes), np.tile(y, len(factors) + 1), weight


def text_odds(top: np.ndarray, log_bags: np.ndarray, y: np.ndarray, weight: np.ndarray, toxic_share: float, prior: float = 1.0) -> np.ndarray:
    """Log-odds of a text as constant + factor * highest bag + factor * log of its bags, toxic texts weighing `toxic_share`.

    A ridge fit around (0, 1, 0) by damped Newton steps. If more bags would make a text likelier toxic, their factor is zero.
    """
    if len(set(y)) < 2:
        return np.array([0.0, 1.0, 0.0])
    share = weight * np.where(y > 0, toxic_share / (weight * y).sum(), (1 - toxic_share) / (weight * (1 - y)).sum()) * weight.sum()
    out = np.zeros(3)
    for columns in ([0, 1, 2], [0, 1]):
        x, aim = np.stack([np.ones(len(y)), top, log_bags], 1)[:, columns], np.array([0.0, 1.0, 0.0])[columns]

        def cost(fit: np.ndarray) -> float:
            z = x @ fit
            return float((share * (np.logaddexp(0, z) - y * z)).sum() + prior / 2 * ((fit - aim) ** 2).sum())

        fit = aim.copy()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ fit, -700, 700)))
            grad = x.T @ (share * (p - y)) + prior * (fit - aim)
            step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(columns)), grad)
            size = 1.0
            while cost(fit - size * step) > cost(fit) and size > 1e-6:
                size /= 2
            fit = fit - size * step
            if np.abs(step).max() < 1e-9 or size <= 1e-6:
                break
        out[:] = 0.0
        out[columns] = fit
        if out[2] <= 0:
            break
    return out


class Scorer:
    """Scores texts; remembers the scores of the words seen, up to a bound."""

    def __init__(self, scores: np.ndarray, constant: float, text: np.ndarray, empty: float):
        self.scores, self.constant, self.text, self.empty, self.buckets = scores, constant, text, empty, len(scores)
        self.known: dict[str, int] = {}
        self.sums = self.sizes = np.zeros(0)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMORY_WORDS and self.known:
            self.known, self.sums, self.sizes, new = {}, np.zeros(0), np.zeros(0), list(words)
        if new:
            grams, start, n = word_table(new, self.buckets)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.scores[grams], start)])
            self.sizes = np.concatenate([self.sizes, n])

    def score(self, texts: list[str | None]) -> np.ndarray:
        top, bags = self.highest(texts)
        z = self.text[0] + self.text[1] * top + self.text[2] * np.log(np.maximum(bags, 1))
        return np.where(bags > 0, 1 / (1 + np.exp(-np.clip(z, -700, 700))), self.empty)

    def highest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text's highest bag, and its number of bags; a text without a word has none."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append(tokens(text))
            chars += len(text or "")
            if chars > GROUP_CHARS:
                out += self.highest_of_words(group)
                group, chars = [], 0
        found = np.array(out + self.highest_of_words(group), np.float64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def highest_of_words(self, docs: list[list[str]]) -> list[tuple[float, int]]:
        self.learn(set().union(*docs))
        out = []
        for words in docs:
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            start = np.arange(0, len(ids), BAG_WORDS)
            means = np.add.reduceat(self.sums[ids], start) / np.add.reduceat(self.sizes[ids], start) if words else np.zeros(1)
            out.append((self.constant + float(means.max()), len(start)))
        return out


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str = "doc_id", text: str = "text",
                label: str = "toxic") -> tuple[DataFrame, float]:
    """(text, y) of at most `per_class` toxic and twice as many clean whole texts outside the held-out fold, and the share of toxic rows among
    all labelled ones, in a fixed order.

    Rows are taken by hash of their id, so they are spread over the whole table: first all below a bound that leaves a few
    more than needed, so that tasks send no more however many there are. This bounds what training needs; scoring reads
    everything.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    rows = rows.withColumn("k", F.xxhash64("id"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, most in ((1, per_class), (0, 2 * per_class)):
        # Hashes are even over the longs; ten deviations above the expected number leave too few only with a chance of 1e-20.
        part = min(1.0, (most + 10 * most**0.5) / max(counts.get(y, 0), 1))
        near = rows.where((F.col("y") == y) & (F.col("k") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + part * (1 << 64)))))).orderBy("k", "id").limit(most)
        picked = near if picked is None else picked.unionByName(near)
    texts = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("of") == F.col("id")).where("text is not null")
    return found.orderBy("k", "id", "text").limit(3 * per_class).select("text", "y"), counts.get(1, 0) / max(1, sum(counts.values()))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str = "doc_id", text: str = "text",
                    label: str = "toxic") -> tuple[list[tuple[str, int]], float]:
    """The rows of `sample_rows` as a list, and the share."""
    rows, share = sample_rows(docs, labels, per_class, doc_id, text, label)
    return [(r["text"], r["y"]) for r in rows.collect()], share


def fitted(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str, text: str, label: str):
    """The model of a bounded sample, fitted in one task and broadcast; its size is fixed by the number of buckets.

    Texts stay on the executors: the driver sees the model's scores only, so its memory doesn't grow with the sampled texts.
    """
    sample, share = sample_rows(docs, labels, per_class, doc_id, text, label)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            marks += batch.column("y").to_pylist()
        if texts:
            scores, constant, odds, empty = train(texts, marks, toxic_share=share).bucket_scores()
            yield pa.RecordBatch.from_arrays([pa.array([scores.tobytes()]), pa.array([constant]), pa.array([odds.tolist()]), pa.array([empty])],
                                             names=["scores", "constant", "odds", "empty"])

    made = sample.mapInArrow(fit, "scores binary, constant double, odds array<double>, empty double").collect()
    # An empty sample has no task that fits it.
    model = [(np.frombuffer(r["scores"]), r["constant"], np.array(r["odds"]), r["empty"]) for r in made] or [train([], [], toxic_share=share).bucket_scores()]
    return docs.sparkSession.sparkContext.broadcast(model[0])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2500, doc_id: str = "doc_id",
             text: str = "text", label: str = "toxic") -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted).

    The model comes from a bounded labelled sample of whole texts (`labelled_sample`). A text's score is the softmax of its highest
    bag, corrected for its number of bags, so a long clean text is not toxic for its length. Texts without a word, null ones too, get the
    share of toxic labels, rows without an id are never
    held out, repeated rows get equal rows, an empty table or no usable labels still give a defined score (the prior).
    Only the text enters the score; other columns are not read.
    """
    shared = fitted(docs, labels, per_class, doc_id, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            got = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got)], names=["doc_id", "held_out", "score"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    scored = base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2500,
               doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    shared = fitted(docs, labels, per_class, doc_id, text, label)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(place).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)

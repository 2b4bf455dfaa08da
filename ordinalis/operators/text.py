"""Jobs on free text: quality audit, vocabulary, templated prompts, fingerprints and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import (CLASSES, EXTRA_CHARGES, FIBER, FORBIDDEN_TERMS, NO_FRICTION, NO_SERVICES, PERSONAS, PROMPT, REFUND, SEED,
                                 STOPWORDS, TENURE_PHASES)
from ordinalis.functions.hashing import uniform
from ordinalis.functions.scalar import is_yes, ratio
from ordinalis.operators.prep import c, melt
from ordinalis.operators.ranking import exact_quantiles, join_on, top_k_per_group
from ordinalis.sources.store import Store

# --- audit -------------------------------------------------------------------------------------------------------


def word_count(text: Column) -> Column:
    """Runs of non-blank characters; an empty text has none."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def quality_audit(df: DataFrame, text: str) -> DataFrame:
    """(section, key, value) with every figure truncated to a whole number.

    Lengths are computed once; medians come from length frequencies, so the texts themselves are never shuffled.
    """
    sizes = df.select(F.length(c(text)).alias("chars"), word_count(c(text)).alias("words"))
    totals = sizes.agg(F.count(F.lit(1)).alias("total"), F.avg("chars").alias("cm"), F.min("chars").alias("cmin"),
                       F.max("chars").alias("cmax"), F.count_if(F.col("chars") < 30).alias("short"),
                       F.count_if(F.col("chars") > 500).alias("long"), F.avg("words").alias("wm")).withColumn("_k", F.lit(1))
    both = melt(sizes, {"chars": F.col("chars"), "words": F.col("words")}, "what", "x")
    medians = exact_quantiles(both.filter("x is not null"), ["what"], "x", {"median": 0.5})
    wide = medians.groupBy(F.lit(1).alias("_k")).agg(F.max(F.when(F.col("what") == "chars", F.col("median"))).alias("cmed"),
                                                     F.max(F.when(F.col("what") == "words", F.col("median"))).alias("wmed"))
    rows = [("total", "rows", "total"), ("char_length", "mean", "cm"), ("char_length", "median", "cmed"),
            ("char_length", "min", "cmin"), ("char_length", "max", "cmax"), ("char_length", "below_30", "short"),
            ("char_length", "above_500", "long"), ("word_length", "mean", "wm"), ("word_length", "median", "wmed")]
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"),
                                        F.floor(F.col(v)).cast("long").alias("value")) for s, k, v in rows])).alias("_r")
    return totals.join(wide, "_k").select(arms).select("_r.*")


def term_hits(df: DataFrame, text: str, terms=FORBIDDEN_TERMS, lower: bool = True) -> DataFrame:
    """(term, n) of rows that contain a term, terms without a hit left out: one pass of conditional counts."""
    body = F.lower(c(text)) if lower else c(text)
    wide = df.agg(*[F.count_if(F.contains(body, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    return melt(wide, {t: F.col(f"t{i}") for i, t in enumerate(terms)}, "term", "n").filter("n > 0")


def duplicate_texts(df: DataFrame, text: str) -> DataFrame:
    """Rows that repeat an earlier text; only 32-byte digests are shuffled, counted map-side first."""
    digest = df.select(F.sha2(c(text), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return digest.agg(F.sum("n").alias("n_rows"), F.count("h").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def length_by_class(df: DataFrame, text: str, label: str) -> DataFrame:
    """n, mean and median characters per class, truncated."""
    sizes = df.select(c(label).alias("class"), F.length(c(text)).alias("chars")).filter("chars is not null")
    means = sizes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("chars")).alias("mean_chars"))
    medians = exact_quantiles(sizes, ["class"], "chars", {"m": 0.5})
    return join_on(means, medians, ["class"]).select("class", "n", "mean_chars", F.floor("m").alias("median_chars"))


def top_words(df: DataFrame, text: str, label: str, k: int = 15, min_length: int = 3, stopwords=STOPWORDS) -> DataFrame:
    """Most frequent words per class, ties in alphabetical order.

    Words are counted within each row's own task before the shuffle (partial aggregation); the top-k is then taken
    over the vocabulary.
    """
    words = F.explode(F.regexp_extract_all(F.lower(c(text)), F.lit(r"([\p{L}\p{M}']+)"), F.lit(1))).alias("word")
    counts = (df.select(c(label).alias("class"), words)
              .filter((F.length("word") >= min_length) & ~F.col("word").isin(*stopwords))
              .groupBy("class", "word").agg(F.count(F.lit(1)).alias("n")))
    return top_k_per_group(counts, ["class"], [F.col("n").desc(), F.col("word").asc()], k)


# --- prompts -------------------------------------------------------------------------------------------------------

def _has(df: DataFrame, name: str, otherwise: Column) -> Column:
    return c(name) if name in df.columns else otherwise


def tenure_phase(months: Column) -> Column:
    label = F
    for upto, text in TENURE_PHASES:
        label = label.when(months <= upto, text) if upto is not None else label.otherwise(text)
    return label


def services_summary(df: DataFrame) -> Column:
    yes = lambda name: F.lower(_has(df, name, F.lit("No")).cast("string")) == "yes"
    addons = F.coalesce(_has(df, "n_addons", F.lit(0)), F.lit(0))
    streams = F.concat_ws("+", F.when(yes("Streaming TV"), "TV"), F.when(yes("Streaming Movies"), "Movies"))
    text = F.concat_ws(
        " + ", F.when(yes("Phone Service"), "Phone"), F.when(yes("Internet Service"), "Internet"),
        F.when(addons > 0, F.concat(addons.cast("string"), F.when(addons > 1, " add-ons").otherwise(" add-on"))),
        F.when(streams != "", F.concat(F.lit("Streaming "), streams)))
    return F.when(text == "", NO_SERVICES).otherwise(text)


def friction_summary(df: DataFrame) -> Column:
    one = lambda name: F.coalesce(_has(df, name, F.lit(0)), F.lit(0)) == 1
    fiber = F.lower(F.coalesce(_has(df, "Internet Type", F.lit("None")), F.lit("None"))) == "fiber"
    text = F.concat_ws(", ", F.when(one("has_extra_charges"), EXTRA_CHARGES), F.when(one("has_refund"), REFUND), F.when(fiber, FIBER))
    return F.when(text == "", NO_FRICTION).otherwise(text)


def persona(label: Column, counter: Column) -> Column:
    out = F
    for name in CLASSES:
        plain, mixed = PERSONAS[name]
        out = out.when(label == name, F.when(counter, mixed).otherwise(plain))
    return out.otherwise(None)


def build_prompts(df: DataFrame, key: str, target: str = "NPS_baseline", rate: float = 0.15, seed: int = SEED,
                  system_prompt: str | None = None) -> DataFrame:
    """(key, user_prompt, expected_class, counter_intuitive[, system_prompt]) from column expressions only."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    counter = uniform(seed, "ci", c(key)) < rate
    months = F.coalesce(_has(df, "Tenure Months", F.lit(0)).cast("double"), F.lit(0.0))
    charges = F.coalesce(_has(df, "Monthly Charges", F.lit(0.0)).cast("double"), F.lit(0.0))
    referrer = F.when(F.coalesce(_has(df, "is_referrer", F.lit(0)), F.lit(0)) == 1, "yes").otherwise("no")
    # the whole-dollar figure is rounded half-even beforehand, as printf styles differ between engines
    body = F.format_string(
        PROMPT, months.cast("int"), tenure_phase(months),
        F.coalesce(_has(df, "Contract", F.lit("month-to-month")).cast("string"), F.lit("None")),
        F.coalesce(_has(df, "Internet Type", F.lit("None")).cast("string"), F.lit("None")),
        F.bround(charges).cast("long"), services_summary(df), friction_summary(df), referrer, persona(c(target), counter))
    out = df.select(c(key), body.alias("user_prompt"), c(target).alias("expected_class"), counter.alias("counter_intuitive"))
    return out.withColumn("system_prompt", F.lit(system_prompt)) if system_prompt is not None else out


def prompt_summary(prompts: DataFrame) -> DataFrame:
    n, flagged = F.count(F.lit(1)), F.count_if("counter_intuitive")
    return prompts.groupBy("expected_class").agg(
        n.alias("count"), flagged.alias("ci_count"), F.floor(F.avg(F.length("user_prompt"))).alias("user_prompt_avg_chars"),
        F.round(ratio(flagged, n), 3).alias("ci_rate"))


def label_leaks(prompts: DataFrame, text: str = "user_prompt") -> DataFrame:
    """Rows per class name that literally occurs in the prompt, zeros included."""
    wide = prompts.agg(*[F.count_if(F.contains(c(text), F.lit(k))).alias(k) for k in CLASSES])
    return melt(wide, {k: F.col(k) for k in CLASSES}, "class", "n")


# --- fingerprint and vectors ---------------------------------------------------------------------------------------

def fingerprint(df: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """Order-free content hash of (model, id, text): row count and sums of four 24-bit slices of each row's md5.

    24 bits leave room for 2^39 rows in a long.
    """
    digest = F.md5(F.concat_ws("|", F.lit(model), c(key).cast("string"), F.coalesce(c(text), F.lit(""))))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 6), 16, 10).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n"), *[part(1 + 6 * i).alias(f"h{i + 1}") for i in range(4)])


def embed(df: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(key, embedding array<float>) from hashed term frequencies times IDF; an empty text gives the zero vector."""
    base = df.select(c(key), F.coalesce(c(text), F.lit("")).alias("_text"))
    model = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_w", pattern=r"[^\p{L}\p{M}']+", minTokenLength=1),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims), IDF(inputCol="_tf", outputCol="_v")]).fit(base)
    return model.transform(base).select(c(key), vector_to_array("_v", "float32").alias("embedding"))


def embed_with(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], object]],
               batch: int = 64) -> DataFrame:
    """Same table from a user's encoder: `encoder()` is called once per task and maps a list of texts to a 2-d array."""
    base = df.select(c(key), F.coalesce(c(text), F.lit("")).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in frames:
            texts = pdf["_text"].tolist()
            out = []
            for at in range(0, len(texts), batch):
                part = texts[at:at + batch]
                for t, v in zip(part, encode(part)):
                    out.append([0.0] * len(v) if not t.strip() else [float(x) for x in v])
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    kind = dict(base.dtypes)[key]
    return base.mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def content_digest(text: str, model: str) -> Column:
    """Digest of (model, text); a NULL text counts as empty."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.coalesce(c(text), F.lit(""))), 256)


def table_digest(df: DataFrame, key: str, text: str, model: str) -> str:
    """The fingerprint as one name for the store."""
    return "-".join(format(v or 0, "x") for v in fingerprint(df, key, text, model).first())


def cached_embeddings(df: DataFrame, key: str, text: str, model: str, store: Store, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of a whole table from the store, recomputed when any id or text differs.

    For vectors that depend on the other texts too, as inverse document frequencies do.
    """
    return store.cached(f"vectors-{model}", table_digest(df, key, text, model), lambda: compute(df))


def encoded_once(df: DataFrame, key: str, text: str, model: str, store: Store, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, embedding) where each different text is encoded once ever: only texts that no stored vector covers are encoded.

    `encode` maps (digest, text) to (digest, embedding) and must not look at other rows.  Repeated texts share a vector; NULL
    texts count as empty; the key may repeat.  A text that many rows share is hot only as a key of the last join, where the
    vectors are the side with one row for each digest, and AQE splits the other.
    """
    name = f"encoded-{model}"
    rows = df.select(c(key).alias("_key"), F.coalesce(c(text), F.lit("")).alias("text"), content_digest(text, model).alias("digest"))

    def extend() -> DataFrame:
        wanted = rows.groupBy("digest").agg(F.first("text").alias("text"))
        known = store.latest(name)
        if known is None:
            return encode(wanted).select("digest", "embedding")
        new = wanted.join(known.select("digest"), "digest", "left_anti")
        return known.unionByName(encode(new).select("digest", "embedding"))

    vectors = store.cached(name, table_digest(rows, "digest", "text", model), extend)
    return rows.join(vectors, "digest").select(F.col("_key").alias(key), "embedding")


def embedding_checks(df: DataFrame, key: str, vector: str, ids: DataFrame | None = None) -> DataFrame:
    """(check, value): dimension range, null or non-finite values, share of varying dimensions, id alignment."""
    values = df.select(c(key), F.posexplode(F.transform(c(vector), lambda v: v.cast("double"))).alias("pos", "v"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    dims = values.groupBy("pos").agg(F.count_if(bad).alias("bad"), F.stddev_pop("v").alias("sd"))
    wide = dims.agg(F.count(F.lit(1)).alias("dims"), F.sum("bad").alias("bad"),
                    ratio(F.count_if(F.col("sd") > 1e-6), F.count(F.lit(1))).alias("varying"))
    sizes = df.agg(F.min(F.size(c(vector))).alias("a"), F.max(F.size(c(vector))).alias("b"))
    d = F.col
    out = melt(wide.withColumn("_k", F.lit(1)).join(sizes.withColumn("_k", F.lit(1)), "_k"),
               {"dims": d("dims").cast("double"), "min_dim": d("a").cast("double"), "max_dim": d("b").cast("double"),
                "non_finite": d("bad").cast("double"), "varying_share": d("varying")}, "check", "value")
    if ids is None:
        return out
    lost = ids.join(df.select(c(key)), key, "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out.unionByName(lost.select(F.lit("ids_without_vector").alias("check"), "value"))

"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalis.functions.hashing import uniform
from ordinalis.llm.common import settle
from ordinalis.session import small_side

#: Means above this are drawn as a sum of equal parts, so that exp(-mean) stays a normal number.
PART_MEAN = 500.0


def temperature_weights(docs: DataFrame, alpha: float = 0.5, source: str = "source") -> DataFrame:
    """Target weights (source, weight) proportional to count ** alpha; alpha 1 keeps the mixture, 0 makes it even."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    return settle(counts.select("source", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("weight")))


def poisson(mean: Column, draw) -> Column:
    """Inverse of the Poisson distribution at draw(part), summed over as many equal parts as the mean needs."""
    parts = F.greatest(F.lit(1), F.ceil(mean / F.lit(PART_MEAN))).cast("int")
    each = mean / parts
    # Twelve standard deviations and thirty more leave less mass than the last bit of a draw.
    last = F.ceil(each + 12 * F.sqrt(each) + 30).cast("int")

    def invert(part: Column) -> Column:
        u = draw(part)
        state = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.lit(0).alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * each / k
            return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"),
                            (s["n"] + F.when(u >= s["cdf"], 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), last), state, step, lambda s: s["n"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), invert), F.lit(0), lambda a, b: a + b)


def mix(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 17,
        doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Replicate documents so that sources meet their target weights in expectation, in a global random order.

    `weights` has (source, weight). A source with weight w of W gets the rate total * w / W / its rows; `total` is the
    number of rows wanted, by default as many as come in. Each row is repeated as often as a Poisson draw with that mean
    says, the draw being a hash of (seed, doc_id). Returns all columns with `copy` (from 1) and `shuffle_key`, ordered by
    the key; columns of these names are replaced.

    A null source is a source of its own. Sources without a positive weight get no copies. Rows with a null or repeated
    id share the draw of that id. Empty texts count like others. An empty table gives an empty one.
    """
    base = docs.drop("copy", "shuffle_key")
    counts = settle(base.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__n")))
    rates = counts.join(weights.select(F.col("source").alias("__of"), F.col("weight").cast("double").alias("__w")),
                        F.col("__source").eqNullSafe(F.col("__of")), "left")
    rates = settle(rates.select("__source", "__n", F.greatest(F.coalesce("__w", F.lit(0.0)), F.lit(0.0)).alias("__w")))
    whole = rates.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n")).alias("whole")
    if total is None:
        wanted = whole.select(F.col("n").cast("double") / F.col("w")).scalar()
    else:
        wanted = whole.select(F.lit(float(total)) / F.col("w")).scalar()
    rates = small_side(rates.where("__w > 0").select("__source", (wanted * F.col("__w") / F.col("__n")).alias("__rate")))
    drawn = base.join(rates, base[source].eqNullSafe(rates["__source"])).withColumn(
        "__copies", poisson(F.col("__rate"), lambda part: uniform(seed, "poisson", F.col(doc_id), part)))
    copies = (drawn.where("__copies > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
              .drop("__source", "__rate", "__copies"))
    keyed = copies.withColumn("shuffle_key", F.floor(uniform(seed, "shuffle", F.col(doc_id), F.col("copy")) * F.lit(2.0**48)).cast("long"))
    return keyed.orderBy("shuffle_key", doc_id, "copy")

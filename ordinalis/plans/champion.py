"""The champion from split to alerts: response-biased training rows, table and text features, search, refit, evaluation on all
four splits with intervals, calibration, and the recalibrated champion under monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.functions.scalar import argmax3, class_code
from ordinalis.operators import bootstrap as bs
from ordinalis.operators import calibration as cal
from ordinalis.operators import encoding, features, models, monitor, sampling, search
from ordinalis.operators import fairness as fair
from ordinalis.operators.prep import c
from ordinalis.plans.ordering import _PF, _PROP, _WOR, _naive_sql
from ordinalis.plans.prep import DATASET, KEY, dataset
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import sql, table
from ordinalis.session import settle, small_side, store_root
from ordinalis.sources.store import Store, rows_digest

BUDGETS = {"boosted": 50, "logistic": 30, "ordinal": 20}
FEATURE_SPACES = ["tabular", "concat", "pca32"]
COMPONENTS = 32
REPLICATES = 1000
BATCHES = 12
SEGMENTS = ["Gender", "Senior Citizen", "Contract"]


def base_rows(spark, sf):
    """All columns with derived features, the class code, the response-biased split and the text vector (zero where there is none)."""
    raw = settle(features.derive_all(dataset(spark, sf)))
    rows = raw.select(c(KEY).alias("id"), *[c(x) for x in raw.columns if x != KEY and not x.startswith("NPS_")],
                      class_code(c("NPS_alternative")).alias("y"))
    split = sampling.response_biased_split(raw, KEY, "NPS_alternative").withColumnRenamed(KEY, "id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.join(split, "id").join(vectors, "id", "left")


def feature_rows(base):
    """(id, split, y, tabular, concat, pca32, segments); encoder and components see training rows only."""
    columns = [x for x in base.columns if x not in ("id", "y", "split", "embedding")]
    is_train = "split = 'train'"
    plan = encoding.classify_columns(base, columns)
    segments = base.select("id", *[c(x) for x in SEGMENTS])
    coded = settle(encoding.encode_ordinals(base, plan["ordinal"], base.filter(is_train)))
    encoder = encoding.feature_pipeline(plan, "tabular").fit(coded.filter(is_train))
    rows = encoder.transform(coded).select("id", "split", "y", "tabular", "embedding")
    vectors = rows.filter("embedding IS NOT NULL").select("id", "embedding")
    rows = settle(models.with_text(rows.drop("embedding"), vectors, "id", name="text_vector"))
    pca = models.fit_pca(rows.filter(is_train), "text_vector", COMPONENTS, "components")
    rows = models.concat_features(rows, ["tabular", "text_vector"], "concat")
    rows = models.concat_features(pca.transform(rows), ["tabular", "components"], "pca32")
    return rows.select("id", "split", "y", *FEATURE_SPACES).join(segments, "id")


def searched(spark, sf):
    """(trial log, scores of the champions), from the store where this session has searched these rows before."""
    base = settle(base_rows(spark, sf))
    store = Store(spark, store_root(spark))
    digest = f"{rows_digest(base)}-{search.recipe(BUDGETS, FEATURE_SPACES, COMPONENTS)}"
    log, scores = store.find("champion-log", digest), store.find("champion-scores", digest)
    if log is None or scores is None:
        rows = settle(feature_rows(base))
        found, best = search.halving(rows, BUDGETS, FEATURE_SPACES)
        chosen = F.concat_ws(":", "space", "model").isin(*[f"{space}:{model}" for space, (model, _) in best.items()])
        found = found.withColumn("champion", F.col("kept") & (F.col("rung") == len(search.RUNGS) - 1) & chosen)
        log = store.put("champion-log", digest, found)
        keep = rows.select("id", *[c(x) for x in SEGMENTS])
        scores = store.put("champion-scores", digest, search.score_champions(rows, best).join(keep, "id"))
    return log, scores


def _interval_rows(scores):
    return bs.bootstrap_all(scores, ["model", "split"], REPLICATES)


# --- search ----------------------------------------------------------------------------------------------------------

_SPLIT = sql(DATASET, _PF, _PROP, _WOR, 'r AS (SELECT "Customer ID", "NPS_alternative" AS y FROM wor WHERE sampled)',
             "i AS (" + _naive_sql("r", '"Customer ID"', "y", "resp", "respondent_test", "44") + ")",
             """sp AS (SELECT "Customer ID" AS id, "NPS_alternative" AS y, coalesce(split,'silent_test') AS split FROM ds LEFT JOIN i USING ("Customer ID"))""", "")
_COUNTS = "cls AS (SELECT y, count(*) AS n FROM sp WHERE split='train' GROUP BY 1)"
_SHARES = ["1/9::double", "1/3::double", "1::double"]


def _alive(space: str, budget: int, rung: int) -> int:
    """Trials of a family in a space at a rung: every third point, a third of them after each rung."""
    n = len(range(FEATURE_SPACES.index(space), budget, len(FEATURE_SPACES)))
    for _ in range(rung):
        n = -(-n // 3)
    return n


@query("champion_trials")
def champion_trials(spark, sf):
    """Every trial of every rung: feature space, family, parameters, quadratic kappa on val, and whether it went on."""
    return r6(searched(spark, sf)[0])


@query("champion_search_rules", _SPLIT.rstrip() + ", " + _COUNTS + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS space, '{m}' AS model, {r} AS rung, {_alive(s, n, r)}::bigint AS n_trials, {_alive(s, n, r + 1) if r < 2 else 1}::bigint AS n_kept, "
    f"(SELECT sum(ceil(n*({_SHARES[r]})))::bigint FROM cls) AS n_train, true AS best_kept"
    for s in FEATURE_SPACES for m, n in BUDGETS.items() for r in range(3)))
def champion_search_rules(spark, sf):
    """Trials, rows and survivors of each rung, and whether no lost trial beat a kept one."""
    log, _ = searched(spark, sf)
    value = F.coalesce("value", F.lit(-2.0))
    worst_kept = F.min(F.when(F.col("kept"), value))
    best_lost = F.max(F.when(~F.col("kept"), value))
    return log.groupBy("space", "model", "rung").agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if("kept").alias("n_kept"), F.max("n_train").alias("n_train"),
        F.coalesce(worst_kept >= best_lost, F.lit(True)).alias("best_kept"))


# --- final evaluation ------------------------------------------------------------------------------------------------

@query("final_evaluation")
def final_evaluation(spark, sf):
    """All metrics of each champion on the four splits with intervals of a thousand replicates."""
    return r6(_interval_rows(searched(spark, sf)[1]))


@query("final_evaluation_rules", _SPLIT.rstrip() + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS space, split, count(*) AS n, 0::bigint AS bad_sum, 0::bigint AS bad_class, true AS ordered FROM sp GROUP BY split" for s in FEATURE_SPACES))
def final_evaluation_rules(spark, sf):
    """Rows for each champion and split, rows whose probabilities or class are not in order, and whether each interval is."""
    scores = searched(spark, sf)[1].withColumn("space", F.substring_index("model", ":", 1))
    p = [F.col(f"p{k}") for k in range(3)]
    good = (F.abs(p[0] + p[1] + p[2] - 1) < 1e-6) & (F.least(*p) >= 0)
    counted = scores.groupBy("space", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_sum"),
        F.count_if(~F.coalesce(F.col("yp") == argmax3(*p), F.lit(False))).alias("bad_class"))
    order = _interval_rows(scores.drop("space")).groupBy(F.substring_index("model", ":", 1).alias("space"), "split").agg(
        F.bool_and(F.coalesce(F.col("ci_lo") <= F.col("ci_hi"), F.lit(False))).alias("ordered"))
    return counted.join(order, ["space", "split"])


@query("final_calibration")
def final_calibration(spark, sf):
    """Brier and ECE per class on the silent split, before and after monotone recalibration on val."""
    return r6(cal.recalibration_audit(settle(recalibrated(searched(spark, sf)[1])), ["model"]))


# --- the champion under monitoring -----------------------------------------------------------------------------------

def recalibrated(scores):
    """Silent rows of each champion with q0..q2 from maps fitted on its own val rows."""
    out = None
    for model in [r[0] for r in scores.select("model").distinct().orderBy("model").collect()]:  # one name a feature space
        mine = scores.filter(F.col("model") == model)
        part = models.isotonic_recalibrate(mine.filter("split = 'val'"), mine.filter("split = 'silent_test'"))
        out = part if out is None else out.unionByName(part)
    return out


@query("champion_alerts")
def champion_alerts(spark, sf):
    """Recalibrated champions over arriving batches of silent rows: KPIs, bands of the whole split, status and severity."""
    scores = settle(recalibrated(searched(spark, sf)[1]))
    live = scores.withColumn("p0", F.col("q0")).select("id", "model", "split", "y", "yp", "p0", *[c(x) for x in SEGMENTS])
    batches = sampling.fifo_batches(live.select("id").distinct(), "id", BATCHES)
    live = settle(live.join(batches, "id"))
    keys = ["model", "segment", "group"]
    cells = small_side(fair.group_counts(live, SEGMENTS, ["model"]))
    own = bs.group_bootstrap(cells, bs.multinomial_counts(cells, keys, REPLICATES), keys)
    kpis = monitor.batch_kpis(live).unionByName(monitor.batch_segment_recall(live, SEGMENTS))
    return r6(monitor.alert_table(kpis, own, _interval_rows(live)))

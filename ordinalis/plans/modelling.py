"""Queries that train, tune, recalibrate, score and explain models on the customer table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ordinalis.functions.scalar import class_code
from ordinalis.operators import calibration as cal
from ordinalis.operators import encoding, explain, features, models, ranking, sampling
from ordinalis.operators.evaluation import hybrid_modes
from ordinalis.operators.prep import c
from ordinalis.plans.evaluation import AUDIT, MODES
from ordinalis.plans.ordering import _naive_sql
from ordinalis.plans.prep import DATASET, KEY, dataset
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import LONG, scored_long, sql, table
from ordinalis.session import scratch_path, settle

PLAN = {"numeric": ["Age", "Tenure Months", "Monthly Charges", "Total Charges", "Number of Referrals", "n_services", "n_addons"],
        "onehot": ["Gender", "Senior Citizen", "Married", "Contract", "Payment Method", "Internet Type", "tenure_bucket"],
        "ordinal": []}
PROTECTED = ["Senior Citizen", "Gender", "Married"]


def raw_rows(spark, sf):
    """Modelling table with both targets and a stratified 60/20/20 split."""
    base = features.derive_all(dataset(spark, sf))
    rows = base.select(c(KEY).alias("id"), *[c(x) for x in PLAN["numeric"] + PLAN["onehot"]],
                       class_code(c("NPS_alternative")).alias("y"), class_code(c("NPS_baseline")).alias("y_base"))
    rows = settle(rows)
    return rows.join(sampling.naive_split(rows, "id", "y"), "id")


def encoded_rows(spark, sf):
    """(fitted encoder, feature names, settled rows with `features`); the encoder sees training rows only."""
    rows = settle(raw_rows(spark, sf))
    encoder = encoding.feature_pipeline(PLAN).fit(rows.filter("split = 'train'"))
    names = encoding.encoded_names(encoder, rows, PLAN)
    return encoder, names, settle(encoding.clean_columns(encoder.transform(rows), rows.columns))


def train_rows(rows):
    return settle(rows.filter("split = 'train'").select("features", "y"))


FAST = {"logistic": {"iterations": 50}, "ordinal": {"iterations": 50}, "boosted": {"depth": 3, "iterations": 8}}


def fit(name, rows):
    return models.FITTERS[name](train_rows(rows), **FAST[name])


def _train(key: str, name: str):
    @query(key)
    def run(spark, sf):
        _, _, rows = encoded_rows(spark, sf)
        return r6(fit(name, rows).score(rows).select("id", "split", "y", "yp", "p0", "p1", "p2"))
    return run


_train("train_logistic", "logistic")
_train("train_ordinal", "ordinal")
_train("train_boosted", "boosted")


@query("run_baselines")
def run_baselines(spark, sf):
    _, _, rows = encoded_rows(spark, sf)
    rows = rows.withColumn("y_alt", F.col("y"))
    targets = {"alternative": "y_alt", "baseline": "y_base"}
    return r6(models.run_baselines(rows, targets, params=FAST))


_NAIVE = "sp AS (" + _naive_sql("ds", '"Customer ID"', '"NPS_alternative"', "naive", "test") + ")"


@query("baseline_rules", sql(DATASET, _NAIVE, "SELECT target, model, split, count(*) AS n, true AS in_range "
       "FROM sp, (VALUES ('alternative'), ('baseline')) t(target), (VALUES ('boosted'), ('logistic'), ('ordinal')) m(model) GROUP BY ALL"))
def baseline_rules(spark, sf):
    """Each family on each target: rows of every split, and whether all metrics lie where they can."""
    out = run_baselines(spark, sf)
    shares = ["macro_f1", "balanced_acc", "recall_detractor", "recall_passive", "recall_promoter"]
    fine = [F.col(x).between(0, 1) for x in shares] + [F.col("qwk").between(-1, 1), F.col("lift_10") >= 0]
    return out.select("target", "model", "split", "n", F.coalesce(reduce(and_, fine), F.lit(False)).alias("in_range"))


@query("tune")
def tune(spark, sf):
    _, _, rows = encoded_rows(spark, sf)
    log, best = models.tune(rows, "ordinal")
    return r6(log.withColumn("is_best", F.col("params") == ", ".join(f"{k}={v}" for k, v in best.items())))


@query("trial_log")
def trial_log(spark, sf):
    _, _, rows = encoded_rows(spark, sf)
    return r6(models.tune(rows, "logistic", {"reg": [0.001, 0.1]})[0])


# --- text features -------------------------------------------------------------------------------------------------

def text_rows(spark, sf):
    _, names, rows = encoded_rows(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return names, models.with_text(rows, vectors, "id")


@query("feature_space_concat")
def feature_space_concat(spark, sf):
    names, rows = text_rows(spark, sf)
    out = models.concat_features(rows, ["features", "text_vector"])
    from pyspark.ml.functions import vector_to_array
    return out.select("id", F.size(vector_to_array("hybrid")).alias("n_features"))


@query("pca_train_only")
def pca_train_only(spark, sf):
    from pyspark.ml.functions import vector_to_array
    _, rows = text_rows(spark, sf)
    model = models.fit_pca(rows.filter("split = 'train'"), "text_vector", 8)
    return model.transform(rows).select("id", F.transform(vector_to_array("components"), lambda v: F.round(v, 6)).alias("components"))


@query("pca_loadings")
def pca_loadings(spark, sf):
    _, rows = text_rows(spark, sf)
    model = models.fit_pca(rows.filter("split = 'train'"), "text_vector", 8)
    return r6(models.pca_loadings(spark, model, 10))


# --- recalibration -------------------------------------------------------------------------------------------------

def _recalibrated(spark, sf, how):
    rows = scored_long(spark, sf).filter("model = 'C1'")
    return how(settle(rows.filter("split = 'val'")), rows.filter("split = 'silent_test'"))


# The monotone fit as the largest over starts j of the least over ends k of the mean of the points j to k, linear in between.
_ISO = ["""iv AS (SELECT k::int AS k, [p0, p1, p2][k + 1] AS p, (y = k)::int AS hit FROM scored_long, range(3) r(k) WHERE model = 'C1' AND split = 'val')""",
        "ip AS (SELECT k, p, sum(hit) AS h, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM iv GROUP BY k, p)",
        "ij AS (SELECT a.k, a.i AS j, b.i AS e, sum(b.h) OVER w / sum(b.n) OVER w AS m FROM ip a JOIN ip b ON a.k = b.k AND b.i >= a.i "
        "WINDOW w AS (PARTITION BY a.k, a.i ORDER BY b.i))",
        "il AS (SELECT k, j, e, min(m) OVER (PARTITION BY k, j ORDER BY e DESC) AS m FROM ij)",
        "fitted AS (SELECT k, e AS i, max(m) AS q FROM il GROUP BY 1, 2)",
        "pts AS (SELECT k, p AS x, q, lead(p) OVER w AS x1, lead(q) OVER w AS q1, min(q) OVER (PARTITION BY k) AS low FROM ip JOIN fitted USING (k, i) "
        "WINDOW w AS (PARTITION BY k ORDER BY p))",
        "asked AS (SELECT id, y, yp, p0, p1, p2, k::int AS k, [p0, p1, p2][k + 1] AS p FROM scored_long, range(3) r(k) WHERE model = 'C1' AND split = 'silent_test')",
        "mapped AS (SELECT a.*, CASE WHEN s.x IS NULL THEN (SELECT min(low) FROM pts z WHERE z.k = a.k) WHEN x1 IS NULL THEN q "
        "ELSE q + (q1 - q) * (p - x) / (x1 - x) END AS v FROM asked a ASOF LEFT JOIN pts s ON a.k = s.k AND a.p >= s.x)",
        "recal AS (SELECT id, any_value(y) AS y, any_value(yp) AS yp, any_value(p0) AS p0, any_value(p1) AS p1, any_value(p2) AS p2, "
        + ", ".join(f"CASE WHEN sum(v) > 0 THEN sum(v) FILTER (k = {k}) / sum(v) ELSE 1.0::double / 3 END AS q{k}" for k in range(3))
        + " FROM mapped GROUP BY id)"]


@query("isotonic_recalibrate", sql(LONG, *_ISO, "SELECT id, y, yp, " + ", ".join(f"round(q{k}, 6) AS q{k}" for k in range(3)) + " FROM recal"))
def isotonic_recalibrate(spark, sf):
    out = _recalibrated(spark, sf, models.isotonic_recalibrate)
    return r6(out.select("id", "y", "yp", "q0", "q1", "q2"))


@query("platt_recalibrate")
def platt_recalibrate(spark, sf):
    out = _recalibrated(spark, sf, models.platt_recalibrate)
    return r6(out.select("id", "y", "yp", "q0", "q1", "q2"))


_RECAL = "pair AS (SELECT *, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS yq FROM recal)"


@query("recalibration_report", sql(LONG, *_ISO, _RECAL, *AUDIT))
def recalibration_report(spark, sf):
    """Brier / ECE before and after isotonic recalibration of the scored orders."""
    out = settle(_recalibrated(spark, sf, models.isotonic_recalibrate).select("id", "y", "yp", "p0", "p1", "p2", "q0", "q1", "q2"))
    return r6(cal.recalibration_audit(out, []))


@query("recalibration_modes", sql(LONG, *_ISO, _RECAL, *MODES))
def recalibration_modes(spark, sf):
    """Headline metrics of the three prediction modes after isotonic recalibration."""
    out = settle(_recalibrated(spark, sf, models.isotonic_recalibrate).select("id", "y", "yp", "p0", "q0", "q1", "q2"))
    return r6(hybrid_modes(cal.with_calibrated_argmax(out)))


# --- scoring -------------------------------------------------------------------------------------------------------

@query("batch_score")
def batch_score(spark, sf):
    """Two saved models score the held-out rows: probabilities, classes, ranks, agreement and display columns."""
    _, _, rows = encoded_rows(spark, sf)
    held = rows.filter("split = 'test'")
    out = held.select("id", "y", *[c(x) for x in PROTECTED + ["Contract", "Tenure Months"]])
    for label, name in (("C1", "ordinal"), ("C2", "logistic")):
        path = scratch_path(spark, f"model-{name}")
        fit(name, rows).save(path)
        part = models.load_model(spark, path).score(held).select(
            "id", *[F.col(f"p{k}").alias(f"p{k}_{label}") for k in range(3)], F.col("yp").alias(f"yp_{label}"))
        for k, cls in ((0, "detractor"), (2, "promoter")):
            part = ranking.min_rank(part, [], f"p{k}_{label}", f"rank_{label}_{cls}")
        out = out.join(part, "id")
    return r6(out.withColumn("agreement", F.col("yp_C1") == F.col("yp_C2")))


@query("counterfactual_flip")
def counterfactual_flip(spark, sf):
    encoder, _, rows = encoded_rows(spark, sf)
    model = fit("logistic", rows)
    raw = rows.drop("features").filter("split = 'test'")
    predict = lambda df: model.score(encoding.clean_columns(encoder.transform(df), df.columns))
    return r6(explain.counterfactual_flip(raw, PROTECTED, predict))


# --- explanations on trained models --------------------------------------------------------------------------------

@query("global_importance")
def global_importance(spark, sf):
    _, names, rows = encoded_rows(spark, sf)
    model = fit("boosted", rows)
    return r6(explain.permutation_importance(model.score, rows.filter("split = 'test'"), names))


@query("segment_importance")
def segment_importance(spark, sf):
    _, names, rows = encoded_rows(spark, sf)
    model = fit("boosted", rows)
    return r6(explain.segment_permutation(model.score, rows.filter("split = 'test'"), names, PROTECTED))


@query("linear_model_importance")
def linear_model_importance(spark, sf):
    _, names, rows = encoded_rows(spark, sf)
    model = fit("logistic", rows)
    coef = explain.coefficient_table(spark, model.stages[0].coefficientMatrix.toArray(), names)
    return r6(explain.linear_importance(coef, explain.feature_std(rows.filter("split = 'train'"), [])))


# --- linear attributions with coefficients derived from the data, so that SQL can follow ------------------------------
# Class k's coefficient of dimension j is the mean of the dimension over vectors with label % 3 = k.

def mean_model(spark, sf):
    e = table(spark, sf, "embeddings")
    slots = e.select((F.col("label") % 3).cast("int").alias("class_idx"), F.posexplode("embedding").alias("pos", "v"))
    coef = slots.groupBy("class_idx", "pos").agg(F.avg(F.col("v").cast("double")).alias("coef"))
    coef = coef.withColumn("feature", F.format_string("emb_%03d", "pos"))
    rows = e.select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("int").alias("yp"), (F.col("vec_id") % 4).cast("int").alias("part"),
                    F.when(F.col("label") < 5, "low").otherwise("high").alias("band"),
                    array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    return coef, rows


_SLOT = """slot AS (SELECT vec_id AS id, (label%3)::int AS yp, (vec_id%4)::varchar AS part, case when label<5 then 'low' else 'high' end AS band,
  unnest(range(0, len(embedding)))::int AS pos, unnest(embedding)::double AS v FROM embeddings),
coef AS (SELECT yp AS class_idx, pos, printf('emb_%03d', pos) AS feature, avg(v) AS coef FROM slot GROUP BY ALL)"""


@query("linear_global_importance", sql(_SLOT, "sd AS (SELECT pos, stddev_pop(v) AS std FROM slot GROUP BY 1)",
    """SELECT class_idx, feature, round(coef,6) AS coef, round(std,6) AS std, round(coef*std,6) AS coef_times_std, round(abs(coef*std),6) AS abs_coef_times_std,
    case when coef>0 then '+' when coef<0 then '−' else '0' end AS sign, row_number() OVER (PARTITION BY class_idx ORDER BY abs(coef*std) DESC, feature)::int AS rank_in_class
    FROM coef JOIN sd USING (pos)"""))
def linear_global_importance(spark, sf):
    coef, rows = mean_model(spark, sf)
    return r6(explain.linear_importance(coef, explain.feature_std(rows, [])))


@query("linear_local_contrib", sql(_SLOT, """SELECT id, class_idx, feature, round(v,6) AS feature_value, round(coef*v,6) AS contribution,
    round(abs(coef*v),6) AS abs_contribution FROM slot JOIN coef ON class_idx=yp AND coef.pos=slot.pos"""))
def linear_local_contrib(spark, sf):
    coef, rows = mean_model(spark, sf)
    return r6(explain.linear_contributions(coef, rows, "id"))


@query("linear_segment_importance", sql(_SLOT, """m AS (SELECT 'part' AS segment, part AS grp, pos, v FROM slot UNION ALL SELECT 'band', band, pos, v FROM slot),
    sd AS (SELECT segment, grp, pos, stddev_pop(v) AS std, count(*) AS n FROM m GROUP BY ALL HAVING count(*)>=20),
    a AS (SELECT segment, grp, class_idx, feature, coef, std, abs(coef*std) AS ac, n,
      row_number() OVER (PARTITION BY segment, grp, class_idx ORDER BY abs(coef*std) DESC, feature)::int AS rank FROM sd JOIN coef USING (pos))""",
    """SELECT segment, grp AS "group", class_idx, feature, round(coef,6) AS coef, round(std,6) AS std_in_group, round(ac,6) AS abs_contrib, n AS n_in_group, rank
    FROM a WHERE rank<=15"""))
def linear_segment_importance(spark, sf):
    coef, rows = mean_model(spark, sf)
    return r6(explain.linear_segment_importance(coef, rows, ["part", "band"]))


@query("waterfall_topk", sql(_SLOT, """SELECT id, class_idx, feature, round(v,6) AS feature_value, round(coef*v,6) AS contribution, round(abs(coef*v),6) AS abs_contribution
    FROM slot JOIN coef ON class_idx=yp AND coef.pos=slot.pos WHERE id=7 ORDER BY abs(coef*v) DESC, feature LIMIT 10"""))
def waterfall_topk(spark, sf):
    coef, rows = mean_model(spark, sf)
    return r6(explain.waterfall(explain.linear_contributions(coef, rows.filter("id = 7"), "id"), "id", 7))


@query("pick_archetypes", sql(LONG, """o AS (SELECT *, case y when 0 then p0 when 1 then p1 else p2 end AS pc FROM scored_long WHERE model='C1')""",
    """SELECT id, y, yp, round(pc,6) AS p_class FROM o WHERE y=yp QUALIFY row_number() OVER (PARTITION BY y ORDER BY pc DESC, id) <= 2"""))
def pick_archetypes(spark, sf):
    rows = scored_long(spark, sf).filter("model = 'C1'")
    return r6(explain.pick_archetypes(rows, 2).select("id", "y", "yp", "p_class"))

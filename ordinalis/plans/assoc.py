"""Queries on association, leak audit, cross tables and distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.constants import LEAK_COLUMNS
from ordinalis.operators import assoc
from ordinalis.plans.evaluation import _EVAL_LONG, metrics_long
from ordinalis.plans.prep import KEY, RAW_COLUMNS, _SPARK_TYPES
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import (CUSTOMERS, LABELLED, SCORED, SEG_SCORED, customers, labelled_orders, scored,
                                   sql, with_segments)

T = "Satisfaction Score"
NUM = [n for n in RAW_COLUMNS if n in _SPARK_TYPES and n != T]
CAT = [n for n in RAW_COLUMNS if n not in _SPARK_TYPES]

_NUMLONG = "nl AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, "{n}"::double AS x, "{T}"::double AS t FROM cust""" for n in NUM) + ")"
_RANKED = """rkd AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1)/2.0::double AS rx,
    rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1)/2.0::double AS rt
    FROM nl WHERE x IS NOT NULL AND t IS NOT NULL)"""
_CATLONG = "cl AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, "{n}"::varchar AS v, "{T}"::double AS t FROM cust""" for n in CAT) + ")"
_ETA = f"""eta AS (SELECT g.feature, count(v) AS n_categories, coalesce(sum(gn*(gm-m)*(gm-m)) FILTER (v IS NOT NULL),0)/max(ss) AS eta_squared,
    count(v)=max(n) AS is_key_like FROM (SELECT feature, v, count(t) AS gn, avg(t) AS gm FROM cl GROUP BY ALL) g,
    (SELECT avg("{T}") AS m, var_pop("{T}")*count("{T}") AS ss, count("{T}") AS n FROM cust) GROUP BY 1)"""


@query("pearson_audit", sql(CUSTOMERS, _NUMLONG, "SELECT feature, round(corr(x,t),6) AS pearson_r FROM nl GROUP BY 1"))
def pearson_audit(spark, sf):
    return r6(assoc.pearson(customers(spark, sf), NUM, T))


@query("spearman_audit", sql(CUSTOMERS, _NUMLONG, _RANKED, "SELECT feature, round(corr(rx,rt),6) AS spearman_r FROM rkd GROUP BY 1"))
def spearman_audit(spark, sf):
    return r6(assoc.spearman(customers(spark, sf), NUM, T))


@query("eta_squared", sql(CUSTOMERS, _CATLONG, _ETA, "SELECT * REPLACE (round(eta_squared,6) AS eta_squared) FROM eta"))
def eta_squared(spark, sf):
    return r6(assoc.eta_squared(customers(spark, sf), CAT, T))


_LISTED = ", ".join(f"'{x}'" for x in LEAK_COLUMNS)
_AUDIT = ",\n".join([CUSTOMERS, _NUMLONG, _RANKED, _CATLONG, _ETA, f"""assoc AS (
    SELECT feature, 'numeric' AS type, round(p,3) AS pearson_r, round(s,3) AS spearman_r, round(coalesce(abs(p),0),3) AS score,
      NULL::bigint AS n_categories, NULL::double AS eta_squared, NULL::boolean AS is_key_like
    FROM (SELECT feature, corr(x,t) AS p FROM nl GROUP BY 1) LEFT JOIN (SELECT feature, corr(rx,rt) AS s FROM rkd GROUP BY 1) USING (feature)
    UNION ALL SELECT feature, 'categorical', NULL, NULL, round(eta_squared,3), n_categories, round(eta_squared,3), is_key_like FROM eta),
audit AS (SELECT *, feature IN ({_LISTED}) AS in_drop_list, case when feature IN ({_LISTED}) then 'CONFIGURED' when score>=0.5::double then 'STRONG LEAK'
    when score>=0.3::double then 'WEAK LEAK' else 'CLEAN' end AS verdict FROM assoc)"""])


@query("leak_audit", sql(_AUDIT, "SELECT * FROM audit"))
def leak_audit(spark, sf):
    return assoc.leak_audit(customers(spark, sf), T)


@query("leak_summary", sql(_AUDIT, """s AS (SELECT v, count(feature) AS n, list(feature ORDER BY feature) FILTER (feature IS NOT NULL) AS f
    FROM (VALUES ('STRONG LEAK'),('WEAK LEAK'),('CONFIGURED'),('CLEAN')) t(v) LEFT JOIN audit ON verdict=v GROUP BY 1
    UNION ALL SELECT 'CONFIGURED BUT MILD', count(*), list(feature ORDER BY feature) FROM audit WHERE in_drop_list AND score<0.3::double)""",
    "SELECT v AS verdict, n, coalesce(array_to_string(f, ', '), '') AS features FROM s"))
def leak_summary(spark, sf):
    table = assoc.leak_summary(assoc.leak_audit(customers(spark, sf), T))
    return table.withColumn("features", F.array_join("features", ", "))


@query("class_distribution", sql(SCORED, "SELECT y AS class, count(*) AS n, round(count(*)/(SELECT count(*) FROM scored)::double,6) AS share FROM scored GROUP BY 1"))
def class_distribution(spark, sf):
    return r6(assoc.class_distribution(labelled_orders(spark, sf), "y"))


@query("crosstab_margins", sql(LABELLED, """SELECT case when grouping(y_base)=1 then 'All' else y_base::varchar end AS a,
    case when grouping(y)=1 then 'All' else y::varchar end AS b, count(*) AS n FROM labelled GROUP BY CUBE (y_base, y)"""))
def crosstab_margins(spark, sf):
    return assoc.crosstab_margins(labelled_orders(spark, sf), "y_base", "y")


@query("crosstab_rownorm", sql(SEG_SCORED, "SELECT mktsegment AS category, " + ", ".join(
    f"round(count(*) FILTER (y={k})/count(y)::double,6) AS share_{k}" for k in range(3)) + " FROM seg_scored GROUP BY 1"))
def crosstab_rownorm(spark, sf):
    return r6(assoc.crosstab_rownorm(with_segments(spark, sf, scored(spark, sf)), "mktsegment", "y"))


@query("group_mean_count", sql(SEG_SCORED, "SELECT region AS category, round(avg(sat),6) AS mean, count(sat) AS n FROM seg_scored GROUP BY 1"))
def group_mean_count(spark, sf):
    return r6(assoc.group_mean(with_segments(spark, sf, scored(spark, sf)), "region", "sat"))


_FIVE_COLS = ["Tenure Months", "Monthly Charges", "Age"]


@query("five_number_by_class", sql(CUSTOMERS, "l AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", "{T}" AS class, "{n}"::double AS x FROM cust""" for n in _FIVE_COLS) + ")",
    """SELECT "column", class, round(min(x),6) AS min, round(quantile_cont(x,0.25),6) AS q1, round(quantile_cont(x,0.5),6) AS median,
    round(quantile_cont(x,0.75),6) AS q3, round(max(x),6) AS max FROM l WHERE x IS NOT NULL GROUP BY ALL"""))
def five_number_by_class(spark, sf):
    return r6(assoc.five_numbers(customers(spark, sf), _FIVE_COLS, T))


@query("histogram_by_class", sql(CUSTOMERS, f"""SELECT "{T}" AS class, least(20, floor("Tenure Months"/4.0::double)::bigint + 1) AS bin, count(*) AS n
    FROM cust WHERE "Tenure Months" BETWEEN 0 AND 80 GROUP BY ALL"""))
def histogram_by_class(spark, sf):
    return assoc.histogram(customers(spark, sf), "Tenure Months", T, 20, 0, 80)


@query("describe_column", sql(SCORED, """SELECT count(p0) AS count, round(avg(p0),6) AS mean, round(stddev_samp(p0),6) AS std, round(min(p0),6) AS min,
    round(quantile_cont(p0,0.25),6) AS q1, round(quantile_cont(p0,0.5),6) AS median, round(quantile_cont(p0,0.75),6) AS q3, round(max(p0),6) AS max FROM scored"""))
def describe_column(spark, sf):
    return r6(assoc.describe(scored(spark, sf), "p0"))


def split_customers(spark, sf):
    raw = customers(spark, sf).select(F.col(KEY).alias("id"), "Tenure Months", "Age", "Contract", "Payment Method", "Monthly Charges", T)
    return raw.join(labelled_orders(spark, sf).select("id", "split"), "id").withColumn(
        "y", F.when(F.col(T) <= 2, 0).when(F.col(T) <= 4, 1).otherwise(2))


_SPLITCUST = ",\n".join([CUSTOMERS, LABELLED, f"""sc AS (SELECT c.*, split, case when "{T}"<=2 then 0 when "{T}"<=4 then 1 else 2 end AS y
    FROM cust c JOIN labelled ON "Customer ID"=id)"""])


@query("summarize_split", sql(_SPLITCUST, "SELECT split, count(*) AS n, round(100*count(*)/(SELECT count(*) FROM sc)::double,1) AS pct, " + ", ".join(
    f"round(100*count(*) FILTER (y={k})/count(y)::double,1) AS pct_{k}" for k in range(3))
    + """, round(avg("Tenure Months"),1) AS mean_tenure, round(avg("Age"),1) AS mean_age FROM sc GROUP BY 1"""))
def summarize_split(spark, sf):
    return assoc.summarize_splits(split_customers(spark, sf), "y", {"mean_tenure": "Tenure Months", "mean_age": "Age"})


_SHIFT_NUM, _SHIFT_CAT = ["Tenure Months", "Monthly Charges", "Age"], ["Contract", "Payment Method"]
_SHIFT = [_SPLITCUST, "sx AS (SELECT *, split <> 'silent_test' AS r FROM sc)",
    "a AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, NULL AS level, avg("{n}") FILTER (r) AS respondents,
    avg("{n}") FILTER (NOT r) AS silent FROM sx""" for n in _SHIFT_NUM) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{n}', m, count(*) FILTER (r AND "{n}"=m)/(count(*) FILTER (r))::double, count(*) FILTER (NOT r AND "{n}"=m)/(count(*) FILTER (NOT r))::double
    FROM sx, (SELECT "{n}" AS m FROM sx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY m""" for n in _SHIFT_CAT) + ")",
    """SELECT feature, level, round(respondents,6) AS respondents, round(silent,6) AS silent, round(respondents-silent,6) AS difference,
    round((respondents-silent)*100/silent,6) AS relative_pct FROM a"""]


@query("shift_table", sql(*_SHIFT))
def shift_table(spark, sf):
    return r6(assoc.shift_table(split_customers(spark, sf), F.col("split") != "silent_test", _SHIFT_NUM, _SHIFT_CAT))


@query("metric_pivot", sql(_EVAL_LONG, "SELECT model, " + ", ".join(
    f"round(avg(value) FILTER (split='{s}'),6) AS {s}" for s in ("train", "val", "respondent_test", "silent_test"))
    + " FROM el WHERE metric='qwk' GROUP BY 1"))
def metric_pivot(spark, sf):
    return r6(assoc.metric_pivot(metrics_long(spark, sf), ["model"], "split", ["train", "val", "respondent_test", "silent_test"], "qwk"))


@query("best_by_mean", sql(_EVAL_LONG, "SELECT model, round(avg(value),6) AS mean FROM el WHERE metric='qwk' GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 1"))
def best_by_mean(spark, sf):
    return r6(assoc.best_by_mean(metrics_long(spark, sf), "model", "qwk"))


@query("distinct_count", sql(CUSTOMERS, " UNION ALL ".join(f"""SELECT '{n}' AS "column", count(DISTINCT "{n}") AS n_unique FROM cust""" for n in CAT)))
def distinct_count(spark, sf):
    return assoc.distinct_counts(customers(spark, sf), CAT)

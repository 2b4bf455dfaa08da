"""Queries on ranks, batches, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.functions.scalar import alert_status
from ordinalis.operators import ranking, sampling, windows
from ordinalis.plans.prep import DATASET, KEY, dataset
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import LABELLED, LONG, SCORED, labelled_orders, scored, scored_long, sql, table, u_sql


@query("rank_min_desc", sql(LONG, """SELECT model, id, rank() OVER (PARTITION BY model ORDER BY p0 DESC) AS rank_detractor,
    rank() OVER (PARTITION BY model ORDER BY p2 DESC) AS rank_promoter FROM scored_long"""))
def rank_min_desc(spark, sf):
    rows = scored_long(spark, sf).select("model", "id", "p0", "p2")
    out = ranking.min_rank(rows, ["model"], "p0", "rank_detractor")
    return ranking.min_rank(out, ["model"], "p2", "rank_promoter").drop("p0", "p2")


_BRANDS = """b AS (SELECT p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY ALL)"""


def brands(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("rank_first_in_class", sql(_BRANDS, "SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand)::int AS rank_in_class FROM b"))
def rank_first_in_class(spark, sf):
    return windows.rank_first(brands(spark, sf), ["p_type"], "n", "p_brand")


@query("topk_per_group", sql(_BRANDS, """SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand)::int AS rank FROM b
    QUALIFY rank <= 3"""))
def topk_per_group(spark, sf):
    return ranking.top_k_per_group(brands(spark, sf), ["p_type"], [F.col("n").desc(), F.col("p_brand").asc()], 3)


@query("topk_global", sql(SCORED, "SELECT id, round(scored.p0,6) AS p0 FROM scored ORDER BY scored.p0 DESC, id LIMIT 25"))
def topk_global(spark, sf):
    return r6(ranking.top_k(scored(spark, sf).select("id", "p0"), [F.col("p0").desc(), F.col("id").asc()], 25))


_MONTHLY = """mo AS (SELECT status, (year(ts)*12+month(ts))::int AS number, avg((y=yp)::int) AS value FROM scored GROUP BY ALL)"""


def monthly(spark, sf):
    number = (F.year("ts") * 12 + F.month("ts")).cast("int").alias("number")
    return scored(spark, sf).groupBy("status", number).agg(F.avg((F.col("y") == F.col("yp")).cast("int")).alias("value"))


@query("best_so_far", sql(SCORED, _MONTHLY, """SELECT status, number, round(value,6) AS value,
    round(max(value) OVER (PARTITION BY status ORDER BY number ROWS UNBOUNDED PRECEDING),6) AS best FROM mo"""))
def best_so_far(spark, sf):
    return r6(windows.best_so_far(monthly(spark, sf), ["status"], "number", "value"))


@query("escalate_status", sql(SCORED, _MONTHLY, """st AS (SELECT *, case when value<0.68::double then 'drift_low' when value>0.74::double then 'drift_high' else 'in_band' end AS s FROM mo),
    lg AS (SELECT *, lag(s) OVER (PARTITION BY status ORDER BY number) AS prev FROM st)""",
    """SELECT status AS cell, number, s AS status, case when s='in_band' then 'ok' when prev=s then 'alert' else 'warn' end AS severity FROM lg"""))
def escalate_status(spark, sf):
    st = monthly(spark, sf).select(F.col("status").alias("cell"), "number",
                                   alert_status(F.col("value"), F.lit(0.68), F.lit(0.74)).alias("status"))
    return windows.escalate(st, ["cell"], "number")


@query("fifo_batches", sql("""SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey)-1)//ceil(count(*) OVER ()/12.0)::bigint + 1)::int AS batch_id FROM orders"""))
def fifo_batches(spark, sf):
    return sampling.fifo_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# --- splits and samples ----------------------------------------------------------------------------------------------

_Z = lambda c: f'(case when coalesce(stddev_samp("{c}") OVER (),0)=0 then 0.0::double else ("{c}"-avg("{c}") OVER ())/stddev_samp("{c}") OVER () end)'


@query("zscore", sql(DATASET, f'SELECT "Customer ID", round({_Z("Tenure Months")},6) AS z FROM ds'))
def zscore(spark, sf):
    df = dataset(spark, sf)
    return r6(df.select(KEY, sampling.zscore(df, "Tenure Months").alias("z")))


_PF = f"""pf AS (SELECT "Customer ID", "NPS_alternative", {_Z("Tenure Months")} AS tenure, ("Paperless Billing"='Yes')::int::double AS paperless_billing,
    contains(lower("Payment Method"),'automatic')::int::double AS autopay, {_Z("Age")} AS age, ("Contract"='Month-to-month')::int::double AS month_to_month FROM ds)"""
_PFC = ["tenure", "paperless_billing", "autopay", "age", "month_to_month"]
_ID = '"Customer ID"::varchar'
_PROP = f"""pr AS (SELECT *, 1/(1+exp(-(1.5*tenure+0.7*paperless_billing+0.6*autopay+0.3*age-0.5*month_to_month
    + 0.5*sqrt(-2*ln(1-{u_sql('propa', _ID)}))*cos(2*pi()*{u_sql('propb', _ID)})))) AS propensity FROM pf)"""


@query("propensity_features", sql(DATASET, _PF, 'SELECT "Customer ID", ' + ", ".join(f"round({c},6) AS {c}" for c in _PFC) + " FROM pf"))
def propensity_features(spark, sf):
    df = dataset(spark, sf)
    return r6(df.select(KEY, *[e.alias(n) for n, e in sampling.propensity_features(df).items()]))


@query("response_propensity", sql(DATASET, _PF, _PROP, 'SELECT "Customer ID", round(propensity,6) AS propensity FROM pr'))
def response_propensity(spark, sf):
    df = dataset(spark, sf)
    return r6(df.select(KEY, sampling.response_propensity(df, KEY).alias("propensity")))


def _naive_sql(source: str, key: str, label: str, tag: str, last: str, seed: str = "42") -> str:
    return f"""SELECT {key}, case when rn <= tr then 'train' when rn <= tr + round_even(n*0.2::double,0) then 'val' else '{last}' end AS split
    FROM (SELECT {key}, row_number() OVER (PARTITION BY {label} ORDER BY {u_sql(tag, key + '::varchar', seed)}, {key}) AS rn,
      count(*) OVER (PARTITION BY {label}) AS n, round_even(count(*) OVER (PARTITION BY {label})*0.6::double,0) AS tr FROM {source})"""


@query("naive_split", sql(LABELLED, _naive_sql("labelled", "id", "y", "naive", "test")))
def naive_split(spark, sf):
    return sampling.naive_split(labelled_orders(spark, sf), "id", "y")


_WOR = f"""wor AS (SELECT *, row_number() OVER (ORDER BY -ln(1-{u_sql('wor', _ID, '43')})/propensity, "Customer ID")
    <= round_even(0.15::double*count(*) OVER (),0) AS sampled FROM pr)"""


@query("weighted_sample_wor", sql(DATASET, _PF, _PROP, _WOR, 'SELECT "Customer ID", sampled FROM wor'))
def weighted_sample_wor(spark, sf):
    df = dataset(spark, sf)
    return sampling.weighted_sample(df, KEY, sampling.response_propensity(df, KEY), 0.15, 43)


@query("response_biased_split", sql(DATASET, _PF, _PROP, _WOR, 'r AS (SELECT "Customer ID", "NPS_alternative" AS y FROM wor WHERE sampled)',
    "i AS (" + _naive_sql("r", '"Customer ID"', "y", "resp", "respondent_test", "44") + ")",
    """SELECT "Customer ID", coalesce(split,'silent_test') AS split FROM ds LEFT JOIN i USING ("Customer ID")"""))
def response_biased_split(spark, sf):
    return sampling.response_biased_split(dataset(spark, sf), KEY, "NPS_alternative")


@query("stratified_sample_n", sql(LABELLED, f"""SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {u_sql('strat', 'id::varchar')}, id) AS rn,
    count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS t FROM labelled)
    WHERE rn <= least(n, greatest(1, round_even(1000.0::double*n/t, 0)))"""))
def stratified_sample_n(spark, sf):
    return sampling.stratified_sample(labelled_orders(spark, sf), "id", "y", 1000)


@query("sample_per_class", sql(LABELLED, f"SELECT id, y FROM labelled QUALIFY row_number() OVER (PARTITION BY y ORDER BY {u_sql('class', 'id::varchar')}, id) <= 3"))
def sample_per_class(spark, sf):
    return sampling.sample_per_class(labelled_orders(spark, sf), "id", "y", 3).select("id", "y")


@query("simple_sample_n", sql(LABELLED, f"SELECT id, y FROM labelled ORDER BY {u_sql('simple', 'id::varchar')}, id LIMIT 500"))
def simple_sample_n(spark, sf):
    return sampling.simple_sample(labelled_orders(spark, sf), "id", 500).select("id", "y")


@query("bernoulli_flag", sql(LABELLED, f"SELECT id, {u_sql('ci', 'id::varchar')} < 0.15::double AS counter_intuitive FROM labelled"))
def bernoulli_flag(spark, sf):
    return labelled_orders(spark, sf).select("id", sampling.bernoulli("id").alias("counter_intuitive"))

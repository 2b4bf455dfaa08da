"""Queries on sources, sinks, data-set building and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordinalis.constants import CONSTANT_COLUMNS, LEAK_COLUMNS, SCORE_MAPS
from ordinalis.operators import prep
from ordinalis.operators import ranking, sampling
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import (CUSTOMERS, LABELLED, LONG, SCORED, SEG_SCORED, customers, labelled_orders, scored,
                                   scored_long, sql, table, u_sql, with_segments)
from ordinalis.session import scratch_path, store_root
from ordinalis.sources import sinks, tables
from ordinalis.sources.store import Store

KEY = "Customer ID"


def case_map(mapping: dict[int, str], col: str) -> str:
    return "case " + col + " " + " ".join(f"when {k} then '{v}'" for k, v in mapping.items()) + " end"


SAT = '"Satisfaction Score"'
TARGETS_SQL = ", ".join(f'{case_map(m, SAT)} AS "NPS_{n}"' for n, m in SCORE_MAPS.items())
RAW_COLUMNS = ["Customer ID", "Gender", "Senior Citizen", "Married", "Age", "Tenure Months", "Monthly Charges",
               "Total Charges", "Phone Service", "Multiple Lines", "Internet Service", "Internet Type", "Online Security",
               "Online Backup", "Device Protection", "Tech Support", "Streaming TV", "Streaming Movies",
               "Paperless Billing", "Payment Method", "Contract", "Offer", "Number of Referrals", "Total Refunds",
               "Total Extra Data Charges", "Population", "Zip Code", "City", "CLTV", "Customer Status", "Quarter",
               "Satisfaction Score"]
DATASET = CUSTOMERS + f""",
ds AS (SELECT * EXCLUDE ("Satisfaction Score", "CLTV", "Customer Status", "Quarter") REPLACE (
    coalesce("Total Charges", coalesce("Tenure Months",0)*coalesce("Monthly Charges",0)) AS "Total Charges",
    coalesce("Internet Type", 'None') AS "Internet Type"), {TARGETS_SQL} FROM cust)"""
ALIASED = {"Customer ID": "customerID", "Tenure Months": " Tenure in Months ", "Monthly Charges": "Monthly Charge",
           "Tech Support": "Premium Tech Support", "Device Protection": "Device Protection Plan"}


def dataset(spark, sf):
    return prep.build_dataset(customers(spark, sf))


def raw_tables(spark, sf):
    """The customer table cut into topic tables that share columns, plus the place-keyed population."""
    wide = customers(spark, sf)
    place = wide.select("Zip Code", "Population").distinct()
    demographics = wide.select(KEY, "Gender", "Senior Citizen", "Married", "Age", "Zip Code")
    services = wide.select(KEY, "Gender", "Tenure Months", "Contract", "Offer", "Phone Service", "Internet Service", "Internet Type")
    status = wide.select(KEY, "Satisfaction Score", "CLTV", "Contract")
    orphan = table(spark, sf, "region")
    return {"demographics": demographics, "services": services, "status": status, "population": place, "orphan": orphan}


_MERGED = ["Customer ID", "Gender", "Senior Citizen", "Married", "Age", "Zip Code", "Tenure Months", "Contract", "Offer",
           "Phone Service", "Internet Service", "Internet Type", "Satisfaction Score", "CLTV", "Population"]


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


# --- sources and sinks -------------------------------------------------------------------------------------------

_GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("scan_layout", " UNION ALL ".join(
    f"SELECT '{t}' AS name, 'parquet' AS format, 'multi' AS layout, true AS used, count(*) AS n_rows FROM {t}" for t in _GIVEN))
def scan_layout(spark, sf):
    return tables.scan_contents(spark, sf).select("name", "format", "layout", "used", "n_rows")


@query("merge_new_columns", sql(CUSTOMERS, f"SELECT {quoted(_MERGED)} FROM cust"))
def merge_new_columns(spark, sf):
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return tables.merge_tables(raw_tables(spark, sf), KEY, "Zip Code")


@query("merge_multisheet", sql(CUSTOMERS, f"SELECT {quoted([m for m in _MERGED if m != 'Population'])} FROM cust"))
def merge_multisheet(spark, sf):
    t = raw_tables(spark, sf)
    return tables.merge_sheets([t["orphan"], t["demographics"], t["services"], t["status"]], KEY)


@query("normalize_columns", sql(CUSTOMERS, f"SELECT {quoted(RAW_COLUMNS)} FROM cust"))
def normalize_columns(spark, sf):
    return tables.normalize_columns(customers(spark, sf).withColumnsRenamed(ALIASED))


@query("require_columns", sql(CUSTOMERS, 'SELECT "Customer ID", "Satisfaction Score" FROM cust'))
def require_columns(spark, sf):
    return tables.require_columns(customers(spark, sf), ["Satisfaction Score"]).select(KEY, "Satisfaction Score")


_MESSY = "case when o_orderkey % 7 = 0 then ' ' when o_orderkey % 11 = 0 then 'n/a' else o_orderkey::varchar || '.5' end"


@query("coerce_numeric", sql(f"SELECT o_orderkey, try_cast({_MESSY} AS double) AS charges FROM orders"))
def coerce_numeric(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, " ").when(k % 11 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return tables.coerce_numeric(table(spark, sf, "orders").select("o_orderkey", text.alias("charges")), ["charges"])


_SPARK_TYPES = {"Customer ID": "bigint", "CLTV": "double", "Monthly Charges": "double", "Total Charges": "double",
                "Total Refunds": "double", "Total Extra Data Charges": "double", "Age": "int", "Tenure Months": "int",
                "Number of Referrals": "int", "Population": "int", "Satisfaction Score": "int"}
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", '{_SPARK_TYPES.get(n, "string")}' AS dtype, count(DISTINCT "{n}") AS n_unique,
    count(*) - count("{n}") AS n_null FROM cust""" for n in RAW_COLUMNS)


@query("profile_columns", sql(CUSTOMERS, _PROFILE))
def profile_columns(spark, sf):
    return prep.profile_columns(customers(spark, sf))


@query("sink_parquet", sql(LABELLED, "SELECT id, sat, y, split FROM labelled"))
def sink_parquet(spark, sf):
    rows = labelled_orders(spark, sf).select("id", "sat", "y", "split")
    return sinks.write_parquet(rows, scratch_path(spark, "labelled"), ["split"]).select("id", "sat", "y", "split")


@query("sink_csv", sql(LABELLED, "SELECT id, sat, y, split FROM labelled"))
def sink_csv(spark, sf):
    return sinks.write_csv(labelled_orders(spark, sf).select("id", "sat", "y", "split"), scratch_path(spark, "csv"))


@query("build_metadata")
def build_metadata(spark, sf):
    raw = customers(spark, sf)
    meta = prep.build_metadata(raw, prep.build_dataset(raw), ["Total Charges", "Internet Type"])
    return sinks.write_json(meta, scratch_path(spark, "metadata"))


@query("save_load_splits", sql(LABELLED, "SELECT id, split, 'hash' AS strategy FROM labelled"))
def save_load_splits(spark, sf):
    path = scratch_path(spark, "splits")
    rows = labelled_orders(spark, sf).select("id", "split")
    sinks.save_splits(rows.withColumn("split", F.lit("other")), "constant", path)
    return sinks.save_splits(rows, "hash", path)


@query("stored_splits", sql(LABELLED, """SELECT id, case when rn <= tr then 'train' when rn <= tr + round_even(n*0.2::double,0) then 'val' else 'test' end AS split
    FROM (SELECT id, row_number() OVER (PARTITION BY y ORDER BY """ + u_sql("naive", "id::varchar") + """, id) AS rn, count(*) OVER (PARTITION BY y) AS n,
    round_even(count(*) OVER (PARTITION BY y)*0.6::double,0) AS tr FROM labelled)"""))
def stored_splits(spark, sf):
    """Stratified splits drawn by the first call on these rows and read by all later ones."""
    rows = labelled_orders(spark, sf).select("id", "y")
    return sinks.stored_splits(rows, "id", "y", "naive-60-20-42", Store(spark, store_root(spark)),
                               lambda df: sampling.naive_split(df, "id", "y"))


@query("artifact_inventory", sql("""SELECT name, n_rows IS NOT NULL AS present, coalesce(n_rows,0) AS n_rows,
    coalesce(n_columns,0)::int AS n_columns FROM (VALUES ('orders'),('customer'),('nation'),('missing')) e(name)
    LEFT JOIN (SELECT 'orders' AS name, count(*) AS n_rows, 6 AS n_columns FROM orders UNION ALL
    SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'nation', count(*), 3 FROM nation) USING (name)"""))
def artifact_inventory(spark, sf):
    found = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    return sinks.inventory(spark, ["orders", "customer", "nation", "missing"], found)


# --- targets -----------------------------------------------------------------------------------------------------

@query("build_target", sql(CUSTOMERS, f'SELECT "Customer ID", {case_map(SCORE_MAPS["baseline"], SAT)} AS "NPS_baseline" FROM cust'))
def build_target(spark, sf):
    return prep.build_target(customers(spark, sf), "baseline").select(KEY, "NPS_baseline")


PARTIAL = {"partial": {1: "Detractor", 2: "Detractor", 5: "Promoter"}}


@query("unmapped_scores", sql(LABELLED, "SELECT sat AS score, count(*) AS n FROM labelled WHERE sat IN (3,4) GROUP BY 1"))
def unmapped_scores(spark, sf):
    return prep.unmapped_scores(labelled_orders(spark, sf), "partial", "sat", PARTIAL)


@query("add_all_targets", sql(CUSTOMERS, f'SELECT "Customer ID", {TARGETS_SQL} FROM cust'))
def add_all_targets(spark, sf):
    return prep.add_all_targets(customers(spark, sf)).select(KEY, "NPS_baseline", "NPS_alternative")


_SPINE = "spine AS (SELECT * FROM (VALUES ('Detractor'),('Passive'),('Promoter')) c(class))"


@query("summarise_mappings", sql(CUSTOMERS, f"t AS (SELECT {TARGETS_SQL} FROM cust)", _SPINE,
    """l AS (SELECT 'baseline' AS mapping, "NPS_baseline" AS class FROM t UNION ALL SELECT 'alternative', "NPS_alternative" FROM t)""",
    """k AS (SELECT mapping, class, count(l.class) AS n FROM (SELECT DISTINCT mapping FROM l) JOIN spine ON true
    LEFT JOIN l USING (mapping, class) GROUP BY 1, 2)""",
    "SELECT mapping, class, n, round(100*n/(sum(n) OVER (PARTITION BY mapping))::double, 1) AS pct FROM k"))
def summarise_mappings(spark, sf):
    return prep.summarise_mappings(prep.add_all_targets(customers(spark, sf)), list(SCORE_MAPS))


@query("nps_index", sql(SEG_SCORED, """SELECT region, count(y) AS n, round(100*avg((y=2)::int)-100*avg((y=0)::int),6) AS nps
    FROM seg_scored GROUP BY 1"""))
def nps_index(spark, sf):
    return r6(prep.nps_index(with_segments(spark, sf, scored(spark, sf)), "y", ["region"]))


ALT_MAPS = {
    "baseline": SCORE_MAPS["baseline"], "alternative": SCORE_MAPS["alternative"],
    "strict": {1: "Detractor", 2: "Detractor", 3: "Detractor", 4: "Detractor", 5: "Promoter"},
    "lenient": {1: "Detractor", 2: "Passive", 3: "Passive", 4: "Promoter", 5: "Promoter"}}


@query("mapping_sensitivity", sql(LABELLED, "l AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS mapping, {case_map(m, 'sat')} AS class FROM labelled" for n, m in ALT_MAPS.items()) + ")",
    "k AS (SELECT mapping, class, count(*) AS n FROM l GROUP BY 1, 2)",
    "SELECT mapping, class, n, round(100*n/(sum(n) OVER (PARTITION BY mapping))::double, 6) AS pct FROM k"))
def mapping_sensitivity(spark, sf):
    return r6(prep.mapping_sensitivity(labelled_orders(spark, sf), ALT_MAPS, "sat"))


@query("mapping_flip_count", sql(LABELLED, """SELECT count(*) AS n, count(*) FILTER (y<>y_base) AS n_flipped,
    round(100*count(*) FILTER (y<>y_base)/count(*)::double,6) AS pct_flipped FROM labelled"""))
def mapping_flip_count(spark, sf):
    return r6(prep.mapping_flips(labelled_orders(spark, sf), "y", "y_base"))


# --- imputation, dropping, checks ----------------------------------------------------------------------------------

@query("impute_product", sql(CUSTOMERS, """SELECT "Customer ID", round(coalesce("Total Charges",
    coalesce("Tenure Months",0)*coalesce("Monthly Charges",0)),6) AS "Total Charges",
    count(*) FILTER ("Total Charges" IS NULL) OVER () AS n_imputed FROM cust"""))
def impute_product(spark, sf):
    raw = customers(spark, sf)
    n = prep.imputation_report(raw, ["Total Charges"]).select("n_imputed").scalar()
    return r6(prep.impute_product(raw).select(KEY, "Total Charges", n.alias("n_imputed")))


@query("impute_category", sql(CUSTOMERS, """SELECT "Customer ID", coalesce("Internet Type",'None') AS "Internet Type",
    count(*) FILTER ("Internet Type" IS NULL) OVER () AS n_imputed FROM cust"""))
def impute_category(spark, sf):
    raw = customers(spark, sf)
    n = prep.imputation_report(raw, ["Internet Type"]).select("n_imputed").scalar()
    return prep.impute_category(raw).select(KEY, "Internet Type", n.alias("n_imputed"))


_KEPT = [x for x in RAW_COLUMNS if x not in LEAK_COLUMNS + CONSTANT_COLUMNS]


@query("drop_listed", sql(CUSTOMERS, f"SELECT {quoted(_KEPT)} FROM cust"))
def drop_listed(spark, sf):
    return prep.drop_listed(customers(spark, sf))


@query("validate_dataset", sql(DATASET, """chk AS (SELECT count(*) AS n, count(DISTINCT "Customer ID") AS k,
    count(*) FILTER ("NPS_baseline" IS NULL) AS nb, count(*) FILTER ("NPS_alternative" IS NULL) AS na,
    count(DISTINCT "NPS_baseline") AS lb, count(DISTINCT "NPS_alternative") AS la,
    count(*) FILTER ("Total Charges" IS NULL) AS nt, count(*) FILTER ("Internet Type" IS NULL) AS ni FROM ds)""",
    """SELECT 'no_leak_columns' AS "check", true AS passed, 0::bigint AS observed FROM chk
    UNION ALL SELECT 'no_constant_columns', true, 0 FROM chk UNION ALL SELECT 'unique_key', n=k, n-k FROM chk
    UNION ALL SELECT 'min_rows', n>=1000, n FROM chk UNION ALL SELECT 'min_columns', true, 30 FROM chk
    UNION ALL SELECT 'target_not_null:NPS_baseline', nb=0, nb FROM chk UNION ALL SELECT 'target_levels:NPS_baseline', lb=3, lb FROM chk
    UNION ALL SELECT 'target_not_null:NPS_alternative', na=0, na FROM chk UNION ALL SELECT 'target_levels:NPS_alternative', la=3, la FROM chk
    UNION ALL SELECT 'imputed:Total Charges', nt=0, nt FROM chk UNION ALL SELECT 'imputed:Internet Type', ni=0, ni FROM chk"""))
def validate_dataset(spark, sf):
    return prep.validate_dataset(dataset(spark, sf), min_rows=1000)


@query("missing_report", sql(CUSTOMERS, "m AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) - count("{n}") AS n_missing, count(*) AS n FROM cust""" for n in RAW_COLUMNS) + ")",
    'SELECT "column", n_missing, round(100*n_missing/n::double,6) AS pct FROM m WHERE n_missing>0'))
def missing_report(spark, sf):
    return r6(prep.missing_report(customers(spark, sf)))


@query("constant_columns", sql(CUSTOMERS, "m AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", min("{n}")::varchar AS value, count(DISTINCT "{n}") + max(("{n}" IS NULL)::int) AS u FROM cust"""
    for n in RAW_COLUMNS) + ")", 'SELECT "column", value FROM m WHERE u<=1'))
def constant_columns(spark, sf):
    return prep.constant_columns(customers(spark, sf))


@query("duplicate_keys", sql("""SELECT sum(n)::bigint AS n_rows, count(*) AS n_unique, sum(n-1)::bigint AS n_duplicates
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"""))
def duplicate_keys(spark, sf):
    return prep.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


# --- selections ----------------------------------------------------------------------------------------------------

_FEATURES = [x for x in _KEPT]


def customer_splits(spark, sf):
    """Hash splits on customer ids, reusing the order splits of the same key values."""
    return labelled_orders(spark, sf).select(F.col("id").alias(KEY), "split")


@query("get_split", sql(DATASET, LABELLED, f"""SELECT {', '.join(f'round("{x}",6) AS "{x}"' if x in ("Total Charges", "Monthly Charges") else f'"{x}"' for x in _FEATURES)},
    "NPS_alternative" AS y FROM ds WHERE "Customer ID" IN (SELECT id FROM labelled WHERE split='train')"""))
def get_split(spark, sf):
    return r6(prep.get_split(dataset(spark, sf), customer_splits(spark, sf), "train", "NPS_alternative"))


@query("split_X_y", sql(DATASET, f"""SELECT {', '.join(f'round("{x}",6) AS "{x}"' if x in ("Total Charges", "Monthly Charges") else f'"{x}"' for x in _FEATURES)},
    "NPS_baseline" AS y FROM ds"""))
def split_xy(spark, sf):
    return r6(prep.split_xy(dataset(spark, sf), "NPS_baseline"))


_TOP = 100


@query("cohort_filter", sql(SEG_SCORED, f"""SELECT id, mktsegment, status, round(p0,6) AS p0,
    round(100.0::double*(SELECT least({_TOP}, count(*)) FROM seg_scored WHERE mktsegment='BUILDING' AND status='F')/(SELECT count(*) FROM seg_scored),6) AS pct_of_population
    FROM seg_scored WHERE mktsegment='BUILDING' AND status='F' ORDER BY seg_scored.p0 DESC, id LIMIT {_TOP}"""))
def cohort_filter(spark, sf):
    rows = with_segments(spark, sf, scored(spark, sf)).select("id", "mktsegment", "status", "p0")
    return r6(prep.cohort(rows, {"mktsegment": "BUILDING", "status": "F"}, "p0", _TOP, "id"))


@query("customer_lookup", sql(SCORED, """rk AS (SELECT id, yp, p0, p2, rank() OVER (ORDER BY p0 DESC) AS rank_detractor,
    rank() OVER (ORDER BY p2 DESC) AS rank_promoter, count(*) OVER () AS n FROM scored)""",
    """SELECT id, yp, round(p0,6) AS p0, round(p2,6) AS p2, rank_detractor, rank_promoter,
    round((rank_detractor-1)/n::double,6) AS rank_detractor_pct, round((rank_promoter-1)/n::double,6) AS rank_promoter_pct
    FROM rk WHERE id=77"""))
def customer_lookup(spark, sf):
    rows = scored(spark, sf).select("id", "yp", "p0", "p2")
    ranked = ranking.min_rank(ranking.min_rank(rows, [], "p0", "rank_detractor"), [], "p2", "rank_promoter")
    return r6(prep.lookup_row(ranked, "id", 77))


# --- joins and set operations ----------------------------------------------------------------------------------------

@query("join_left_equi", sql("""SELECT c_custkey, c_mktsegment, n_name, o_orderkey FROM customer LEFT JOIN nation
    ON c_nationkey=n_nationkey LEFT JOIN orders ON o_custkey=c_custkey"""))
def join_left_equi(spark, sf):
    cust, nation, orders = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    return (cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("c_custkey", "c_mktsegment", "n_name", "o_orderkey"))


@query("join_verbatims", sql("""SELECT c_custkey, text AS verbatim, c_custkey % 7 = 0 AS counter_intuitive FROM customer
    LEFT JOIN documents ON doc_id=c_custkey"""))
def join_verbatims(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("verbatim"))
    return table(spark, sf, "customer").select("c_custkey").join(texts, "c_custkey", "left").withColumn(
        "counter_intuitive", F.col("c_custkey") % 7 == 0)


@query("coverage_anti", sql("""SELECT 'missing' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""))
def coverage_anti(spark, sf):
    return prep.coverage(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("align_semi", sql("""SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels USING (doc_id)
    WHERE doc_id IN (SELECT vec_id FROM embeddings)"""))
def align_semi(spark, sf):
    docs, labels, _ = prep.align("doc_id", table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"),
                                 table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))
    return docs.join(labels, "doc_id")


@query("concat_scores", sql(LONG, "SELECT id, " + ", ".join(
    f"round(max({v}) FILTER (model='{m}'),6) AS {v}_{m}" if v != "yp" else f"max({v}) FILTER (model='{m}') AS {v}_{m}"
    for m in ("C1", "C2") for v in ("p0", "p1", "p2", "yp")) + " FROM scored_long GROUP BY id"))
def concat_scores(spark, sf):
    return r6(prep.side_by_side(scored_long(spark, sf), "id", "model", ["C1", "C2"], ["p0", "p1", "p2", "yp"]))


@query("substitute_by_key", sql(LONG, """SELECT a.id, a.yp, round(coalesce(b.p0,a.p0),6) AS p0, round(coalesce(b.p1,a.p1),6) AS p1,
    round(coalesce(b.p2,a.p2),6) AS p2 FROM (SELECT * FROM scored_long WHERE model='C2') a
    LEFT JOIN (SELECT * FROM scored_long WHERE model='C1' AND split='silent_test') b USING (id)"""))
def substitute_by_key(spark, sf):
    both = scored_long(spark, sf)
    base = both.filter("model='C2'").select("id", "yp", "p0", "p1", "p2")
    return r6(prep.substitute(base, both.filter("model='C1' and split='silent_test'"), "id", ["p0", "p1", "p2"]))


@query("union_results", sql(LONG, """SELECT 'counts' AS src, model, count(*) AS n, NULL::double AS mean_p0 FROM scored_long GROUP BY 2
    UNION ALL SELECT 'means', model, NULL, round(avg(p0),6) FROM scored_long GROUP BY 2"""))
def union_results(spark, sf):
    rows = scored_long(spark, sf)
    a = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).withColumn("src", F.lit("counts"))
    b = rows.groupBy("model").agg(F.avg("p0").alias("mean_p0")).withColumn("src", F.lit("means"))
    return r6(prep.union_results(a, b))


def _brand_tops(spark, sf, flag):
    line = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select("l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    n = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k_per_group(n, ["p_type"], [F.col("n").desc(), F.col("p_brand").asc()], 5)


_TOPS = """cnt AS (SELECT l_returnflag AS f, p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey
    WHERE l_returnflag IN ('A','R') GROUP BY ALL),
tops AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY f, p_type ORDER BY n DESC, p_brand) <= 5)"""


@query("topn_overlap", sql(_TOPS, """j AS (SELECT coalesce(a.p_type,b.p_type) AS p_type, a.p_brand AS x, b.p_brand AS y
    FROM (SELECT * FROM tops WHERE f='A') a FULL JOIN (SELECT * FROM tops WHERE f='R') b ON a.p_type=b.p_type AND a.p_brand=b.p_brand)""",
    """SELECT p_type, count(*) FILTER (x=y) AS n_shared, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b,
    round(count(*) FILTER (x=y)/count(x)::double,6) AS overlap_rate FROM j GROUP BY 1"""))
def topn_overlap(spark, sf):
    return r6(prep.top_overlap(_brand_tops(spark, sf, "A"), _brand_tops(spark, sf, "R"), ["p_type"], "p_brand"))


@query("id_difference", sql("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"))
def id_difference(spark, sf):
    return prep.id_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")

"""Queries on derived features, encodings and text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.constants import (ADDON_COLUMNS, CLASSES, EXTRA_CHARGES, FIBER, FORBIDDEN_TERMS, NO_FRICTION, NO_SERVICES, PROMPT, REFUND,
                                 SERVICE_COLUMNS, STOPWORDS)
from ordinalis.functions.scalar import class_code, class_label, is_yes
from ordinalis.operators import encoding, features, text
from ordinalis.operators.prep import c
from ordinalis.plans.prep import DATASET, KEY, RAW_COLUMNS, customers, dataset
from ordinalis.plans.registry import query, r6
from ordinalis.plans.views import CUSTOMERS, LABELLED, labelled_orders, sql, table, u_sql
from ordinalis.session import scratch_path, settle, store_root
from ordinalis.sources.store import Store

_SERVICES = [x for x in SERVICE_COLUMNS if x in RAW_COLUMNS]
_yes = lambda n: f"""coalesce(lower(trim("{n}")) IN ('yes','y','true','1'), false)"""
_count = lambda names: "(" + "+".join(f"{_yes(n)}::int" for n in names) + ")"
FEATURES = DATASET + f""",
edges AS (SELECT quantile_cont("Population",0.25) AS q1, quantile_cont("Population",0.5) AS q2, quantile_cont("Population",0.75) AS q3 FROM ds),
feat AS (SELECT *, round(("Total Charges"/greatest(coalesce("Tenure Months",0),1))::varchar::decimal(38,15),2)::double AS avg_monthly_charge,
  round(("Monthly Charges"/greatest(n_services,1))::varchar::decimal(38,15),2)::double AS charges_per_service FROM (
  SELECT ds.*, {_count(_SERVICES)} AS n_services, {_count(ADDON_COLUMNS)} AS n_addons, ({_count(ADDON_COLUMNS)}=4)::int AS has_security_bundle,
  case when "Tenure Months">=49 then '49m+' when "Tenure Months">=25 then '25-48m' when "Tenure Months">=7 then '7-24m'
    when "Tenure Months">=0 then '0-6m' else 'unknown' end AS tenure_bucket,
  ({_yes("Paperless Billing")} AND contains(lower("Payment Method"),'automatic'))::int AS is_paperless_autopay,
  case when "Population"<=q1 then 'Q1_rural' when "Population"<=q2 then 'Q2' when "Population"<=q3 then 'Q3' else 'Q4_urban' end AS pop_density_bucket,
  (coalesce("Total Extra Data Charges",0)>0)::int AS has_extra_charges, (coalesce("Total Refunds",0)>0)::int AS has_refund,
  ("Number of Referrals">0)::int AS is_referrer, ("Offer" IS NOT NULL)::int AS received_offer FROM ds, edges))"""


def _feature(name: str, columns: list[str], step, needs=None):
    text_columns = ", ".join(f"round({x},6) AS {x}" if x in ("avg_monthly_charge", "charges_per_service") else x for x in columns)

    @query(name, sql(FEATURES, f'SELECT "Customer ID", {text_columns} FROM feat'))
    def run(spark, sf):
        base = dataset(spark, sf)
        return r6(step(needs(base) if needs else base).select(KEY, *columns))
    return run


_feature("service_bundle", ["n_services", "n_addons", "has_security_bundle"], features.service_bundle)
_feature("financial_ratios", ["avg_monthly_charge", "charges_per_service"], features.financial_ratios, features.service_bundle)
_feature("tenure_bucket", ["tenure_bucket"], features.tenure_bucket)
_feature("digital_engagement", ["is_paperless_autopay"], features.digital_engagement)
_feature("quartile_bucket", ["pop_density_bucket"], features.quartile_bucket)
_feature("friction_flags", ["has_extra_charges", "has_refund"], features.friction_flags)
_feature("referrer_flag", ["is_referrer"], features.referrer_flag)
_feature("offer_flag", ["received_offer"], features.offer_flag)
_feature("derive_all", list(features.DERIVED), lambda df: features.derive_all(features.derive_all(df)))


@query("is_yes", sql(CUSTOMERS, f'SELECT "Customer ID", {_yes("Phone Service")} AS phone, {_yes("Internet Type")} AS net FROM cust'))
def yes_flags(spark, sf):
    return customers(spark, sf).select(KEY, is_yes(c("Phone Service")).alias("phone"), is_yes(c("Internet Type")).alias("net"))


@query("flip_binary", sql(CUSTOMERS, """SELECT "Customer ID", case "Gender" when 'Male' then 'Female' else 'Male' end AS "Gender",
    "Contract" FROM cust"""))
def flip_binary(spark, sf):
    base = customers(spark, sf).select(KEY, "Gender", "Contract")
    return features.flip_binary(features.flip_binary(base, "Gender"), "Contract")


@query("label_encode", sql(DATASET, """SELECT "Customer ID", case "NPS_alternative" when 'Detractor' then 0 when 'Passive' then 1 else 2 end AS code,
    "NPS_alternative" AS label FROM ds"""))
def label_encode(spark, sf):
    coded = dataset(spark, sf).select(KEY, class_code(c("NPS_alternative")).alias("code"))
    return coded.withColumn("label", class_label(F.col("code")))


# --- encoding --------------------------------------------------------------------------------------------------------

_X = [x for x in RAW_COLUMNS if x not in ("Customer ID", "Satisfaction Score", "CLTV", "Customer Status", "Quarter")]
_NUMERIC = {"Age", "Tenure Months", "Monthly Charges", "Total Charges", "Number of Referrals", "Total Refunds",
            "Total Extra Data Charges", "Population"}
_GEO = {"Zip Code", "City"}
_PLAN = "pl AS (" + " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", '{"dropped" if x in _GEO else "numeric" if x in _NUMERIC else "categorical"}' AS policy,
    count(DISTINCT "{x}") AS n_unique FROM ds""" for x in _X) + ")"
_ENC = "case policy when 'dropped' then 'none' when 'numeric' then 'scale' else case when n_unique<=8 then 'onehot' else 'ordinal' end end"


@query("encoding_plan", sql(DATASET, _PLAN, f'SELECT "column", policy, {_ENC} AS encoding, n_unique FROM pl'))
def encoding_plan(spark, sf):
    return encoding.encoding_plan(dataset(spark, sf), _X)


@query("classify_columns", sql(DATASET, _PLAN, f'SELECT {_ENC} AS encoding, count(*) AS n_columns FROM pl GROUP BY 1'))
def classify_columns(spark, sf):
    return encoding.encoding_plan(dataset(spark, sf), _X).groupBy("encoding").agg(F.count(F.lit(1)).alias("n_columns"))


@query("standard_scale", sql(DATASET, 'SELECT "Customer ID", ' + ", ".join(
    f'round(("{x}"-avg("{x}") OVER ())/stddev_pop("{x}") OVER (),6) AS "{x}"' for x in ("Age", "Tenure Months", "Monthly Charges")) + " FROM ds"))
def standard_scale(spark, sf):
    cols = ["Age", "Tenure Months", "Monthly Charges"]
    return r6(encoding.standard_scale(dataset(spark, sf), cols).select(KEY, *cols))


@query("ordinal_encode", sql(DATASET, LABELLED, """tr AS (SELECT DISTINCT "City" FROM ds JOIN labelled ON "Customer ID"=id WHERE split<>'silent_test'),
    dict AS (SELECT "City", (row_number() OVER (ORDER BY "City")-1)::int AS code FROM tr)""",
    """SELECT "Customer ID", coalesce(code,-1)::int AS "City" FROM ds LEFT JOIN dict USING ("City")"""))
def ordinal_encode(spark, sf):
    base = dataset(spark, sf).select(KEY, "City")
    seen = labelled_orders(spark, sf).filter("split <> 'silent_test'").select(F.col("id").alias(KEY))
    return encoding.ordinal_encode(base, "City", base.join(seen, KEY, "left_semi"))


def encoded(spark, sf):
    """Fitted on the training rows, applied to all."""
    base = features.derive_all(dataset(spark, sf)).join(labelled_orders(spark, sf).select(F.col("id").alias(KEY), "split"), KEY)
    base = settle(base)
    plan = encoding.classify_columns(base, [x for x in base.columns if x not in (KEY, "split") and not x.startswith("NPS_")])
    base = encoding.encode_ordinals(base, plan["ordinal"], base.filter("split <> 'silent_test'"))
    model = encoding.feature_pipeline(plan).fit(base.filter("split <> 'silent_test'"))
    return model, plan, base


_LEVELS = [("Contract", ["Month-to-month", "One year", "Two year"]),
           ("Payment Method", ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"])]


@query("one_hot", sql(DATASET, """SELECT "Customer ID", concat_ws(',', """ + ", ".join(
    f"""("{n}"='{v}')::int""" for n, levels in _LEVELS for v in levels) + """) AS bits FROM ds"""))
def one_hot(spark, sf):
    base = dataset(spark, sf).select(KEY, *[c(n) for n, _ in _LEVELS])
    model = encoding.feature_pipeline({"numeric": [], "onehot": [n for n, _ in _LEVELS], "ordinal": []}).fit(base)
    bits = F.transform(vector_to_array("features"), lambda v: v.cast("int").cast("string"))
    return model.transform(base).select(KEY, F.array_join(bits, ",").alias("bits"))


@query("fit_encode")
def fit_encode(spark, sf):
    model, plan, base = encoded(spark, sf)
    names = encoding.encoded_names(model, base, plan)
    out = model.transform(base).select(KEY, vector_to_array("features").alias("features"))
    return out.withColumn("n_features", F.size("features")).withColumn("names_match", F.lit(len(names)) == F.size("features"))


# --- text ------------------------------------------------------------------------------------------------------------

_W = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query("text_quality_audit", sql(f"""s AS (SELECT count(*) AS n, avg(length(text)) AS cm, median(length(text)) AS cmed, min(length(text)) AS cmin,
    max(length(text)) AS cmax, count(*) FILTER (length(text)<30) AS lo, count(*) FILTER (length(text)>500) AS hi, avg({_W}) AS wm, median({_W}) AS wmed FROM documents)""",
    """SELECT section, "key", floor(value)::bigint AS value FROM (SELECT 'total' AS section, 'rows' AS "key", n::double AS value FROM s UNION ALL
    SELECT 'char_length','mean',cm FROM s UNION ALL SELECT 'char_length','median',cmed FROM s UNION ALL SELECT 'char_length','min',cmin FROM s UNION ALL
    SELECT 'char_length','max',cmax FROM s UNION ALL SELECT 'char_length','below_30',lo FROM s UNION ALL SELECT 'char_length','above_500',hi FROM s UNION ALL
    SELECT 'word_length','mean',wm FROM s UNION ALL SELECT 'word_length','median',wmed FROM s)"""))
def text_quality_audit(spark, sf):
    return text.quality_audit(table(spark, sf, "documents"), "text")


_TERMS = list(FORBIDDEN_TERMS) + ["the", "license", "password"]


@query("forbidden_terms", sql("t AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS term, count(*) FILTER (contains(lower(text),'{t}')) AS n FROM documents" for t in _TERMS) + ")", "SELECT * FROM t WHERE n>0"))
def forbidden_terms(spark, sf):
    return text.term_hits(table(spark, sf, "documents"), "text", _TERMS)


@query("duplicate_texts", sql("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*)-count(DISTINCT text) AS n_duplicates FROM documents"))
def duplicate_texts(spark, sf):
    return text.duplicate_texts(table(spark, sf, "documents"), "text")


@query("text_len_by_class", sql("""SELECT lang AS class, count(*) AS n, floor(avg(length(text)))::bigint AS mean_chars,
    floor(median(length(text)))::bigint AS median_chars FROM documents GROUP BY 1"""))
def text_len_by_class(spark, sf):
    return text.length_by_class(table(spark, sf, "documents"), "text", "lang")


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


@query("top_words_by_class", sql("w AS (SELECT lang AS class, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}'']+')) AS word FROM documents)",
    f"k AS (SELECT class, word, count(*) AS n FROM w WHERE length(word)>=3 AND word NOT IN ({_STOP}) GROUP BY ALL)",
    "SELECT class, word, n, row_number() OVER (PARTITION BY class ORDER BY n DESC, word)::int AS rank FROM k QUALIFY rank<=15"))
def top_words_by_class(spark, sf):
    return text.top_words(table(spark, sf, "documents"), "text", "lang", 15)


_PERSONA = "case \"NPS_baseline\" " + " ".join(
    f"when '{k}' then case when ci then '{m}' else '{p}' end" for k, (p, m) in text.PERSONAS.items()) + " end"
_PHASE = "case " + " ".join(f"when t<={upto} then '{name}'" if upto is not None else f"else '{name}'" for upto, name in text.TENURE_PHASES) + " end"
_FILLED = ["t::int", _PHASE, '"Contract"', '"Internet Type"', 'round_even(coalesce("Monthly Charges",0),0)::bigint', f"case when sv='' then '{NO_SERVICES}' else sv end",
           f"case when fr='' then '{NO_FRICTION}' else fr end", "case when is_referrer=1 then 'yes' else 'no' end", _PERSONA]
_TEXT = " || ".join(f"'{part}'" + (f" || {value}" if value else "") for part, value in zip(re.split("%[ds]", PROMPT), [*_FILLED, ""], strict=True))
_PROMPTS = f"""pm AS (SELECT "Customer ID", "NPS_baseline" AS expected_class, ci AS counter_intuitive, {_TEXT} AS user_prompt FROM (
  SELECT *, coalesce("Tenure Months",0) AS t, {u_sql('ci', '"Customer ID"::varchar')} < 0.15::double AS ci,
  concat_ws(' + ', case when "Phone Service"='Yes' then 'Phone' end, case when "Internet Service"='Yes' then 'Internet' end,
    case when n_addons>0 then n_addons || ' add-on' || case when n_addons>1 then 's' else '' end end,
    case when "Streaming TV"='Yes' or "Streaming Movies"='Yes' then 'Streaming ' || concat_ws('+', case when "Streaming TV"='Yes' then 'TV' end,
      case when "Streaming Movies"='Yes' then 'Movies' end) end) AS sv,
  concat_ws(', ', case when has_extra_charges=1 then '{EXTRA_CHARGES}' end, case when has_refund=1 then '{REFUND}' end,
    case when "Internet Type"='Fiber' then '{FIBER}' end) AS fr FROM feat))"""


def prompts(spark, sf):
    return text.build_prompts(features.derive_all(dataset(spark, sf)), KEY, "NPS_baseline")


@query("build_prompts", sql(FEATURES, _PROMPTS, "SELECT * FROM pm"))
def build_prompts(spark, sf):
    return prompts(spark, sf)


@query("prompt_summary", sql(FEATURES, _PROMPTS, """SELECT expected_class, count(*) AS count, count(*) FILTER (counter_intuitive) AS ci_count,
    floor(avg(length(user_prompt)))::bigint AS user_prompt_avg_chars, round(count(*) FILTER (counter_intuitive)/count(*)::double,3) AS ci_rate FROM pm GROUP BY 1"""))
def prompt_summary(spark, sf):
    return text.prompt_summary(prompts(spark, sf))


@query("prompt_label_leak", sql(FEATURES, _PROMPTS, " UNION ALL ".join(
    f"SELECT '{k}' AS class, count(*) FILTER (contains(user_prompt,'{k}')) AS n FROM pm" for k in CLASSES)))
def prompt_label_leak(spark, sf):
    return text.label_leaks(prompts(spark, sf))


_MD5 = "md5(concat_ws('|','hashing-tf',doc_id::varchar,coalesce(text,'')))"


@query("dataset_fingerprint", sql("SELECT count(*) AS n, " + ", ".join(
    f"sum(('0x'||substr({_MD5},{1 + 6 * i},6))::bigint)::bigint AS h{i + 1}" for i in range(4)) + " FROM documents"))
def dataset_fingerprint(spark, sf):
    return text.fingerprint(table(spark, sf, "documents"), "doc_id", "text", "hashing-tf")


@query("embed_texts")
def embed_texts(spark, sf):
    """Hashed TF-IDF vectors, made by the first call on these texts and read from the store by later ones of the session."""
    docs = table(spark, sf, "documents")
    return text.cached_embeddings(docs, "doc_id", "text", "hashing-tf-256", Store(spark, store_root(spark)),
                                  lambda df: text.embed(df, "doc_id", "text", 256))


def letter_shares(df):
    """(digest, embedding) of a text on its own: how many of its characters are a, e, i, o and u."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda x: ((F.length("text") - F.length(F.replace("text", F.lit(x)))) / n).cast("float")
    return df.select("digest", F.array(*[share(x) for x in "aeiou"]).alias("embedding"))


@query("vector_store_reuse", sql("""t AS (SELECT doc_id, coalesce(text,'') AS a, case when doc_id%10=0 then coalesce(text,'') || ' (revised)' else coalesce(text,'') END AS b FROM documents)""",
    """SELECT 'all new' AS state, count(*) AS n_rows, (SELECT count(DISTINCT a) FROM t) AS n_encoded FROM t UNION ALL
    SELECT 'same again', count(*), 0 FROM t UNION ALL
    SELECT 'some revised', count(*), (SELECT count(DISTINCT b) FROM t WHERE b NOT IN (SELECT a FROM t)) FROM t"""))
def vector_store_reuse(spark, sf):
    """What is encoded when the documents are first met, met again, and met with every tenth one revised."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    revised = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(body, F.lit(" (revised)"))).otherwise(body))
    store, out, done = Store(spark, scratch_path(spark, "store")), [], 0
    for state, rows in (("all new", docs), ("same again", docs), ("some revised", revised)):
        vectors = text.encoded_once(rows, "doc_id", "text", "vowels", store, letter_shares)
        stored = store.latest("encoded-vowels").count()
        out.append(vectors.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(state).alias("state"), "n_rows", F.lit(stored - done).cast("long").alias("n_encoded")))
        done = stored
    return reduce(DataFrame.unionByName, out)


@query("embedding_checks", sql("""v AS (SELECT vec_id, unnest(range(1, len(embedding)+1)) AS pos, unnest(embedding)::double AS v FROM embeddings)""",
    "d AS (SELECT pos, count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) AS bad, stddev_pop(v) AS sd FROM v GROUP BY 1)",
    """SELECT 'dims' AS "check", count(*)::double AS value FROM d UNION ALL SELECT 'min_dim', min(len(embedding)) FROM embeddings
    UNION ALL SELECT 'max_dim', max(len(embedding)) FROM embeddings UNION ALL SELECT 'non_finite', sum(bad) FROM d
    UNION ALL SELECT 'varying_share', count(*) FILTER (sd>1e-6)/count(*)::double FROM d
    UNION ALL SELECT 'ids_without_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""))
def embedding_checks(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    return r6(text.embedding_checks(table(spark, sf, "embeddings"), "vec_id", "embedding", ids))

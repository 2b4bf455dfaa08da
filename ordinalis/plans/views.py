"""Views that bind the operators to the given tables, as DataFrames and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.functions.hashing import uniform
from ordinalis.functions.scalar import argmax3

CLASS_NAMES = "['Detractor','Passive','Promoter']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql(*parts: str) -> str:
    """WITH-clause from the given CTEs followed by the last part."""
    *ctes, body = parts
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def u_sql(tag: str, key: str, seed: str = "42") -> str:
    return (f"(cast(('0x'||substr(md5(concat_ws(':','{seed}','{tag}',{key})),1,12))::bigint as double)"
            "/281474976710656)")


# --- scored orders -----------------------------------------------------------------------------------------

# model -> (modulus of the rows it gets wrong more often, step of the second score)
MODELS = {"C1": (3, 31), "C2": (2, 13)}


def _with_scores(o: DataFrame, names: list[str]) -> DataFrame:
    """Raw scores a, b, c and their sum per model as columns, each computed once."""
    y, key = F.col("y"), F.col("id")
    o = o.withColumn("cents", F.round(F.col("price") * 100).cast("bigint"))
    raw, sums = {}, {}
    for m in names:
        modulus, step = MODELS[m]
        def bonus(k: int) -> Column:
            return F.when((y == k) & (key % modulus != 0), 60).otherwise(0)
        raw[f"a_{m}"] = (1 + F.col("cents") % 97 + bonus(0)).cast("double")
        raw[f"b_{m}"] = (1 + (key * step) % 89 + bonus(1)).cast("double")
        raw[f"c_{m}"] = (1 + (key * 17 + F.col("cust")) % 83 + bonus(2)).cast("double")
        sums[f"s_{m}"] = F.col(f"a_{m}") + F.col(f"b_{m}") + F.col(f"c_{m}")
    return o.withColumns(raw).withColumns(sums)


def _model(m: str) -> Column:
    a, b, c, s = (F.col(f"{x}_{m}") for x in "abcs")
    return F.struct(F.lit(m).alias("model"), argmax3(a, b, c).alias("yp"),
                    (a / s).alias("p0"), (b / s).alias("p1"), (c / s).alias("p2"))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with satisfaction score, both class codes and the evaluation split."""
    o = table(spark, sf_dir, "orders")
    sat = F.substring("o_orderpriority", 1, 1).cast("int")
    u = F.col("_u")
    return o.withColumn("_u", uniform(42, "split", F.col("o_orderkey"))).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), sat.alias("sat"),
        F.when(sat <= 2, 0).when(sat <= 4, 1).otherwise(2).alias("y"),
        F.when(sat <= 3, 0).when(sat == 4, 1).otherwise(2).alias("y_base"),
        F.when(u < 0.09, "train").when(u < 0.12, "val").when(u < 0.15, "respondent_test")
        .otherwise("silent_test").alias("split"))


_SCORED_COLUMNS = ("id", "cust", "ts", "sat", "status", "split", "y", "y_base")


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model, y, yp, p0..p2, split, ...) for the two models; the explode adds no shuffle."""
    o = _with_scores(labelled_orders(spark, sf_dir), list(MODELS))
    both = F.explode(F.array(*[_model(m) for m in MODELS]))
    return o.select(*_SCORED_COLUMNS, both.alias("_m")).select(*_SCORED_COLUMNS, "_m.*")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the first model only."""
    o = _with_scores(labelled_orders(spark, sf_dir), ["C1"])
    return o.select(*_SCORED_COLUMNS, _model("C1").alias("_m")).select(*_SCORED_COLUMNS, "_m.*")


def with_segments(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Add market segment and region; join sides are left to AQE."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("mktsegment"), "c_nationkey")
    place = (table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"),
                                                 F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region")))
    return rows.join(cust.join(place, "c_nationkey").drop("c_nationkey"), "cust")


SEGMENTS = ("status", "mktsegment", "region")

LABELLED = f"""labelled AS (
  SELECT *, case when sat<=2 then 0 when sat<=4 then 1 else 2 end AS y,
         case when sat<=3 then 0 when sat=4 then 1 else 2 end AS y_base,
         case when u<0.09::double then 'train' when u<0.12::double then 'val' when u<0.15::double then 'respondent_test'
              else 'silent_test' end AS split
  FROM (SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status, o_orderdate AS ts,
               cast(substr(o_orderpriority,1,1) AS int) AS sat, {u_sql('split', 'o_orderkey::varchar')} AS u FROM orders))"""

_PARTS = """SELECT *, (1 + cast(round(price*100) as bigint) % 97 + case when y=0 and id % {m} <> 0 then 60 else 0 end)::double AS a,
  (1 + (id*{s}) % 89 + case when y=1 and id % {m} <> 0 then 60 else 0 end)::double AS b,
  (1 + (id*17 + cust) % 83 + case when y=2 and id % {m} <> 0 then 60 else 0 end)::double AS c, '{n}' AS model FROM labelled"""

LONG = LABELLED + f""",
parts AS ({_PARTS.format(m=3, s=31, n='C1')} UNION ALL {_PARTS.format(m=2, s=13, n='C2')}),
scored_long AS (SELECT id, cust, ts, sat, status, split, y, y_base, model,
  case when a>=b and a>=c then 0 when b>=c then 1 else 2 end AS yp,
  a/(a+b+c) AS p0, b/(a+b+c) AS p1, c/(a+b+c) AS p2 FROM parts)"""

SCORED = LONG + """,
scored AS (SELECT * FROM scored_long WHERE model = 'C1')"""

_SEG = """seg_{n} AS (SELECT s.*, c_mktsegment AS mktsegment, r_name AS region FROM {n} s
  JOIN customer ON cust = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SEG_SCORED = SCORED + ",\n" + _SEG.format(n="scored")
SEG_LONG = LONG + ",\n" + _SEG.format(n="scored_long")

# --- customers ----------------------------------------------------------------------------------------------
# Part types stand for add-on services: buying one sets the flag.
TYPE_FLAGS = {"ECONOMY": "Online Security", "LARGE": "Online Backup", "MEDIUM": "Device Protection",
              "PROMO": "Tech Support", "SMALL": "Streaming TV", "STANDARD": "Streaming Movies"}
PAYMENTS = ("Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)")
CONTRACTS = ("Month-to-month", "One year", "Two year")
NETS = ("Fiber", "DSL", "Cable")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: order count, cents spent, months between first and last order."""
    o = table(spark, sf_dir, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        (F.max(month) - F.min(month)).alias("months"))


def customer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: how many lines of each part type were bought (flag = few lines, see `customers`)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    per_order = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
                 .groupBy("l_orderkey").agg(*[F.count_if(F.col("p_type") == t).alias(t) for t in TYPE_FLAGS]))
    return (per_order.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("c_custkey").agg(*[F.sum(t).alias(t) for t in TYPE_FLAGS]))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw wide customer table, one row per customer, with the canonical column names."""
    c = table(spark, sf_dir, "customer")
    size = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("c_custkey")
    base = (c.join(customer_orders(spark, sf_dir), "c_custkey", "left")
            .join(customer_types(spark, sf_dir), "c_custkey", "left")
            .join(nation, "c_nationkey").join(size, "c_nationkey"))
    months = F.coalesce(F.col("months"), F.lit(0))
    third = F.floor(k / 3) % 3
    # noise 0-99 plus a contract and tenure effect, cut into 1-5
    raw = (k * 7919) % 100 + third * 30 + F.least(months, F.lit(80))
    flags = [F.when(F.coalesce(F.col(t), F.lit(0)) % 2 == 1, "Yes").otherwise("No").alias(name)
             for t, name in TYPE_FLAGS.items()]
    return base.select(
        k.alias("Customer ID"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        F.when(k % 7 == 0, "Yes").otherwise("No").alias("Senior Citizen"),
        F.when(k % 3 == 0, "Yes").otherwise("No").alias("Married"),
        (18 + (k * 37) % 62).cast("int").alias("Age"),
        F.col("months").cast("int").alias("Tenure Months"),
        (F.col("cents").cast("double") / F.col("n_orders") / 100).alias("Monthly Charges"),
        F.when(k % 50 != 0, F.col("cents").cast("double") / 100).alias("Total Charges"),
        F.when(k % 10 != 0, "Yes").otherwise("No").alias("Phone Service"),
        F.when(k % 4 == 1, "Yes").otherwise("No").alias("Multiple Lines"),
        F.when(k % 5 != 0, "Yes").otherwise("No").alias("Internet Service"),
        F.when(k % 5 != 0, _pick(NETS, k % 3)).alias("Internet Type"),
        *flags,
        F.when(k % 3 != 1, "Yes").otherwise("No").alias("Paperless Billing"),
        _pick(PAYMENTS, k % 4).alias("Payment Method"),
        _pick(CONTRACTS, third).alias("Contract"),
        F.when(k % 2 == 1, F.when(k % 4 == 1, "Offer A").otherwise("Offer B")).alias("Offer"),
        (k % 6).cast("int").alias("Number of Referrals"),
        F.when(k % 13 != 0, F.when(k % 11 == 0, 5.0).otherwise(0.0)).alias("Total Refunds"),
        F.when(k % 9 == 0, 10.0).otherwise(0.0).alias("Total Extra Data Charges"),
        F.col("population").cast("int").alias("Population"),
        F.col("c_nationkey").cast("string").alias("Zip Code"),
        F.col("n_name").alias("City"),
        F.col("c_acctbal").alias("CLTV"),
        F.col("c_mktsegment").alias("Customer Status"),
        F.lit("Q3").alias("Quarter"),
        F.least(F.lit(5), 1 + F.floor(raw / 48)).cast("int").alias("Satisfaction Score"))


def _arr(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


CUSTOMERS = f"""ord AS (SELECT o_custkey, count(*) AS n_orders, sum(cast(round(o_totalprice*100) as bigint))::bigint AS cents,
   max(year(o_orderdate)*12+month(o_orderdate)) - min(year(o_orderdate)*12+month(o_orderdate)) AS months FROM orders GROUP BY 1),
typ AS (SELECT o_custkey, {', '.join(f"count(*) FILTER (p_type='{t}') AS t_{t.lower()}" for t in TYPE_FLAGS)}
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
pop AS (SELECT c_nationkey AS nk, count(*) AS population FROM customer GROUP BY 1),
cust0 AS (SELECT c.*, n_name, n_orders, cents, months, population, (c_custkey // 3) % 3 AS third,
   {', '.join(f"coalesce(t_{t.lower()},0) AS t_{t.lower()}" for t in TYPE_FLAGS)}
   FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN pop ON nk = c_nationkey
   LEFT JOIN ord ON ord.o_custkey = c_custkey LEFT JOIN typ ON typ.o_custkey = c_custkey),
cust AS (SELECT c_custkey AS "Customer ID",
   case when c_custkey%2=0 then 'Female' else 'Male' end AS "Gender",
   case when c_custkey%7=0 then 'Yes' else 'No' end AS "Senior Citizen",
   case when c_custkey%3=0 then 'Yes' else 'No' end AS "Married",
   (18 + (c_custkey*37)%62)::int AS "Age", months::int AS "Tenure Months",
   cents::double / n_orders / 100 AS "Monthly Charges",
   case when c_custkey%50<>0 then cents::double/100 end AS "Total Charges",
   case when c_custkey%10<>0 then 'Yes' else 'No' end AS "Phone Service",
   case when c_custkey%4=1 then 'Yes' else 'No' end AS "Multiple Lines",
   case when c_custkey%5<>0 then 'Yes' else 'No' end AS "Internet Service",
   case when c_custkey%5<>0 then {_arr(NETS)}[c_custkey%3+1] end AS "Internet Type",
   {', '.join(f'''case when t_{t.lower()}%2=1 then 'Yes' else 'No' end AS "{n}"''' for t, n in TYPE_FLAGS.items())},
   case when c_custkey%3<>1 then 'Yes' else 'No' end AS "Paperless Billing",
   {_arr(PAYMENTS)}[c_custkey%4+1] AS "Payment Method", {_arr(CONTRACTS)}[third+1] AS "Contract",
   case when c_custkey%2=1 then case when c_custkey%4=1 then 'Offer A' else 'Offer B' end end AS "Offer",
   (c_custkey%6)::int AS "Number of Referrals",
   case when c_custkey%13<>0 then case when c_custkey%11=0 then 5.0::double else 0.0::double end end AS "Total Refunds",
   case when c_custkey%9=0 then 10.0::double else 0.0::double end AS "Total Extra Data Charges",
   population::int AS "Population", c_nationkey::varchar AS "Zip Code", n_name AS "City", c_acctbal AS "CLTV",
   c_mktsegment AS "Customer Status", 'Q3' AS "Quarter",
   least(5, 1 + ((c_custkey*7919)%100 + third*30 + least(coalesce(months,0),80)) // 48)::int AS "Satisfaction Score" FROM cust0)"""

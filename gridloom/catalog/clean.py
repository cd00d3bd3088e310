"""Cleaning steps and the whole cleaning sequence."""

from pyspark.sql import functions as F

from ..operators import clean
from ..plans.cleaning import auto_clean, clean_dataset
from .inputs import HOLED_CUSTOMER, holed_customer
from .registry import query, rounded


@query("coerce_numeric", r"""
select p_partkey, try_cast(case when regexp_matches(raw, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') then raw end as double) as raw
from (select p_partkey, case p_partkey % 5 when 0 then 'N/A' when 1 then '1,' || p_size when 2 then ' ' || substr(p_brand, 7) || ' '
  when 3 then p_size || 'd' else cast(p_size as varchar) end as raw from part)""")
def numbers(t):
    size, rest = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = (
        F.when(rest == 0, "N/A").when(rest == 1, F.concat(F.lit("1,"), size))
        .when(rest == 2, F.concat(F.lit(" "), F.expr("substr(p_brand, 7)"), F.lit(" ")))
        .when(rest == 3, F.concat(size, F.lit("d"))).otherwise(size)
    )
    return clean.coerce(t("part").select("p_partkey", raw.alias("raw")), to_numeric=["raw"])


@query("coerce_datetime", """
select o_orderkey, case when o_orderkey % 4 = 0 then null else o_orderdate end as placed from orders""")
def moments(t):
    rest = F.col("o_orderkey") % 4
    raw = (
        F.when(rest == 0, "soon").when(rest == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(rest == 2, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    return clean.coerce(t("orders").select("o_orderkey", raw.alias("placed")), to_datetime=["placed"])


@query("coerce_bool", """
select doc_id, case when doc_id % 3 = 0 then null else quality = 1 end as quality from labels""")
def flags(t):
    rest = F.col("doc_id") % 3
    raw = (
        F.when(rest == 0, "maybe").when(rest == 1, F.col("quality").cast("string"))
        .otherwise(F.when(F.col("quality") == 1, "True").otherwise("FALSE"))
    )
    return clean.coerce(t("labels").select("doc_id", raw.alias("quality")), to_bool=["quality"])


@query("missing_indicators", f"""
select *, (c_acctbal is null)::int as c_acctbal_missing, (c_mktsegment is null)::int as c_mktsegment_missing
from ({HOLED_CUSTOMER})""")
def indicators(t):
    return clean.add_missing_indicators(holed_customer(t), ["c_acctbal", "c_mktsegment", "no_such_column"])


@query("impute_median", f"""
select c_custkey, round(coalesce(c_acctbal, (select median(c_acctbal) from ({HOLED_CUSTOMER}))), 6) as c_acctbal
from ({HOLED_CUSTOMER})""")
def medians(t):
    return rounded(clean.impute(holed_customer(t), ["c_acctbal"]).select("c_custkey", "c_acctbal"), c_acctbal=6)


@query("impute_mean", f"""
select c_custkey, round(coalesce(c_acctbal, (select avg(c_acctbal) from ({HOLED_CUSTOMER}))), 6) as c_acctbal
from ({HOLED_CUSTOMER})""")
def means(t):
    return rounded(clean.impute(holed_customer(t), ["c_acctbal"], "mean").select("c_custkey", "c_acctbal"), c_acctbal=6)


@query("impute_knn", """
with src as (select p_partkey, p_size, case when p_partkey % 7 <> 0 then p_retailprice end as p_retailprice, p_partkey / 100.0::double as shelf from part),
near as (select q.p_partkey as qk, d.p_retailprice as v, row_number() over (
    partition by q.p_partkey order by (q.p_size - d.p_size) ** 2 + (q.shelf - d.shelf) ** 2, d.p_partkey) as rn
  from src q, src d where q.p_retailprice is null and d.p_retailprice is not null),
fills as (select qk, avg(v) as v from near where rn <= 5 group by qk)
select p_partkey, p_size::double as p_size, round(coalesce(p_retailprice, v), 6) as p_retailprice, shelf
from src left join fills on qk = p_partkey""")
def neighbours(t):
    src = t("part").select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"),
        (F.col("p_partkey") / 100.0).alias("shelf"),
    )
    return rounded(clean.impute_neighbors(src, ["p_size", "p_retailprice", "shelf"], "p_partkey"), p_retailprice=6)


@query("impute_categorical", f"""
select c_custkey, coalesce(c_name, 'Unknown') as c_name, c_nationkey, c_acctbal,
  coalesce(c_mktsegment, 'Unknown') as c_mktsegment from ({HOLED_CUSTOMER})""")
def texts(t):
    return clean.fill_text(holed_customer(t), ["c_name", "c_mktsegment"])


@query("cap_outliers", """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) as value from events, q""")
def capped(t):
    return rounded(clean.cap_outliers(t("events").select("event_id", "value"), ["value"]), value=6)


@query("drop_duplicates", "select distinct text, lang from documents")
def deduplicated(t):
    return clean.drop_duplicates(t("documents").select("text", "lang"))


@query("drop_constant", "select r_regionkey, r_name from region")
def varied(t):
    return clean.drop_constant(t("region").withColumn("fixed", F.lit("x")).withColumn("nothing", F.lit(None).cast("double")))


@query("drop_sparse", """
select l_orderkey, l_quantity, case when l_orderkey % 10 = 0 then 1 else 0 end::int as tenth from lineitem""")
def dense(t):
    key = F.col("l_orderkey")
    return clean.drop_sparse(t("lineitem").select(
        "l_orderkey", "l_quantity", F.when(key % 10 == 0, 1).otherwise(0).alias("tenth"),
        F.when(key % 50 == 0, F.col("l_quantity")).alias("mostly_null"),
    ))


CLEAN_SQL = f"""
with src as (select * from ({HOLED_CUSTOMER})),
filled as (select c_custkey::double as c_custkey, coalesce(c_name, 'Unknown') as c_name, c_nationkey::double as c_nationkey,
  coalesce(c_acctbal, (select median(c_acctbal) from src)) as c_acctbal, coalesce(c_mktsegment, 'Unknown') as c_mktsegment,
  (c_name is null)::int as c_name_missing, (c_acctbal is null)::int as c_acctbal_missing from src),
q as (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3 from filled)
select c_custkey, c_name, c_nationkey,
  round(least(greatest(c_acctbal, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) as c_acctbal, c_mktsegment,
  c_name_missing, c_acctbal_missing from filled, q"""


@query("clean_dataset", CLEAN_SQL)
def cleaned(t):
    return rounded(auto_clean(holed_customer(t))[0], c_acctbal=6)


DEDUPED_SQL = f"""
with src as (select c_nationkey, c_acctbal, c_mktsegment from ({HOLED_CUSTOMER})),
d as (select distinct c_nationkey, coalesce(c_acctbal, (select median(c_acctbal) from src)) as c_acctbal,
  c_acctbal is null as no_balance, coalesce(c_mktsegment, 'Unknown') as c_mktsegment, c_mktsegment is null as no_segment from src)"""


@query("clean_summary", f"""
{DEDUPED_SQL}
select * from (values ('step', 'type_coercion'), ('step', 'missing_indicator_added'), ('step', 'imputation'),
  ('step', 'outlier_cap'), ('step', 'drop_duplicates'), ('step', 'drop_constant'), ('step', 'drop_sparse'),
  ('imputation_numeric', 'median'), ('imputation_categorical', 'mode/Unknown'),
  ('dropped_constant', 'c_nationkey_missing'), ('outlier_capped', 'c_nationkey'), ('outlier_capped', 'c_acctbal')) v(entry, value)
union all select 'dropped_duplicates', ((select count(*) from src) - (select count(*) from d))::varchar
union all select 'dropped_sparse', 'c_acctbal_missing' from d having count(*) filter (not no_balance) >= 0.9 * count(*)
union all select 'dropped_sparse', 'c_mktsegment_missing' from d having count(*) filter (not no_segment) >= 0.9 * count(*)""")
def cleaning_summary(t):
    rows = holed_customer(t).select("c_nationkey", "c_acctbal", "c_mktsegment")
    _, report = clean_dataset(rows, ["c_nationkey", "c_acctbal"], ["c_mktsegment"], max_top_share=0.9)
    return report.to_frame(t.spark)

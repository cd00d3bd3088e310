"""Column metadata and value domains."""

from pyspark.sql import functions as F

from ..operators.profile import (
    cardinality, convertible_text, describe_categorical, describe_numeric, filter_domains, filter_options,
    kpi_cards, top_values, year_like,
)
from .registry import query, rounded


def union_sql(columns, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


NUMBER_SQL = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"


@query("profile_convertible", f"""
with src as (
  select p_name, substr(p_brand, 7) as brand_no, p_type,
    case when p_partkey % 3 = 0 then 'N/A' else cast(p_size as varchar) end as size_text from part)
select "column", ratio, ratio >= 0.6 as convertible from (
  {union_sql(['p_name', 'brand_no', 'p_type', 'size_text'],
             f"select '{{c}}' as \"column\", round(avg(case when regexp_matches({{c}}, {NUMBER_SQL}) then 1.0 else 0.0 end), 6) as ratio from src")})
""")
def convertible(t):
    src = t("part").select(
        "p_name", F.expr("substr(p_brand, 7)").alias("brand_no"), "p_type",
        F.when(F.col("p_partkey") % 3 == 0, "N/A").otherwise(F.col("p_size").cast("string")).alias("size_text"),
    )
    return rounded(convertible_text(src), ratio=6)


DESCRIBED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("describe_numeric", union_sql(DESCRIBED, """
select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  min({c})::double as min, max({c})::double as max, round(quantile_cont({c}::double, 0.25), 6) as q25,
  round(quantile_cont({c}::double, 0.5), 6) as q50, round(quantile_cont({c}::double, 0.75), 6) as q75
from lineitem"""))
def numeric_summary(t):
    return rounded(describe_numeric(t("lineitem")), mean=6, std=6, q25=6, q50=6, q75=6)


@query("describe_categorical", union_sql(["o_orderstatus", "o_orderpriority"], """
select '{c}' as "column", sum(n)::bigint as count, count(*) as "unique", arg_min({c}, (-n, {c})) as top, max(n) as freq
from (select {c}, count(*) as n from orders group by {c})"""))
def categorical_summary(t):
    return describe_categorical(t("orders"))


@query("top_values", "select * from (" + union_sql(["o_orderstatus", "o_orderpriority"], """
select '{c}' as "column", {c} as value, count(*) as n, row_number() over (order by count(*) desc, {c})::int as position
from orders group by {c}""") + ") where position <= 5")
def frequent_values(t):
    return top_values(t("orders"))


@query("kpi_cards", """
select count(*) as rows, 11::int as columns, sum(l_orderkey)::double as total_l_orderkey,
  sum(l_partkey)::double as total_l_partkey from lineitem""")
def kpis(t):
    return kpi_cards(t("lineitem"))


@query("filter_options", "select distinct p_type as option from part")
def options(t):
    return filter_options(t("part"), "p_type")


@query("detect_year_cols", """
select 'o_orderkey' as "column", min(o_orderkey) >= 1800 and max(o_orderkey) <= 2100 as is_year from orders
union all select 'o_custkey', min(o_custkey) >= 1800 and max(o_custkey) <= 2100 from orders
union all select 'placed', min(year(o_orderdate)) >= 1800 and max(year(o_orderdate)) <= 2100 from orders
union all select 'year_no', true""")
def year_columns(t):
    return year_like(t("orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("placed"),
        (F.year("o_orderdate") - 1990).alias("year_no"),
    ))


@query("filter_domains", """
select 'c_custkey' as "column", min(c_custkey)::double as number_low, max(c_custkey)::double as number_high,
  null::timestamp as date_low, null::timestamp as date_high from customer
union all select 'c_nationkey', min(c_nationkey), max(c_nationkey), null, null from customer
union all select 'c_acctbal', min(c_acctbal), max(c_acctbal), null, null from customer""")
def domains(t):
    return filter_domains(t("customer").withColumn("constant", F.lit(7)))


@query("filter_domains_dates", """
select 'o_orderkey' as "column", min(o_orderkey)::double as number_low, max(o_orderkey)::double as number_high,
  null::timestamp as date_low, null::timestamp as date_high from orders
union all select 'o_totalprice', min(o_totalprice), max(o_totalprice), null, null from orders
union all select 'o_orderdate', null, null, min(o_orderdate), max(o_orderdate) from orders""")
def date_domains(t):
    return filter_domains(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"))


@query("column_cardinality", union_sql(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
       "select '{c}' as \"column\", count(distinct {c}) as n_distinct from part"))
def distinct_counts(t):
    return cardinality(t("part"))

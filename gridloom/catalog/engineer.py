"""Feature engineering over whole tables."""

from pyspark.sql import functions as F

from ..operators import engineer as e
from .registry import query, rounded


@query("eng_log1p", "select l_orderkey, l_extendedprice, round(ln(1 + l_extendedprice), 8) as log_l_extendedprice from lineitem")
def logs(t):
    return rounded(e.log1p(t("lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice"), log_l_extendedprice=8)


@query("eng_log1p_edge", """
select c_custkey, round(c_acctbal - 5001, 2) as shifted, case when round(c_acctbal - 5001, 2) < -1 then 'nan'::double
  when round(c_acctbal - 5001, 2) = -1 then '-inf'::double else round(ln(1 + round(c_acctbal - 5001, 2)), 6) end as log_shifted from customer""")
def edge_logs(t):
    shifted = t("customer").select("c_custkey", F.round(F.col("c_acctbal") - 5001, 2).alias("shifted"))
    value = F.col("log_shifted")
    kept = F.when(F.isnan(value) | (value == float("-inf")), value).otherwise(F.round(value, 6))
    return e.log1p(shifted, "shifted").withColumn("log_shifted", kept)


@query("eng_sqrt", "select l_orderkey, l_extendedprice, round(sqrt(l_extendedprice), 8) as sqrt_l_extendedprice from lineitem")
def roots(t):
    return rounded(e.square_root(t("lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice"), sqrt_l_extendedprice=8)


@query("eng_square", """
select p_partkey, p_size, p_retailprice, p_size::bigint * p_size as p_size_sq,
  round(p_retailprice * p_retailprice, 4) as p_retailprice_sq from part""")
def squares(t):
    src = t("part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(e.square(e.square(src, "p_size"), "p_retailprice"), p_retailprice_sq=4)


@query("eng_zscore", """
select c_custkey, c_acctbal, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 8) as c_acctbal_z
from customer""")
def z_scores(t):
    return rounded(e.z_score(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal"), c_acctbal_z=8)


@query("eng_minmax", """
select c_custkey, c_acctbal, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 8) as c_acctbal_01
from customer""")
def scaled(t):
    return rounded(e.min_max(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal"), c_acctbal_01=8)


@query("eng_quantile_bins", """
with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders),
i as (select o_orderkey, o_totalprice, a, b, c, case when o_totalprice <= a then 0 when o_totalprice <= b then 1
  when o_totalprice <= c then 2 else 3 end::int as o_totalprice_bin_index from orders, q)
select o_orderkey, o_totalprice, o_totalprice_bin_index, case o_totalprice_bin_index
  when 0 then printf('(-inf, %.10g]', a) when 1 then printf('(%.10g, %.10g]', a, b)
  when 2 then printf('(%.10g, %.10g]', b, c) else printf('(%.10g, inf]', c) end as o_totalprice_bin from i""")
def binned(t):
    return e.quantile_bins(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("eng_ratio", """
select l_orderkey, l_extendedprice, l_tax, case when l_tax = 0 then 'inf'::double else round(l_extendedprice / l_tax, 4) end as l_extendedprice_per_l_tax
from lineitem""")
def ratios(t):
    out = e.ratio(t("lineitem").select("l_orderkey", "l_extendedprice", "l_tax"), "l_extendedprice", "l_tax")
    value = F.col("l_extendedprice_per_l_tax")
    return out.withColumn("l_extendedprice_per_l_tax", F.when(value == float("inf"), value).otherwise(F.round(value, 4)))


@query("eng_product", "select l_orderkey, l_quantity, l_discount, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount from lineitem")
def products(t):
    return rounded(e.product(t("lineitem").select("l_orderkey", "l_quantity", "l_discount"), "l_quantity", "l_discount"), l_quantity_x_l_discount=6)


@query("eng_difference", "select l_orderkey, l_quantity, l_tax, round(l_quantity - l_tax, 6) as l_quantity_minus_l_tax from lineitem")
def differences(t):
    return rounded(e.difference(t("lineitem").select("l_orderkey", "l_quantity", "l_tax"), "l_quantity", "l_tax"), l_quantity_minus_l_tax=6)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("eng_one_hot", "select c_custkey, c_mktsegment, " + ", ".join(
    f"(c_mktsegment = '{s}')::int as \"c_mktsegment_{s}\"" for s in SEGMENTS) + " from customer")
def indicators(t):
    return e.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("eng_frequency", "select p_partkey, p_type, count(*) over (partition by p_type) as p_type_count from part")
def frequencies(t):
    return e.frequency(t("part").select("p_partkey", "p_type"), "p_type")


@query("eng_date_parts", """
select o_orderkey, o_orderdate, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month,
  isodow(o_orderdate)::int as o_orderdate_weekday from orders""")
def parts(t):
    return e.date_parts(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("eng_date_parts_text", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as placed_date, year(o_orderdate)::int as placed_date_year,
  month(o_orderdate)::int as placed_date_month, isodow(o_orderdate)::int as placed_date_weekday from orders""")
def text_parts(t):
    src = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed_date"))
    return e.date_parts(src, "placed_date")

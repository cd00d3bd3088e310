"""Data-quality reports and inference."""

from pyspark.sql import functions as F

from ..operators.diagnose import (
    association_matrix, association_pairs, correlation_matrix, correlation_pairs, duplicate_report,
    missing_pattern, missing_report, outlier_report,
)
from ..operators.understand import (
    class_imbalance, effective_task, infer_target, infer_task, leakage_category, leakage_numeric,
    override_task, skew_report,
)
from ..plans.report import diagnose, understand
from .inputs import HOLED_CUSTOMER, holed_customer
from .profile import union_sql
from .registry import query, rounded

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("missing_report", union_sql(CUSTOMER_COLUMNS, f"""
select '{{c}}' as "column", count(*) - count({{c}}) as missing_count,
  round((count(*) - count({{c}})) * 100.0::double / count(*), 6) as missing_pct from ({HOLED_CUSTOMER})"""))
def missing(t):
    return rounded(missing_report(holed_customer(t)), missing_pct=6)


@query("missing_pattern", union_sql(CUSTOMER_COLUMNS, f"""
select c_custkey as key_c_custkey, '{{c}}' as "column", ({{c}} is null)::int as missing
from (select * from ({HOLED_CUSTOMER}) order by c_custkey limit 200)"""))
def pattern(t):
    return missing_pattern(holed_customer(t), ["c_custkey"])


@query("duplicate_report", """
select (sum(n) - count(*))::bigint as duplicate_count, round((sum(n) - count(*)) / sum(n)::double, 8) as duplicate_ratio
from (select text, count(*) as n from documents group by text)""")
def duplicates(t):
    return rounded(duplicate_report(t("documents").select("text")), duplicate_ratio=8)


def outlier_sql(table: str, column: str) -> str:
    return f"""
    select '{column}' as "column", round(any_value(lo), 6) as lower, round(any_value(hi), 6) as upper,
      count(*) filter ({column} < lo or {column} > hi) as outlier_count,
      round(count(*) filter ({column} < lo or {column} > hi) * 100.0::double / count(*), 6) as outlier_pct
    from {table}, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
      select quantile_cont({column}::double, 0.25) as q1, quantile_cont({column}::double, 0.75) as q3 from {table}))"""


@query("outlier_report", " union all ".join(outlier_sql("events", c) for c in ("event_id", "user_id", "value")))
def outliers(t):
    return rounded(outlier_report(t("events")), lower=6, upper=6, outlier_pct=6)


@query("outlier_report_orders", " union all ".join(outlier_sql("orders", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def order_outliers(t):
    return rounded(outlier_report(t("orders")), lower=6, upper=6, outlier_pct=6)


def priced_lines(t):
    return t("lineitem").select(
        "l_quantity", "l_extendedprice", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"), F.lit(1.0).alias("constant"),
    )


PRICED = """priced as (select l_quantity, l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) as net_price from lineitem)"""
PRICED_NUMBERS = ["l_quantity", "l_extendedprice", "l_tax", "net_price"]
PRICED_CORR = " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, abs(corr({a}, {b})) as value from priced"
    for a in PRICED_NUMBERS for b in PRICED_NUMBERS
)
CONSTANT_CORR = " union all ".join(
    f"select '{a}', '{b}', null::double" for a, b in
    [(c, "constant") for c in PRICED_NUMBERS] + [("constant", c) for c in PRICED_NUMBERS] + [("constant", "constant")]
)


@query("corr_matrix", f"""
with {PRICED} select column_a, column_b, round(value, 6) as value from ({PRICED_CORR} union all {CONSTANT_CORR})""")
def correlations(t):
    return rounded(correlation_matrix(priced_lines(t)), value=6)


@query("corr_pairs", f"""
with {PRICED} select column_a, column_b, round(value, 6) as value from ({PRICED_CORR})
where value >= 0.8 and column_a = 'l_extendedprice' and column_b = 'net_price'""")
def hot_pairs(t):
    return rounded(correlation_pairs(priced_lines(t)), value=6)


def cramers_sql(table: str, a: str, b: str) -> str:
    return f"""
    select '{a}' as column_a, '{b}' as column_b, (with
      c as (select {a} as a, {b} as b, count(*)::double as o from {table}
            where {a} is not null and {b} is not null group by 1, 2),
      ra as (select a, sum(o) as ro from c group by a), cb as (select b, sum(o) as co from c group by b),
      s as (select sum(o) as n, (select count(*) from ra) as r, (select count(*) from cb) as k,
              sum(o * o / (ro * co)) - 1 as phi2 from c join ra using (a) join cb using (b)),
      m as (select greatest(0, phi2 - (k - 1) * (r - 1) / greatest(n - 1, 1)) as p,
              least(r - (r - 1) ** 2 / greatest(n - 1, 1) - 1, k - (k - 1) ** 2 / greatest(n - 1, 1) - 1) as room from s)
      select case when room > 0 then sqrt(p / room) else 0.0 end from m)::double as value"""


LINE_CATEGORIES = ["l_returnflag", "l_linestatus", "l_quarter"]
LINE_SQL = """(select l_returnflag, l_linestatus, cast(quarter(l_shipdate) as varchar) as l_quarter from lineitem)"""


@query("cramers_v_matrix", "select column_a, column_b, round(value, 6) as value from (" + " union all ".join(
    f"select '{a}' as column_a, '{a}' as column_b, 1.0::double as value" if a == b else cramers_sql(LINE_SQL, a, b)
    for a in LINE_CATEGORIES for b in LINE_CATEGORIES
) + ")")
def associations(t):
    src = t("lineitem").withColumn("l_quarter", F.quarter("l_shipdate").cast("string"))
    return rounded(association_matrix(src, LINE_CATEGORIES), value=6)


STATUS_SQL = """(select o_orderstatus, o_orderpriority, case when o_orderkey % 5 = 0 then 'X' else lower(o_orderstatus) end
  as status_label from orders)"""


@query("cramers_v_pairs", f"""
select column_a, column_b, round(value, 6) as value from ({cramers_sql(STATUS_SQL, 'o_orderstatus', 'status_label')}
  union all {cramers_sql(STATUS_SQL, 'o_orderstatus', 'o_orderpriority')}
  union all {cramers_sql(STATUS_SQL, 'o_orderpriority', 'status_label')}) where value >= 0.3""")
def associated(t):
    label = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.lower("o_orderstatus"))
    src = t("orders").withColumn("status_label", label)
    return rounded(association_pairs(src, ["o_orderstatus", "o_orderpriority", "status_label"]), value=6)


def verdict(t, name: str, value: str):
    return t.spark.createDataFrame([(name, value)], "item string, value string")


@query("infer_target", """
select 'part' as item, case when count(distinct p_retailprice) > 1 then 'p_retailprice' end as value from part""")
def target(t):
    return verdict(t, "part", infer_target(t("part")))


@query("infer_task", """
select 'toxic' as item, case when count(distinct toxic) <= 20 then 'classification' else 'regression' end as value from labels
union all select 'p_retailprice', case when count(distinct p_retailprice) <= 20 then 'classification' else 'regression' end
from part union all select 'p_type', 'classification'""")
def task(t):
    rows = [("toxic", infer_task(t("labels"), "toxic")), ("p_retailprice", infer_task(t("part"), "p_retailprice")),
            ("p_type", infer_task(t("part"), "p_type"))]
    return t.spark.createDataFrame(rows, "item string, value string")


@query("class_imbalance", """
with g as (select cast(toxic as varchar) as class, count(*) as n from labels group by 1),
r as (select min(n) / sum(n)::double as ratio from g)
select class, n, round(ratio, 8) as ratio, ratio < 0.2 as is_imbalanced from g, r""")
def imbalance(t):
    return rounded(class_imbalance(t("labels"), "toxic"), ratio=8)


@query("skew_report", """
select * from (select 'value' as "column", round(skewness(value), 5) as skew from events
  union all select 'user_id', round(skewness(user_id), 5) from events) where abs(skew) >= 1""")
def skewed(t):
    return rounded(skew_report(t("events"), ["value", "user_id"]), skew=5)


@query("leakage_corr", f"""
with {PRICED} select feature, round(score, 6) as score from (
  select 'l_quantity' as feature, abs(corr(l_quantity, net_price)) as score from priced
  union all select 'l_extendedprice', abs(corr(l_extendedprice, net_price)) from priced
  union all select 'l_tax', abs(corr(l_tax, net_price)) from priced) where score >= 0.9""")
def leaks(t):
    return rounded(leakage_numeric(priced_lines(t), "net_price"), score=6)


def information_sql(table: str, levels: dict, target: str) -> str:
    """Mutual information of each feature expression with the target expression."""
    parts = [f"""
    select '{name}' as feature, (with c as (select a, b, count(*)::double as n from (select {expr} as a, {target} as b from {table}) group by 1, 2),
      t as (select sum(n) as total from c), ra as (select a, sum(n) as na from c group by a), rb as (select b, sum(n) as nb from c group by b)
      select sum(n / total * ln(n * total / (na * nb))) from c join ra using (a) join rb using (b), t) as score"""
             for name, expr in levels.items()]
    return " union all ".join(parts)


def edges_sql(name: str, table: str, column: str, bins: int = 32) -> str:
    shares = ", ".join(f"{i}.0::double / {bins}" for i in range(1, bins))
    return f"""{name} as (select list_distinct(quantile_cont({column}::double, [{shares}])) as {name} from {table})"""


def bin_sql(edges: str, column: str) -> str:
    return f"len(list_filter((select {edges} from {edges}), lambda x: x < {column}::double))::varchar"


@query("leakage_mi", f"""
with {edges_sql('price_edges', 'orders', 'o_totalprice')}, {edges_sql('cust_edges', 'orders', 'o_custkey')},
src as (select o_orderstatus, o_orderpriority, case when o_orderkey % 5 = 0 then 'X' else lower(o_orderstatus) end as status_label,
  {bin_sql('price_edges', 'o_totalprice')} as price_bin, {bin_sql('cust_edges', 'o_custkey')} as cust_bin from orders)
select feature, round(score, 6) as score from ({information_sql('src', {
    'o_totalprice': 'price_bin', 'o_custkey': 'cust_bin', 'o_orderpriority': 'o_orderpriority',
    'status_label': 'status_label'}, 'o_orderstatus')})""")
def informative(t):
    label = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.lower("o_orderstatus"))
    src = t("orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", label.alias("status_label"))
    return rounded(leakage_category(src, "o_orderstatus"), score=6)


@query("effective_task", """
select 'o_totalprice' as item, 'regression' as value
union all select 'o_custkey', case when count(distinct o_custkey) > greatest(20, 0.1 * count(*)) then 'regression' else 'classification' end from orders
union all select 'o_orderkey', case when count(distinct o_orderkey) > greatest(20, 0.1 * count(*)) then 'regression' else 'classification' end from orders
union all select 'o_orderstatus', 'classification'""")
def effective(t):
    columns = ["o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus"]
    return t.spark.createDataFrame([(c, effective_task(t("orders"), c)) for c in columns], "item string, value string")


@query("target_override", """
select 'c_name' as item, case when count(distinct c_name) > 50 and count(distinct c_name) > 0.25 * count(*) then 'regression' else 'classification' end as value from customer
union all select 'c_mktsegment', case when count(distinct c_mktsegment) > 50 and count(distinct c_mktsegment) > 0.25 * count(*) then 'regression' else 'classification' end from customer""")
def overridden(t):
    columns = ["c_name", "c_mktsegment"]
    return t.spark.createDataFrame([(c, override_task(t("customer"), c)) for c in columns], "item string, value string")


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
PART_CATEGORIES = ["p_name", "p_brand", "p_type"]


@query("diagnose_report", "select section, item, measure, round(value, 6) as value from (" + " union all ".join(
    [f"select 'missing' as section, '{c}' as item, 'count' as measure, (count(*) - count({c}))::double as value from part" for c in PART_COLUMNS]
    + [f"select 'missing', '{c}', 'percent', (count(*) - count({c})) * 100.0 / count(*) from part" for c in PART_COLUMNS]
    + [f"select 'duplicates', 'rows', 'count', sum(n - 1)::double from (select count(*) as n from part group by {', '.join(PART_COLUMNS)})"]
    + [f"select 'duplicates', 'rows', 'ratio', sum(n - 1)::double / sum(n) from (select count(*) as n from part group by {', '.join(PART_COLUMNS)})"]
    + [f"select 'outliers', \"column\", m, v from (unpivot (select \"column\", lower, upper, outlier_count::double as count, outlier_pct as percent from ({outlier_sql('part', c)})) on lower, upper, count, percent into name m value v)" for c in PART_NUMBERS]
    + [f"select 'correlation', '{a} / {b}', 'abs_r', v from (select abs(corr({a}, {b})) as v from part) where v >= 0.8"
       for i, a in enumerate(PART_NUMBERS) for b in PART_NUMBERS[i + 1:]]
    + [f"select 'association', column_a || ' / ' || column_b, 'cramers_v', value from ({cramers_sql('part', a, b)}) where value >= 0.3"
       for i, a in enumerate(PART_CATEGORIES) for b in PART_CATEGORIES[i + 1:]]
) + ")")
def full_report(t):
    return rounded(diagnose(t("part")), value=6)


@query("understanding_summary")
def summary(t):
    return rounded(understand(t("customer"), hint="c_mktsegment"), value=6)

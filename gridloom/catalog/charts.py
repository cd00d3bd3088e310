"""Grouped aggregates, pivots, trends, histograms, samples and the dashboard."""

import datetime

from pyspark.sql import functions as F

from ..operators.aggregate import (
    chart_series, compare, drill_down, group_aggregate, matrix_long, pie_shares, pivot_cross, pivot_long, pivot_rows,
    rank,
)
from ..operators.distribution import (
    boxplot, boxplot_outliers, histogram, nice_histogram, sample_rows, scatter,
)
from ..operators.filters import apply_filters
from ..operators.trend import melt_years, raw_trend, text_trend, trend, year_trend
from ..plans.dashboard import dashboard
from .registry import query, rounded

SQL_AGG = {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "median": "median", "count": "count"}


def sql_measure(agg: str, column: str) -> str:
    call = f"{SQL_AGG[agg]}({column})"
    return call if agg == "count" else f"round({call}, 4)"


def digits(agg: str) -> dict:
    return {} if agg == "count" else {"v": 4}


for _agg in ("min", "max", "mean", "sum"):
    @query(f"group_agg_{_agg}", f"""
    select l_returnflag, {sql_measure(_agg, 'l_extendedprice')} as v from lineitem group by l_returnflag""")
    def grouped(t, agg=_agg):
        return rounded(group_aggregate(t("lineitem"), ["l_returnflag"], "l_extendedprice", agg, "v"), v=4)


@query("compare_by_category", """
with g as (select p_brand, avg(p_retailprice) as m from part group by p_brand)
select p_brand, round(m, 6) as p_retailprice, (select count(*) from g) as total_categories
from g order by m desc, p_brand limit 20""")
def compared(t):
    return rounded(compare(t("part"), "p_brand", "p_retailprice"), p_retailprice=6)


@query("rank_top", """
with g as (select c_nationkey, max(c_acctbal) as m from customer group by c_nationkey)
select c_nationkey, m as c_acctbal, (select count(*) from g) as total_categories
from g order by m desc, c_nationkey limit 20""")
def ranked_top(t):
    return rank(t("customer"), "c_nationkey", "c_acctbal", "max")


@query("rank_bottom", """
with g as (select c_nationkey, min(c_acctbal) as m from customer group by c_nationkey)
select c_nationkey, m as c_acctbal, (select count(*) from g) as total_categories
from g order by m, c_nationkey limit 5""")
def ranked_bottom(t):
    return rank(t("customer"), "c_nationkey", "c_acctbal", "min", limit=5, ascending=True)


@query("drill_down", """
with g as (select l_linestatus, avg(l_extendedprice) as m from lineitem where l_returnflag = 'R' group by l_linestatus)
select l_linestatus, round(m, 4) as l_extendedprice, (select count(*) from g) as total_categories from g""")
def drilled(t):
    return rounded(drill_down(t("lineitem"), "l_returnflag", "R", "l_linestatus", "l_extendedprice"), l_extendedprice=4)


for _agg in SQL_AGG:
    @query(f"pivot_rows_{_agg}", f"""
    select o_orderpriority, {sql_measure(_agg, 'o_totalprice')} as v from orders group by o_orderpriority""")
    def pivoted_rows(t, agg=_agg):
        table = pivot_rows(t("orders"), "o_orderpriority", "o_totalprice", agg)
        return rounded(table.withColumnRenamed("o_totalprice", "v"), **digits(agg))

    @query(f"pivot_cross_{_agg}", "select l_returnflag, " + ", ".join(
        sql_measure(_agg, f"case when l_linestatus = '{s}' then l_extendedprice end") + f' as "{s}"' for s in "FO"
    ) + " from lineitem group by l_returnflag")
    def pivoted(t, agg=_agg):
        table = pivot_cross(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", agg)
        return table if agg == "count" else rounded(table, F=4, O=4)


@query("pivot_long", """
select l_shipdate, l_linestatus as level, round(sum(l_extendedprice), 4) as value from lineitem group by l_shipdate, l_linestatus""")
def pivoted_long(t):
    return rounded(pivot_long(t("lineitem"), "l_shipdate", "l_linestatus", "l_extendedprice", "sum"), value=4)


@query("chart_bar_color", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity
from lineitem group by l_returnflag, l_linestatus""")
def bars(t):
    return rounded(chart_series(t("lineitem"), "l_returnflag", "l_quantity", "sum", color="l_linestatus"), l_quantity=4)


@query("chart_line_facet", """
select l_shipdate, l_returnflag, l_linestatus, round(median(l_extendedprice), 4) as l_extendedprice
from lineitem group by l_shipdate, l_returnflag, l_linestatus""")
def lines(t):
    series = chart_series(t("lineitem"), "l_shipdate", "l_extendedprice", "median", "l_returnflag", "l_linestatus")
    return rounded(series, l_extendedprice=4)


@query("chart_pie_share", """
with g as (select c_mktsegment, sum(c_acctbal) as m from customer group by c_mktsegment)
select c_mktsegment, round(m, 4) as c_acctbal, round(m / (select sum(m) from g), 8) as share from g""")
def shares(t):
    return rounded(pie_shares(t("customer"), "c_mktsegment", "c_acctbal"), c_acctbal=4, share=8)


for _grain, _unit in (("1d", "day"), ("1w", "week"), ("1mo", "month"), ("1y", "year")):
    @query(f"trend_{_unit}", f"""
    select cast(date_trunc('{_unit}', o_orderdate) as date) as o_orderdate, round(sum(o_totalprice), 2) as o_totalprice
    from orders {'' if _unit != 'month' else "where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31'"}
    group by 1""")
    def trended(t, grain=_grain):
        span = (datetime.date(1996, 1, 1), datetime.date(1998, 12, 31))
        rows = apply_filters(t("orders"), {"o_orderdate": span}) if grain == "1mo" else t("orders")
        return rounded(trend(rows, "o_orderdate", "o_totalprice", grain=grain), o_totalprice=2)


@query("trend_ts_daily", "select cast(ts as date) as ts, max(value) as value from events group by 1")
def daily(t):
    return trend(t("events"), "ts", "value", agg="max")


@query("trend_auto_mean", """
select cast(l_shipdate as date) as l_shipdate, round(avg(l_extendedprice) + 0.0000001, 4) as l_extendedprice
from lineitem group by 1""")
def auto_mean(t):
    # The small shift keeps exact halves (small groups of cent values) off the rounding edge.
    means = trend(t("lineitem"), "l_shipdate", "l_extendedprice", agg="mean")
    return means.select("l_shipdate", F.round(F.col("l_extendedprice") + 0.0000001, 4).alias("l_extendedprice"))


@query("trend_string_dates", """
select cast(date_trunc('month', o_orderdate) as date) as placed, round(sum(o_totalprice), 2) as o_totalprice
from orders where o_orderkey % 9 <> 0 group by 1""")
def text_dates(t):
    # Every ninth date is spoiled, which the operator has to drop by itself.
    src = t("orders").select(
        F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("placed"),
        "o_totalprice",
    )
    return rounded(text_trend(src, "placed", "o_totalprice", grain="1mo"), o_totalprice=2)


WIDE_YEARS = range(1995, 2002)


def wide_years(t):
    return t("orders").groupBy("o_custkey").agg(*[
        F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))).alias(f"F{y}") for y in WIDE_YEARS
    ])


YEAR_ROWS = f"""
select o.o_custkey, y.y as "Year", sum(case when year(o.o_orderdate) = y.y then o.o_totalprice end) as value
from orders o, (select unnest([{', '.join(map(str, WIDE_YEARS))}])::bigint as y) y group by 1, 2"""


@query("melt_years", f'select o_custkey, "Year", round(value, 2) as value from ({YEAR_ROWS})')
def melted(t):
    return rounded(melt_years(wide_years(t), [f"F{y}" for y in WIDE_YEARS]), value=2)


@query("trend_years", f'select "Year", round(avg(value), 4) as value from ({YEAR_ROWS}) group by 1')
def by_year(t):
    return rounded(year_trend(wide_years(t), [f"F{y}" for y in WIDE_YEARS], "mean"), value=4)


@query("trend_raw", "select ts, value from events")
def raw_points(t):
    return raw_trend(t("events"), "ts", "value")


@query("histogram_30", """
with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders),
c as (select least(cast(floor((o_totalprice - lo) / w) as int), 29) as bin, count(*) as n from orders, b group by 1)
select r.bin::int as bin, round(lo + r.bin * w, 4) as bin_start, round(lo + (r.bin + 1) * w, 4) as bin_end,
  coalesce(n, 0) as count
from (select unnest(range(30)) as bin) r cross join b left join c on c.bin = r.bin""")
def bins(t):
    return rounded(histogram(t("orders"), "o_totalprice"), bin_start=4, bin_end=4)


@query("histogram_nice", """
with b as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part),
c as (select d * power(10::double, e) as step from (select unnest([1, 2, 5]) as d), (select unnest(range(-3, 7)) as e)),
s as (select min(step) as step from b, c where floor(hi / step) - floor(lo / step) + 1 <= 30)
select floor(p_retailprice / step) * step as bin_start, (floor(p_retailprice / step) + 1) * step as bin_end, count(*) as count
from part, s group by 1, 2""")
def nice_bins(t):
    return nice_histogram(t("part"), "p_retailprice")


BOXES = """
q as (select event_type, count(*) as n, quantile_cont(value, 0.25) as q1, median(value) as median,
        quantile_cont(value, 0.75) as q3 from events group by 1),
f as (select e.event_type, e.value, q.*exclude(event_type), q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
      from events e join q using (event_type))"""


@query("boxplot_stats", f"""
with {BOXES}
select event_type, any_value(n) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3, min(case when value between lo and hi then value end) as whisker_low,
  max(case when value between lo and hi then value end) as whisker_high,
  count(*) filter (value not between lo and hi) as outliers
from f group by event_type""")
def boxes(t):
    return rounded(boxplot(t("events"), "event_type", "value"), q1=6, median=6, q3=6)


@query("boxplot_outliers", f"with {BOXES} select event_type, value from f where value not between lo and hi")
def box_outliers(t):
    return boxplot_outliers(t("events"), "event_type", "value")


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE_HASH = "md5(concat_ws('-', '0', " + ", ".join(f"{c}::varchar" for c in LINE_KEY) + "))"


@query("scatter_sample", f"""
select l_quantity, l_extendedprice from lineitem order by {SQL_LINE_HASH}, l_quantity, l_extendedprice limit 20000""")
def points(t):
    return scatter(t("lineitem"), "l_quantity", "l_extendedprice", key=LINE_KEY, cap=20_000)


@query("sample_cap", f"select * from lineitem order by {SQL_LINE_HASH} limit 50000")
def capped(t):
    return sample_rows(t("lineitem"), 50_000, key=LINE_KEY)


@query("heatmap_long", """
select l_returnflag as row, l_linestatus as col, round(sum(l_quantity), 2) as value from lineitem group by 1, 2""")
def heatmap(t):
    return rounded(matrix_long(pivot_cross(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum"), "l_returnflag"), value=2)


def orders_board(t):
    return dashboard(
        t("orders"), {"o_totalprice": (10000.0, 400000.0)}, selected=["F"], key=["o_orderkey"], metric="o_totalprice"
    )


@query("dashboard_category", """
with g as (select o_orderstatus, avg(o_totalprice) as m from orders where o_totalprice between 10000 and 400000 group by 1)
select o_orderstatus, round(m, 4) as o_totalprice, (select count(*) from g) as total_categories from g""")
def board_category(t):
    return rounded(orders_board(t)["category"], o_totalprice=4)


@query("dashboard_trend", """
select o_orderdate, o_totalprice from orders where o_totalprice between 10000 and 400000 and o_orderstatus = 'F'""")
def board_trend(t):
    return orders_board(t)["trend"]


@query("dashboard_drill", """
with g as (select o_orderpriority, avg(o_totalprice) as m from orders
           where o_totalprice between 10000 and 400000 and o_orderstatus = 'F' group by 1)
select o_orderpriority, round(m, 4) as o_totalprice, (select count(*) from g) as total_categories from g""")
def board_drill(t):
    return rounded(orders_board(t)["drill_down"], o_totalprice=4)

"""Row filters."""

import datetime

from pyspark.sql import functions as F

from ..operators.filters import (
    apply_filters, apply_question_filters, cross_filter, drop_missing, sanitize_missing,
)
from ..operators.profile import kpi_cards
from .inputs import HOLED_CUSTOMER, ODD_EVENTS, holed_customer, odd_events
from .registry import query, rounded


@query("filter_membership", "select * from orders where o_orderstatus in ('F', 'P')")
def membership(t):
    return apply_filters(t("orders"), {"o_orderstatus": ["F", "P"]})


@query("filter_membership_cast", "select * from labels where cast(quality as varchar) in ('1')")
def membership_cast(t):
    return apply_filters(t("labels"), {"quality": ["1"]})


@query("filter_range_num", "select * from orders where o_totalprice between 50000 and 150000")
def numeric_range(t):
    return apply_filters(t("orders"), {"o_totalprice": (50000.0, 150000.0)})


@query("filter_range_date", """
select * from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31'""")
def date_range(t):
    return apply_filters(t("orders"), {"o_orderdate": (datetime.date(1996, 1, 1), datetime.date(1996, 12, 31))})


@query("filter_year", """
select o_orderkey, year(o_orderdate)::int as order_year from orders where year(o_orderdate) in (1996, 1998)""")
def years(t):
    dated = t("orders").select("o_orderkey", F.year("o_orderdate").alias("order_year"))
    return apply_filters(dated, {"order_year": [1996, 1998]})


@query("filter_conjunction", """
select * from lineitem where l_returnflag in ('R', 'A') and l_quantity between 10 and 30
  and l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31'""")
def conjunction(t):
    return apply_filters(t("lineitem"), {
        "l_returnflag": ["R", "A"], "l_linestatus": [], "l_quantity": (10.0, 30.0),
        "l_shipdate": (datetime.datetime(1996, 1, 1), datetime.datetime(1997, 12, 31)),
    })


@query("filter_intent", "select * from customer where c_mktsegment = 'BUILDING'")
def question_filters(t):
    return apply_question_filters(t("customer"), {"c_mktsegment": "BUILDING", "no_such_column": "x"})


@query("cross_filter_kpis", """
select count(*) as rows, 11::int as columns, round(sum(l_quantity), 2) as total_l_quantity,
  round(sum(l_extendedprice), 2) as total_l_extendedprice
from lineitem where l_returnflag in ('R')""")
def cross_filtered_kpis(t):
    kept = cross_filter(t("lineitem"), "l_returnflag", ["R"])
    cards = kpi_cards(kept, totals=["l_quantity", "l_extendedprice"])
    return rounded(cards, total_l_quantity=2, total_l_extendedprice=2)


@query("sanitize_missing", f"""
select event_id, case when isnan(value) or isinf(value) then null else value end as value from ({ODD_EVENTS})""")
def sanitized(t):
    return sanitize_missing(odd_events(t))


@query("dropna_subset", f"select * from ({HOLED_CUSTOMER}) where c_acctbal is not null and c_mktsegment is not null")
def complete_rows(t):
    return drop_missing(holed_customer(t), ["c_acctbal", "c_mktsegment"])

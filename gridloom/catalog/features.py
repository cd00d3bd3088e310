"""Feature preparation and ranking."""

from pyspark.sql import functions as F

from ..operators import prepare, rank
from .diagnose import bin_sql, edges_sql, information_sql
from .registry import query, rounded


@query("drop_identifiers", "select c_acctbal, c_mktsegment from customer")
def without_identifiers(t):
    # c_custkey is renamed to show the name rule; c_nationkey goes by the text rule as near-unique text.
    src = t("customer").select(
        F.col("c_custkey").alias("customer_id"), "c_name", "c_acctbal", "c_mktsegment",
        F.concat_ws("/", "c_nationkey", "c_custkey").alias("address"),
    )
    return prepare.drop_identifiers(src)


@query("epochize", "select event_id, epoch_us(ts) / 1000000.0::double as ts, value from events")
def epochs(t):
    return prepare.epochize(t("events").select("event_id", "ts", "value"))


@query("encode_target", """
select o_orderkey, o_orderstatus, (dense_rank() over (order by o_orderstatus) - 1)::int as o_orderstatus_code from orders""")
def codes(t):
    return prepare.encode_target(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("class_codes", """
select label, (row_number() over (order by label) - 1)::int as code from (select distinct p_name as label from part)""")
def label_codes(t):
    return prepare.class_codes(t("part"), "p_name")


@query("target_classes", "select distinct o_orderpriority as label from orders")
def classes(t):
    return t.spark.createDataFrame([(c,) for c in prepare.target_classes(t("orders"), "o_orderpriority")], "label string")


def labelled_documents(t):
    """Labelled documents with the columns a model may use."""
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return t("labels").join(docs, "doc_id")


@query("prep_matrix", """
with d as (select lang, source || '-' || lang as channel, n_chars from labels join documents using (doc_id)),
c as (select channel, count(*) as n, row_number() over (order by count(*) desc, channel desc) as rn, count(*) over () as levels from d group by channel)
select 'lang' as column_name, lang as level, count(*) as ones, null::double as total from d group by lang
union all select 'channel', case when levels > 20 and rn > 19 then '<rare>' else channel end, sum(n)::bigint, null from c group by 1, 2
union all select 'n_chars', 'value', count(*), round(sum(n_chars)::double, 2) from d""")
def matrix(t):
    src = labelled_documents(t).withColumn("channel", F.concat_ws("-", "source", "lang"))
    encoder = prepare.feature_encoder(src, ["n_chars", "lang", "channel"])
    model = encoder.fit(src)
    names = [("n_chars", "value"), *model.level_rows()]
    values = src.select(model.feature_array(src).alias("f"))
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("level"), F.col("f")[i].alias("x"))
        for i, (c, v) in enumerate(names)
    ])
    number = F.col("column_name") == "n_chars"
    return values.select(F.inline(entries)).groupBy("column_name", "level").agg(
        F.when(F.first(number), F.count(F.lit(1))).otherwise(F.sum("x").cast("long")).alias("ones"),
        F.when(F.first(number), F.round(F.sum("x"), 2)).alias("total"),
    )


@query("ordinal_encode", """
select p_partkey::double as p_partkey, (dense_rank() over (order by p_brand) - 1)::double as p_brand,
  (dense_rank() over (order by p_type) - 1)::double as p_type,
  coalesce(size, median(size) over ())::double as size
from (select *, case when p_partkey % 7 <> 0 then p_size end as size from part)""")
def ordinals(t):
    src = t("part").select(
        "p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size")
    )
    return prepare.ordinal_encode(src)


@query("rank_variance", """
select 'p_size' as feature, round(var_pop(p_size), 4) as score from part
union all select 'p_retailprice', round(var_pop(p_retailprice), 4) from part
union all select 'p_partkey', round(var_pop(p_partkey), 4) from part""")
def variances(t):
    return rounded(rank.variance_filter(t("part"), ["p_size", "p_retailprice", "p_partkey"], threshold=0.1), score=4)


@query("rank_mi_class", f"""
with {edges_sql('price_edges', 'orders', 'o_totalprice')}, {edges_sql('cust_edges', 'orders', 'o_custkey')},
src as (select o_orderstatus, o_orderpriority, {bin_sql('price_edges', 'o_totalprice')} as price_bin,
  {bin_sql('cust_edges', 'o_custkey')} as cust_bin from orders)
select feature, round(score, 6) as score from ({information_sql('src', {
    'o_totalprice': 'price_bin', 'o_custkey': 'cust_bin', 'o_orderpriority': 'o_orderpriority'}, 'o_orderstatus')})""")
def class_information(t):
    return rounded(rank.information_scores(t("orders"), ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderstatus"), score=6)


@query("rank_mi_reg", f"""
with {edges_sql('price_edges', 'part', 'p_retailprice')}, {edges_sql('size_edges', 'part', 'p_size')},
src as (select p_brand, p_type, {bin_sql('price_edges', 'p_retailprice')} as price_bin,
  {bin_sql('size_edges', 'p_size')} as size_bin from part)
select feature, round(score, 6) as score from ({information_sql('src', {
    'p_size': 'size_bin', 'p_brand': 'p_brand', 'p_type': 'p_type'}, 'price_bin')})""")
def number_information(t):
    return rounded(rank.information_scores(t("part"), ["p_size", "p_brand", "p_type"], "p_retailprice"), score=6)


CHI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
CHI_SQL = " union all ".join(f"""
select '{c}' as feature, sum((o - e) ** 2 / e) as score from (
  select o, n / sum(n) over () * sum(o) over () as e from (
    select l_returnflag, count(*)::double as n, sum({c}) as o from lineitem group by 1))""" for c in CHI_FEATURES)


@query("rank_chi2", f"select feature, round(score, 4) as score from ({CHI_SQL})")
def chi_squares(t):
    return rounded(rank.chi2_scores(t("lineitem"), CHI_FEATURES, "l_returnflag"), score=4)


@query("rank_l1")
def coefficients(t):
    return rank.l1_scores(t("part"), ["p_size", "p_brand", "p_type"], "p_retailprice", "regression")


@query("rank_l1_class")
def class_coefficients(t):
    return rank.l1_scores(t("orders"), ["o_totalprice", "o_orderpriority"], "o_orderstatus", "classification")


@query("rank_tree")
def importances(t):
    return rank.tree_scores(t("part"), ["p_size", "p_brand", "p_type"], "p_retailprice", "regression")


@query("rank_unified", f"""
with v as (select 'l_quantity' as feature, var_pop(l_quantity) as score from lineitem
  union all select 'l_extendedprice', var_pop(l_extendedprice) from lineitem
  union all select 'l_discount', var_pop(l_discount) from lineitem),
a as (select * from v union all select * from ({CHI_SQL}))
select feature, round(avg(score), 2) as importance from a group by feature""")
def unified(t):
    lines = t("lineitem")
    return rounded(rank.unify([
        rank.variance_scores(lines, CHI_FEATURES), rank.chi2_scores(lines, CHI_FEATURES, "l_returnflag"),
    ]), importance=2)

"""Splits, folds, metrics and fairness, on predictions made by rule."""

from pyspark.sql import functions as F

from ..operators import metrics, split
from .registry import query, rounded


def hash_sql(*keys: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('-', '{seed}', {', '.join(f'{k}::varchar' for k in keys)})), 1, 13))::bigint"


RANGE = float(16 ** 13)


@query("split_random", f"select o_orderkey, {hash_sql('o_orderkey')} < {int(0.8 * RANGE)} as is_train from orders")
def random_split(t):
    return split.random_split(t("orders").select("o_orderkey"), ["o_orderkey"])


@query("split_stratified", f"""
select doc_id, toxic, rank() over (partition by toxic order by {hash_sql('doc_id')}) - 1
  < floor(count(*) over (partition by toxic) * 0.8::double) as is_train from labels""")
def stratified(t):
    return split.stratified_split(t("labels").select("doc_id", "toxic"), "toxic", ["doc_id"])


@query("split_time", f"""
select event_id, row_number() over (order by ts, {hash_sql('event_id')}) <= floor(count(*) over () * 0.8::double) as is_train
from events""")
def timed(t):
    return split.time_split(t("events"), "ts", ["event_id"]).select("event_id", "is_train")


@query("split_time_ties", f"""
select o_orderkey, row_number() over (order by year(o_orderdate), {hash_sql('o_orderkey')}) <= floor(count(*) over () * 0.8::double) as is_train
from orders""")
def tied(t):
    # Only seven distinct times, so the cut falls inside a large group of equal ones.
    src = t("orders").select("o_orderkey", F.year("o_orderdate").alias("placed"))
    return split.time_split(src, "placed", ["o_orderkey"]).select("o_orderkey", "is_train")


@query("kfold_assign", f"select o_orderkey, floor({hash_sql('o_orderkey')} / {RANGE}::double * 5)::int as fold from orders")
def folds(t):
    return split.kfold(t("orders").select("o_orderkey"), ["o_orderkey"], 5)


@query("kfold_stratified", f"""
with r as (select doc_id, quality, rank() over (partition by quality order by {hash_sql('doc_id')}) - 1 as p,
  count(*) over (partition by quality) as n from labels)
select doc_id, quality, (""" + " + ".join(
    f"(p >= floor(n * ({i} / 5.0::double)))::int" for i in range(1, 5)) + ")::int as fold from r")
def stratified_folds(t):
    return split.stratified_kfold(t("labels").select("doc_id", "quality"), "quality", ["doc_id"], 5)


@query("kfold_time", f"""
with r as (select event_id, row_number() over (order by ts, {hash_sql('event_id')}) - 1 as p, count(*) over () as n from events)
select event_id, (""" + " + ".join(f"(p >= n - {3 - i} * (n // 4))::int" for i in range(3)) + ")::int as block from r")
def time_blocks(t):
    return split.time_folds(t("events"), "ts", ["event_id"], 3).select("event_id", "block")


def judged_labels(t):
    """Labels beside a prediction from the text length."""
    docs = t("documents").select("doc_id", "n_chars", "lang")
    return t("labels").join(docs, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("actual"), (F.col("n_chars") > 700).cast("int").alias("predicted"),
        "n_chars",
    )


JUDGED = """(select doc_id, lang, quality as actual, (n_chars > 700)::int as predicted, n_chars
  from labels join documents using (doc_id))"""


def binary_sql(where: str = "true") -> str:
    return f"""
    select case when tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end::double as f1,
      case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end::double as precision,
      case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end::double as recall,
      (tp + tn) / n::double as accuracy, n from (
      select count(*) filter (actual = 1 and predicted = 1) as tp, count(*) filter (actual = 0 and predicted = 1) as fp,
        count(*) filter (actual = 1 and predicted = 0) as fn, count(*) filter (actual = 0 and predicted = 0) as tn, count(*) as n
      from {JUDGED} where {where})"""


@query("metrics_binary", f"""
select round(f1, 8) as f1, round(precision, 8) as precision, round(recall, 8) as recall, round(accuracy, 8) as accuracy, n
from ({binary_sql()})""")
def binary(t):
    return rounded(metrics.class_metrics(judged_labels(t), "actual", "predicted"), f1=8, precision=8, recall=8, accuracy=8)


def judged_orders(t):
    guess = F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 150000, "O").otherwise("P")
    return t("orders").select("o_orderkey", F.col("o_orderstatus").alias("actual"), guess.alias("predicted"))


JUDGED_ORDERS = """(select o_orderkey, o_orderstatus as actual, case when o_totalprice > 300000 then 'F'
  when o_totalprice > 150000 then 'O' else 'P' end as predicted from orders)"""


@query("metrics_weighted", f"""
with j as {JUDGED_ORDERS}, c as (select label, (select count(*) from j where actual = label and predicted = label)::double as tp,
    (select count(*) from j where predicted = label) as said, (select count(*) from j where actual = label) as truth
  from (select distinct actual as label from j))
select round(sum(truth * 2 * tp / (said + truth)) / sum(truth), 8) as f1, round(sum(truth * tp / said) / sum(truth), 8) as precision,
  round(sum(tp) / sum(truth), 8) as recall, round(sum(tp) / sum(truth), 8) as accuracy, sum(truth)::bigint as n from c""")
def weighted(t):
    return rounded(metrics.class_metrics(judged_orders(t), "actual", "predicted"), f1=8, precision=8, recall=8, accuracy=8)


@query("metric_roc_auc", f"""
with g as (select n_chars as s, sum(actual)::double as pos, sum(1 - actual)::double as neg from {JUDGED} group by 1),
w as (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g)
select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 8) as roc_auc from w""")
def roc(t):
    return rounded(metrics.ranking_metrics(judged_labels(t), "actual", "n_chars"), roc_auc=8).select("roc_auc")


@query("metric_pr_auc", f"""
with g as (select n_chars as s, sum(actual)::double as pos, count(*)::double as n from {JUDGED} group by 1),
w as (select pos, sum(pos) over (order by s desc) as cp, sum(n) over (order by s desc) as cn from g)
select round(sum(pos * cp / cn) / sum(pos), 8) as pr_auc from w""")
def pr(t):
    return rounded(metrics.ranking_metrics(judged_labels(t), "actual", "n_chars"), pr_auc=8).select("pr_auc")


@query("metrics_ranking_large", """
with g as (select o_totalprice as s, sum((o_orderstatus = 'F')::int)::double as pos, sum((o_orderstatus <> 'F')::int)::double as neg from orders group by 1),
w as (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below,
  sum(pos) over (order by s desc) as cp, sum(pos + neg) over (order by s desc) as cn from g)
select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 8) as roc_auc, round(sum(pos * cp / cn) / sum(pos), 8) as pr_auc from w""")
def both_areas(t):
    return rounded(metrics.ranking_metrics(t("orders"), "o_orderstatus", "o_totalprice", positive="F"), roc_auc=8, pr_auc=8)


LINE_MODEL = "(select *, l_quantity * 2550 as predicted from lineitem)"


def judged_lines(t):
    return t("lineitem").withColumn("predicted", F.col("l_quantity") * 2550)


ERRORS_SQL = """round(sqrt(avg((l_extendedprice - predicted) ** 2)), 4) as rmse, round(avg(abs(l_extendedprice - predicted)), 4) as mae,
  round(1 - avg((l_extendedprice - predicted) ** 2) / var_pop(l_extendedprice), 6) as r2,
  round(avg(abs(l_extendedprice - predicted) / greatest(abs(l_extendedprice), 1e-8)) * 100, 6) as mape, count(*) as n"""


@query("metrics_regression", f"select {ERRORS_SQL} from {LINE_MODEL}")
def errors(t):
    return rounded(metrics.error_metrics(judged_lines(t), "l_extendedprice", "predicted"), rmse=4, mae=4, r2=6, mape=6)


@query("fold_average", """
with s as (select user_id % 3 as model, user_id, case when user_id % 10 = 0 then 'inf'::double else avg(value) end as score from events group by user_id)
select model, round(avg(score), 6) as score from s where not isinf(score) group by model""")
def averaged(t):
    per_user = t("events").groupBy("user_id").agg(F.avg("value").alias("score"))
    scores = per_user.select(
        (F.col("user_id") % 3).alias("model"), F.when(F.col("user_id") % 10 == 0, float("inf")).otherwise(F.col("score")).alias("score")
    )
    return rounded(metrics.fold_average(scores, ["model"], "score"), score=6)


@query("confusion_matrix", f"""
with j as {JUDGED_ORDERS}
select c.label as actual, count(*) filter (predicted = 'F') as "F", count(*) filter (predicted = 'O') as "O",
  count(*) filter (predicted = 'P') as "P", count(*) filter (predicted = 'X') as "X"
from (select unnest(['F', 'O', 'P', 'X']) as label) c left join j on actual = label group by 1""")
def confusion(t):
    return metrics.confusion_matrix(judged_orders(t), "actual", "predicted", ["F", "O", "P", "X"])


@query("residual_pairs", """
with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem)
select l_extendedprice as actual, round(predicted, 4) as predicted from (
  select l_extendedprice, a + b * l_quantity as predicted from lineitem, m)""")
def residuals(t):
    lines = t("lineitem")
    fit = lines.agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a")
    ).first()
    judged = lines.withColumn("predicted", fit["a"] + fit["b"] * F.col("l_quantity"))
    return rounded(metrics.prediction_pairs(judged, "l_extendedprice", "predicted"), predicted=4)


FAIR_SQL = " union all ".join(
    f"select '{g}' as lang, f1, accuracy, n from ({binary_sql(where)}) where n > 0"
    for g, where in (("en", "lang = 'en'"), ("fr", "lang = 'fr'"), ("de", "lang = 'de'"), ("es", "lang = 'es'"))
)


@query("fairness_class", f"select lang, round(f1, 8) as f1, round(accuracy, 8) as accuracy, n from ({FAIR_SQL})")
def fair_classes(t):
    return rounded(metrics.group_class_metrics(judged_labels(t), "actual", "predicted", "lang"), f1=8, accuracy=8)


@query("fairness_reg", f"""
select l_returnflag, round(sqrt(avg((l_extendedprice - predicted) ** 2)), 4) as rmse, count(*) as n from {LINE_MODEL} group by 1""")
def fair_errors(t):
    return rounded(metrics.group_error_metrics(judged_lines(t), "l_extendedprice", "predicted", "l_returnflag"), rmse=4)


@query("disparity_alert", f"""
select 'f1' as metric, round(max(f1) - min(f1), 8) as gap, 0.1::double as max_gap, max(f1) - min(f1) > 0.1 as alert from ({FAIR_SQL})""")
def alert(t):
    groups = metrics.group_class_metrics(judged_labels(t), "actual", "predicted", "lang")
    return rounded(metrics.disparity(groups, "f1", metrics.CLASS_GAP), gap=8)

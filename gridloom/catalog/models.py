"""Model fits, neighbours, the leaderboard, importances, scoring and saved models."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators.models import CLASSIFIERS, REGRESSORS, candidates, fit_model, load_model, save_model, score_rows
from ..operators.neighbors import knn_classify, knn_regress, nearest_neighbors, standardize
from ..operators.prepare import encode_target, target_classes
from ..operators.split import random_split
from ..plans.leaderboard import leaderboard, permutation_importance, permuted
from ..session import scratch_path
from .evaluate import RANGE, hash_sql
from .features import labelled_documents
from .registry import query, rounded

TRAIN_LIMIT = int(0.8 * RANGE)
DOC_FEATURES = ["n_chars", "lang", "source"]


def documents_split(t):
    rows = random_split(labelled_documents(t), ["doc_id"])
    return rows.where("is_train"), rows.where("not is_train")


def vectors_split(t):
    rows = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = random_split(rows, ["vec_id"])
    return rows.where("is_train"), rows.where("not is_train")


def predicted(model, rows, key, label):
    return model.transform(rows).select(key, F.col(label).alias("actual"), F.col("prediction"))


def fitted_on_documents(t, name, **params):
    train, test = documents_split(t)
    model = fit_model(train, CLASSIFIERS[name], DOC_FEATURES, "quality", classes=2, **params)
    return predicted(model, test, "doc_id", "quality")


def fitted_on_vectors(t, name, **params):
    train, test = (rows.withColumn("features", array_to_vector("embedding")) for rows in vectors_split(t))
    model = fit_model(train, CLASSIFIERS[name], None, "label", classes=10, **params)
    return predicted(model, test, "vec_id", "label")


def fitted_on_parts(t, name, **params):
    rows = random_split(t("part"), ["p_partkey"])
    model = fit_model(rows.where("is_train"), REGRESSORS[name], ["p_size", "p_brand", "p_type"], "p_retailprice", **params)
    return predicted(model, rows.where("not is_train"), "p_partkey", "p_retailprice")


def bayes_sql(rows: str) -> str:
    """Gaussian naive Bayes in closed form. ``rows`` selects id, label, v (features), trains, asked; gives (id, label, said)."""
    return f"""
r as ({rows}),
e as (select id, label, trains, asked, unnest(v)::double as x, generate_subscripts(v, 1) as i from r),
prior as (select label, ln(count(*)) - ln(sum(count(*)) over ()) as p from r where trains group by label),
m as (select label, i, avg(x) as mu, var_pop(x) as var from e where trains group by label, i),
least as (select 1e-9 * max(var) as eps from (select var_pop(x) as var from e where trains group by i)),
ll as (select e.id, m.label, any_value(p) - sum(ln(2 * pi() * (var + eps)) + (x - mu) ** 2 / (var + eps)) / 2 as l
  from e join m using (i) join prior on prior.label = m.label, least where asked group by e.id, m.label),
said as (select id, arg_max(label, l) as said from ll group by id),
answer as (select id, label, said from said join r using (id))"""


@query("fit_log_reg")
def log_reg(t):
    return fitted_on_documents(t, "log_reg")


@query("fit_rf")
def forest(t):
    return fitted_on_documents(t, "rf")


@query("fit_linear_svc")
def svc(t):
    return fitted_on_documents(t, "svm")


BAYES_VECTORS = bayes_sql(f"""
select vec_id as id, label, embedding as v, {hash_sql('vec_id')} < {TRAIN_LIMIT} as trains,
  {hash_sql('vec_id')} >= {TRAIN_LIMIT} as asked from embeddings""")


@query("fit_nb", f"with {BAYES_VECTORS} select id as vec_id, label as actual, said::double as prediction from answer")
def bayes(t):
    return fitted_on_vectors(t, "nb")


@query("fit_mlp")
def perceptron(t):
    return fitted_on_vectors(t, "mlp")


@query("fit_svm_kernel")
def kernel_svc(t):
    return fitted_on_documents(t, "svm_kernel")


@query("fit_mlp_adam")
def network(t):
    return fitted_on_documents(t, "mlp_adam")


@query("fit_svr")
def kernel_regressor(t):
    return fitted_on_parts(t, "svr")


@query("fit_mlp_reg")
def network_regressor(t):
    return fitted_on_parts(t, "mlp_reg")


@query("fit_gbt")
def boosted(t):
    return fitted_on_documents(t, "gbt")


@query("fit_lin_reg")
def linear(t):
    return fitted_on_parts(t, "lin_reg")


@query("fit_rf_reg")
def forest_regressor(t):
    return fitted_on_parts(t, "rf_reg")


@query("fit_gbt_reg")
def boosted_regressor(t):
    return fitted_on_parts(t, "gbt_reg")


@query("lin_reg_closed_form", """
select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept
from lineitem""")
def closed_form(t):
    model = fit_model(t("lineitem"), REGRESSORS["lin_reg"], ["l_quantity"], "l_extendedprice")
    scaler, line = model.stages[-2], model.stages[-1]
    slope = float(line.coefficients[0]) / float(scaler.std[0])
    rows = [(slope, float(line.intercept) - slope * float(scaler.mean[0]))]
    return rounded(t.spark.createDataFrame(rows, "slope double, intercept double"), slope=4, intercept=2)


NEAR_SQL = f"""
s as (select vec_id, label, embedding, {hash_sql('vec_id')} < {TRAIN_LIMIT} as is_train from embeddings),
e as (select vec_id, label, is_train, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from s),
m as (select i, avg(x) as m, stddev_pop(x) as s from e where is_train group by i),
z as (select vec_id, any_value(label) as label, any_value(is_train) as is_train, list((x - m.m) / m.s order by i) as v
      from e join m using (i) group by vec_id),
near as (select q.vec_id, p.label, p.vec_id as neighbor, list_distance(q.v, p.v) as d,
  row_number() over (partition by q.vec_id order by list_distance(q.v, p.v), p.vec_id) as rn
  from z q, z p where not q.is_train and p.is_train)"""


def standardized_vectors(t):
    train, test = vectors_split(t)
    return standardize(train, "embedding"), standardize(test, "embedding", fit_on=train)


@query("knn_neighbors", f"""
with {NEAR_SQL} select vec_id, neighbor, round(d, 6) as distance, rn::int as position from near where rn <= 5""")
def neighbours(t):
    train, test = standardized_vectors(t)
    return rounded(nearest_neighbors(test, "vec_id", train, "vec_id", "embedding").drop("payload"), distance=6)


@query("knn_classify", f"""
with {NEAR_SQL}, votes as (select vec_id, label, count(*) as n from near where rn <= 5 group by 1, 2)
select vec_id, arg_min(label, (-n, label)) as prediction, max(n) / sum(n)::double as share from votes group by 1""")
def voted(t):
    train, test = standardized_vectors(t)
    return knn_classify(train, test, "vec_id", "embedding", "label")


@query("knn_regress", f"with {NEAR_SQL} select vec_id, round(avg(label), 6) as prediction from near where rn <= 5 group by 1")
def averaged(t):
    train, test = standardized_vectors(t)
    return rounded(knn_regress(train, test, "vec_id", "embedding", "label"), prediction=6)


@query("model_candidates", """
select unnest(['log_reg', 'rf', 'knn', 'svm', 'nb', 'mlp', 'gbt', 'svm_kernel', 'mlp_adam']) as model,
       unnest([true, true, true, true, true, true, count(*) >= 1000, true, true]) as recommended,
       unnest([null, null, null, null, null, null, case when count(*) < 1000 then 'fewer than 1000 rows' end, null, null]) as reason
from labels join documents using (doc_id)""")
def shortlist(t):
    found = candidates("classification", labelled_documents(t).count(), len(DOC_FEATURES), 2)
    return t.spark.createDataFrame(
        [(c.spec.name, c.recommended, c.reason) for c in found], "model string, recommended boolean, reason string")


@query("leaderboard_class")
def class_board(t):
    return leaderboard(labelled_documents(t), CLASSIFIERS.values(), DOC_FEATURES, "quality", ["doc_id"], classes=2)


@query("leaderboard_reg")
def number_board(t):
    return leaderboard(
        t("part"), REGRESSORS.values(), ["p_size", "p_brand", "p_type"], "p_retailprice", ["p_partkey"]
    )


@query("leaderboard_time")
def time_board(t):
    return leaderboard(t("events"), REGRESSORS.values(), ["user_id", "event_type"], "value", ["event_id"], time="ts")


@query("permutation_importance")
def shuffled(t):
    train, test = documents_split(t)
    model = fit_model(train, CLASSIFIERS["log_reg"], DOC_FEATURES, "quality", classes=2)
    return permutation_importance(model, test, DOC_FEATURES, "quality", ["doc_id"], "classification")


@query("permuted_rows", f"""
with placed as (select c_custkey, c_acctbal, c_mktsegment, row_number() over (order by {hash_sql('c_custkey')}, c_custkey) - 1 as place,
  count(*) over () as n from customer),
trials as (select feature, repeat::int as repeat, ('0x' || substr(md5('42-' || feature || '-' || repeat), 1, 13))::bigint as drawn
  from (select unnest(['c_acctbal', 'c_mktsegment']) as feature), range(5) r(repeat))
select feature, repeat, a.c_custkey, case when feature = 'c_acctbal' then b.c_acctbal else a.c_acctbal end as c_acctbal,
  case when feature = 'c_mktsegment' then b.c_mktsegment else a.c_mktsegment end as c_mktsegment
from placed a cross join trials join placed b on b.place = (a.place + 1 + drawn % (a.n - 1)) % a.n""")
def moved(t):
    rows = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return permuted(rows, ["c_acctbal", "c_mktsegment"], ["c_custkey"], repeats=5)


def order_model(t):
    orders, features = t("orders"), ["o_totalprice", "o_orderpriority"]
    classes = target_classes(orders, "o_orderstatus")
    coded = encode_target(orders, "o_orderstatus", classes)
    model = fit_model(coded, CLASSIFIERS["nb"], features, "o_orderstatus_code", classes=len(classes))
    return model, features, classes


BAYES_ORDERS = bayes_sql("""
select o_orderkey as id, o_orderstatus as label, true as trains, true as asked, [o_totalprice] || list_transform(
  (select list(distinct o_orderpriority order by o_orderpriority) from orders), lambda p: (o_orderpriority = p)::int::double) as v
from orders""")
SCORED_SQL = f"with {BAYES_ORDERS} select orders.*, said as predicted_o_orderstatus from orders join answer on o_orderkey = id"


@query("score_rows", SCORED_SQL)
def scored(t):
    model, features, classes = order_model(t)
    return score_rows(model, t("orders"), features, "o_orderstatus", classes)


@query("model_roundtrip", SCORED_SQL)
def reloaded(t):
    model, features, classes = order_model(t)
    path = scratch_path(t.spark, "model")
    save_model(model, path)
    return score_rows(load_model(path), t("orders"), features, "o_orderstatus", classes)

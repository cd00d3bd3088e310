"""Sources, sinks and the dataset store."""

from pyspark.sql import functions as F

from ..operators.filters import apply_filters, preview
from ..session import scratch_path
from ..sources.datasets import Datasets
from ..sources.files import convert, read_csv, read_parquet, write_csv, write_parquet
from .registry import query


@query("src_csv_roundtrip", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def csv_source(t):
    path = scratch_path(t.spark, "nation-csv")
    write_csv(t("nation"), path)
    return read_csv(t.spark, path)


@query("src_csv_typed", """
select o_orderkey, o_orderstatus, o_totalprice, o_orderdate::date as o_orderdate, o_orderkey % 2 = 0 as even
from orders""")
def csv_types(t):
    path = scratch_path(t.spark, "orders-csv")
    write_csv(t("orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
    ), path)
    return read_csv(t.spark, path)


@query("src_parquet_scan", "select * from region")
def parquet_source(t):
    return read_parquet(t.spark, f"{t.directory}/region.parquet")


@query("sink_parquet_roundtrip", "select * from supplier")
def parquet_sink(t):
    path = scratch_path(t.spark, "supplier-parquet")
    write_parquet(t("supplier"), path)
    return read_parquet(t.spark, path)


@query("convert_to_parquet", "select * from part")
def conversion(t):
    path = scratch_path(t.spark, "part-parquet")
    convert(t.spark, f"{t.directory}/part.parquet", path)
    return read_parquet(t.spark, path)


@query("sink_csv_roundtrip", """
select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer""")
def csv_sink(t):
    path = scratch_path(t.spark, "customer-csv")
    write_csv(t("customer"), path)
    return read_csv(t.spark, path)


@query("csv_text_roundtrip", "select doc_id, text from documents")
def csv_text(t):
    path = scratch_path(t.spark, "documents-csv")
    write_csv(t("documents").select("doc_id", "text"), path)
    return read_csv(t.spark, path)


@query("catalog_register", """
select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
from orders where o_totalprice >= 100000 group by o_orderstatus""")
def registered_dataset(t):
    store = Datasets(t.spark)
    name = store.derive("orders", apply_filters(t("orders"), {"o_totalprice": (100000.0, float("inf"))}), "large")
    return t.spark.sql(
        f"select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from `{name}` group by o_orderstatus"
    )


@query("preview_head", "select * from orders order by o_orderkey limit 20")
def first_rows(t):
    return preview(t("orders"), 20, ["o_orderkey"])

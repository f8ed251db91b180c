"""The generic test tables in the roles of the marketplace tables.

Each function is a plain projection (plus small joins to nations), so filters and
column pruning reach the parquet scans. Integer arithmetic on the keys plants the
defects that cleaning has to deal with: missing dates, undefined payment types,
zero installments, several reviews per order, duplicate points, unknown categories.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators import cleaning


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A generic table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as order_id",
        "o_orderkey as customer_id",
        # nested if, so that a filter on the role status reaches the scan as a filter on the code
        "if(o_orderstatus = 'F', 'delivered', if(o_orderstatus = 'O', 'shipped', 'canceled'))"
        " as order_status",
        "timestampadd(SECOND, int(o_orderkey * 7919 % 86400), o_orderdate)"
        " as order_purchase_timestamp",
        "case when o_orderkey % 61 = 0 then null"
        " else timestampadd(SECOND, int(o_orderkey * 31 % 172800), o_orderdate) end"
        " as order_approved_at",
        "case when o_orderstatus = 'O' or o_orderkey % 53 = 0 then null"
        " else timestampadd(SECOND, int(o_orderkey * 50021 % 1296000), o_orderdate) end"
        " as order_delivered_carrier_date",
        "case when o_orderstatus = 'O' or o_orderkey % 97 = 0 then null"
        " else timestampadd(SECOND, int(o_orderkey * 104729 % 2592000), o_orderdate) end"
        " as order_delivered_customer_date",
        "timestampadd(DAY, int(10 + o_orderkey % 20), o_orderdate)"
        " as order_estimated_delivery_date")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    orders_ = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders_.join(people, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as customer_id",
        "o_custkey as customer_unique_id",
        "c_nationkey * 100 + cast(c_custkey % 100 as int) as customer_zip_code_prefix",
        "c_mktsegment as customer_city",
        "n_name as customer_state")


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey as seller_id",
        "s_nationkey * 100 + cast(s_suppkey % 100 as int) as seller_zip_code_prefix",
        "s_name as seller_city",
        "n_name as seller_state")


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as order_id",
        "l_linenumber as order_item_id",
        "l_partkey as product_id",
        "l_suppkey as seller_id",
        "l_shipdate as shipping_limit_date",
        "cast(l_extendedprice as decimal(12,2)) as price",
        "cast(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2))"
        " as decimal(12,2)) as freight_value")


def payments_raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as order_id",
        "l_linenumber as payment_sequential",
        "case when l_partkey % 50 = 0 then 'not_defined' when l_returnflag = 'R' then 'credit_card'"
        " when l_returnflag = 'A' then 'boleto' else 'voucher' end as payment_type",
        "cast(l_quantity as int) % 13 as payment_installments",
        "cast(l_extendedprice as decimal(12,2)) as payment_value")


def reviews_raw(spark: SparkSession, folder: str) -> DataFrame:
    # every tenth order's reviews belong to the order before it, so some orders have none
    return table(spark, folder, "lineitem").selectExpr(
        "l_partkey as review_id",
        "if(l_orderkey % 10 = 9, l_orderkey - 1, l_orderkey) as order_id",
        "cast(1 + (l_partkey * 31 + l_suppkey) % 5 as int) as review_score",
        "case when l_partkey % 8 = 0 then l_returnflag end as review_comment_title",
        "case when l_partkey % 3 = 0 then l_linestatus end as review_comment_message",
        "l_shipdate as review_creation_date",
        "l_shipdate as review_answer_timestamp")


def products_raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as product_id",
        "case when p_partkey % 50 = 0 then null else p_type end as product_category_name",
        "case when p_partkey % 50 = 0 then null else length(p_name) end as product_name_lenght",
        "case when p_partkey % 50 = 0 then null else length(p_brand) end"
        " as product_description_lenght",
        "p_size as product_photos_qty",
        "case when p_partkey % 500 = 0 then null else p_size * 100 end as product_weight_g")


def translation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").filter("p_type <> 'PROMO'").selectExpr(
        "p_type as product_category_name",
        "lower(p_type) as product_category_name_english").distinct()


def geolocation_raw(spark: SparkSession, folder: str) -> DataFrame:
    # the second copy of every fourth customer is an exact duplicate point
    return table(spark, folder, "customer").selectExpr(
        "c_nationkey * 100 + cast(c_custkey % 100 as int) as geolocation_zip_code_prefix",
        "cast(c_custkey * 37 % 500 - 400 as double) / cast(10 as double) as geolocation_lat",
        "cast(c_custkey * 53 % 500 - 800 as double) / cast(10 as double) as geolocation_lng",
        "explode(case when c_custkey % 4 = 0 then array(1, 2) else array(1) end) as copy"
    ).drop("copy")


# The one category the translation lacks, added by hand.
EXTRA_TRANSLATIONS = (("PROMO", "promo"),)


def raw_tables(spark: SparkSession, folder: str) -> cleaning.LazyTables:
    builders = {
        "orders": orders, "order_items": order_items, "payments": payments_raw,
        "reviews": reviews_raw, "customers": customers, "products": products_raw,
        "sellers": sellers, "geolocation": geolocation_raw, "translation": translation,
    }
    return cleaning.LazyTables({
        name: partial(build, spark, folder) for name, build in builders.items()})


def clean_tables(spark: SparkSession, folder: str) -> cleaning.LazyTables:
    """The eight cleaned tables; a query only pays for the ones it uses."""
    return cleaning.clean_all(raw_tables(spark, folder), EXTRA_TRANSLATIONS)

"""The driver's tables as raw entities of the retail model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    return (
        o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
        .join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        .select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderdate").cast("string").alias("order_ts"),
            F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "created").otherwise("paid").alias("status"),
            F.col("o_orderpriority").alias("channel"),
            F.lit("eur").alias("currency"),
            F.col("n_name").alias("shipping_country"),
        )
    )


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    i, p = read(spark, d, "lineitem"), read(spark, d, "part")
    return i.join(p.select("p_partkey", "p_retailprice"), i.l_partkey == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.col("p_retailprice").cast("string").alias("unit_price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount_pct"),
        F.col("l_shipdate").alias("_ingested_at"),
        F.col("l_suppkey").alias("supplier_id"),
    )


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    """Each part, and for one of twenty an older version too."""
    p = read(spark, d, "part")
    version = lambda df, name, at: df.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        name.alias("product_name"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 15, " small").when(F.col("p_size") <= 35, "medium").otherwise("large ").alias("subcategory"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("string").alias("list_price"),
        (F.col("p_size") % 10 != 0).cast("string").alias("is_active"),
        F.lit(at).alias("updated_at"),
    )
    return version(p, F.col("p_name"), "2001-01-01 00:00:00").unionByName(version(p.where("p_partkey % 20 = 0"), F.concat("p_name", F.lit(" (old)")), "2000-01-01 00:00:00"))


def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    """A feed of versions: every customer, one of four a second time after a move, one of forty with its first row repeated."""
    c, n, r = (read(spark, d, x) for x in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    mark = F.when(key % 50 == 0, "#").otherwise("@")
    day = F.lit("2000-01-01").cast("date")
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 nations, 5 regions
    first = rows.select(
        key.cast("string").alias("customer_id"),
        F.concat(F.lit(" "), "c_name").alias("full_name"),
        F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), mark, F.lit("mail.example")).alias("email"),
        F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit("+49"), key.cast("string"))).alias("phone"),
        F.lower("n_name").alias("country"),
        F.concat(F.lit("city "), (key % 7).cast("string")).alias("city"),
        F.col("c_mktsegment").alias("segment"),
        F.date_add(F.lit("1994-01-01").cast("date"), (key % 1500).cast("int")).cast("string").alias("signup_date"),
        F.date_add(day, (key % 300).cast("int")).cast("timestamp_ntz").cast("string").alias("updated_at"),
    )
    number = F.col("customer_id").cast("bigint")
    moved = first.where(number % 4 == 0).withColumns({
        "city": F.concat(F.lit("town "), (number % 5).cast("string")), "updated_at": F.date_add(day, (number % 300 + 30).cast("int")).cast("timestamp_ntz").cast("string")
    })
    return first.unionByName(moved).unionByName(first.where(number % 40 == 0))


def raw_clicks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("signup", "page_view", "view", "product_view", "click", "add_to_cart", "purchase", "checkout")])
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("event_ts"),
        F.coalesce(F.try_element_at(kind, "event_type"), F.lit("other")).alias("event_type"),
        k.cast("string").alias("product_id"),
        F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "mobile").otherwise("tablet").alias("device"),
    )

"""Cleaners of the five entities: normalised values, types, one row per key. Dirty values become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import blank_to_null, email_valid

# The domains of the retail model.
STATUSES = ["created", "paid", "shipped", "delivered", "cancelled", "returned"]
REVENUE = ["paid", "shipped", "delivered"]


def keep_latest(df: DataFrame, keys: list[str], order: list[Column], within: str | None = None) -> DataFrame:
    """One row per key: the first by order, which should be total. within: a column that the key determines; rows are dealt by it, so
    that a join on it needs no second shuffle."""
    if within:
        df, keys = df.repartition(within), [within, *keys]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _latest(out: DataFrame, first: list[str]) -> list[Column]:
    """Newest first; every other column breaks ties, so that the winner never depends on the order of rows."""
    return [F.desc_nulls_last(c) for c in first if c in out.columns] + [F.desc_nulls_last(c) for c in sorted(out.columns) if c not in first]


def clean_orders(raw: DataFrame) -> DataFrame:
    """Latest row per order by the time of ingest, or else of the order."""
    status = F.lower(F.trim("status"))
    has = {*raw.columns}
    out = raw.select(
        F.trim("order_id").alias("order_id"),
        blank_to_null("customer_id").alias("customer_id"),
        F.try_to_timestamp("order_ts").cast("timestamp_ntz").alias("order_ts"),
        F.when(status.isin(STATUSES), status).otherwise("unknown").alias("status"),
        F.lower(F.trim("channel")).alias("channel"),
        F.upper(F.trim("currency")).alias("currency"),
        F.upper(F.trim("shipping_country")).alias("shipping_country"),
        *([F.col("discount_pct").try_cast("double").alias("discount_pct")] if "discount_pct" in has else []),
        *([F.col("_ingested_at")] if "_ingested_at" in has else []),
    )
    out = out.withColumns({"order_date": F.to_date("order_ts"), "is_revenue": F.col("status").isin(REVENUE)})
    return keep_latest(out, ["order_id"], _latest(out, ["_ingested_at", "order_ts"]))


def clean_items(raw: DataFrame, within: str | None = None) -> DataFrame:
    """Latest row per item by the time of ingest. within: see keep_latest."""
    number = lambda c, kind: F.trim(c).try_cast(kind)
    out = raw.withColumns({
        **{c: F.trim(c) for c in ("item_id", "order_id", "product_id") if c in raw.columns},
        "quantity": number("quantity", "double").try_cast("int"),
        "unit_price": number("unit_price", "decimal(12,2)"),
    })
    out = out.withColumn("line_amount", (F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)"))
    return keep_latest(out, ["item_id"], _latest(out, ["_ingested_at"]), within)


def clean_customers(raw: DataFrame) -> DataFrame:
    """Every version of a customer (one row for each id and updated_at), with a flag for a well-formed e-mail."""
    out = raw.select(
        F.trim("customer_id").alias("customer_id"),
        F.trim("full_name").alias("full_name"),
        F.lower(F.trim("email")).alias("email"),
        blank_to_null("phone").alias("phone"),
        F.upper(F.trim("country")).alias("country"),
        F.initcap(F.trim("city")).alias("city"),
        F.lower(F.trim("segment")).alias("segment"),
        F.to_date(F.try_to_timestamp("signup_date")).alias("signup_date"),
        F.try_to_timestamp("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )
    out = out.withColumn("is_email_valid", email_valid("email"))
    return keep_latest(out, ["customer_id", "updated_at"], _latest(out, []))


def clean_products(raw: DataFrame) -> DataFrame:
    """Latest row per product by updated_at."""
    out = raw.withColumns({
        "product_id": F.trim("product_id"),
        "product_name": F.trim("product_name"),
        "category": F.initcap(F.trim("category")),
        "subcategory": F.initcap(F.trim("subcategory")),
        "brand": F.trim("brand"),
        "list_price": F.trim("list_price").try_cast("decimal(12,2)"),
    })
    if "is_active" in raw.columns:
        out = out.withColumn("is_active", F.trim(F.col("is_active").cast("string")).try_cast("boolean"))
    if "updated_at" in raw.columns:
        out = out.withColumn("updated_at", F.try_to_timestamp(F.col("updated_at").cast("string")).cast("timestamp_ntz"))
    return keep_latest(out, ["product_id"], _latest(out, ["updated_at"]))


def clean_clicks(raw: DataFrame) -> DataFrame:
    """Projection only, so it works on streams; events are deduplicated by the stream or by keep_latest."""
    text = lambda c, f: f(F.trim(c))
    out = raw.withColumns({
        "event_id": F.trim("event_id"),
        "session_id": blank_to_null("session_id"),
        "customer_id": blank_to_null("customer_id"),
        "product_id": blank_to_null("product_id"),
        "event_type": text("event_type", F.lower),
        "device": text("device", F.lower),
    })
    if dict(raw.dtypes)["event_ts"] == "string":
        out = out.withColumn("event_ts", F.try_to_timestamp("event_ts"))
    return out.withColumns({"event_date": F.to_date("event_ts"), "is_conversion": F.col("event_type") == "checkout"})

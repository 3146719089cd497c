"""Event-time windows over clicks; the same code serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(clicks: DataFrame, key: str = "event_id", late: str = "15 minutes") -> DataFrame:
    """Events once each: on a stream within the watermark, so that state is bounded."""
    timed = clicks.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    return timed.withWatermark("event_ts", late).dropDuplicatesWithinWatermark([key]) if clicks.isStreaming else timed.dropDuplicates([key])


def windowed(clicks: DataFrame, width: str = "5 minutes", late: str = "15 minutes", *, exact: bool = False) -> DataFrame:
    """Distinct events counted per window and device. Sessions and products are approximate, as streams need; exact: for tables."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    out = once(clicks, late=late).groupBy(F.window("event_ts", width).alias("w"), "device").agg(
        F.count("*").alias("events"), distinct("session_id").alias("sessions"), distinct("product_id").alias("products"), F.count_if(F.col("event_type") == "add_to_cart").alias("carts"), F.count_if("is_conversion").alias("checkouts"),
    )
    rate = F.round(F.try_divide(F.col("checkouts").cast("double"), F.nullif("sessions", F.lit(0))), 6)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "device", "events", "sessions", "products", "carts", "checkouts", rate.alias("conversion_rate"))


def enriched(clicks: DataFrame, products: DataFrame) -> DataFrame:
    """Stream or table of clicks with what is known of the product. Products are read anew in each micro-batch."""
    return clicks.join(products.select("product_id", "category", "brand", "list_price"), "product_id", "left")

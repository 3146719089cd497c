"""Dimensions, the fact and the marts. Every function takes frames and gives a lazy frame; 'today' is a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import percent, seconds_between, surrogate_key, total
from quarry.functions.columns import MONEY
from quarry.operators.ranks import tiles


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """A row per day from first to last, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    part = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "week": F.weekofyear, "day_of_week": F.dayofweek}
    out = days.withColumns({k: f("date") for k, f in part.items()})
    return out.withColumns({"day_name": F.date_format("date", "EEEE"), "is_weekend": F.col("day_of_week").isin(1, 7), "month_start": F.trunc("date", "month")})


def dim_customer(customers: DataFrame, today: date) -> DataFrame:
    """One row per current customer, with a hash key and the days since signup."""
    return customers.select(
        surrogate_key("customer_id").alias("customer_sk"), "customer_id", "full_name", "email", "country", "city", "segment", "signup_date", "is_email_valid", "valid_from",
        F.datediff(F.lit(today), "signup_date").alias("tenure_days"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(surrogate_key("product_id").alias("product_sk"), "product_id", "product_name", "category", "subcategory", "brand", "list_price", "is_active")


def sales(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item with its order: what the queries that name no product need. Unknown discounts count as none."""
    discount = (F.col("line_amount") * F.coalesce(F.col("discount_pct").cast("decimal(6,4)"), F.lit(0))).cast(MONEY)
    head = orders.drop("_ingested_at", *(["discount_pct"] if "discount_pct" in items.columns else []))  # an item's own discount counts
    return items.join(head, "order_id").select(
        "item_id", "order_id", "customer_id", "product_id", "order_date", "order_ts", "status", "channel", "currency", "shipping_country", "is_revenue", "quantity", "unit_price",
        F.col("line_amount").alias("gross"), discount.alias("discount"), (F.col("line_amount") - discount).cast(MONEY).alias("net"),
    )


def fact_items(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """sales with what is known of the product, and hash keys. Rows that are no revenue stay; an unknown product has a null category.
    Spark decides on a broadcast of the products by their size."""
    known = products.select("product_id", "category", "subcategory", "brand")
    return sales(orders, items).join(known, "product_id", "left").withColumns({"customer_sk": surrogate_key("customer_id"), "product_sk": surrogate_key("product_id")})


def daily_sales(fact: DataFrame) -> DataFrame:
    """Revenue by day, channel and category."""
    out = fact.where("is_revenue").groupBy("order_date", "channel", "category").agg(
        F.countDistinct("order_id").alias("orders_cnt"), F.countDistinct("customer_id").alias("customers_cnt"), F.sum("quantity").cast("bigint").alias("units"),
        total("gross", "gross_revenue"), total("discount", "discount_total"), total("net", "net_revenue"),
    )
    aov = F.floor(100 * F.col("net_revenue").cast("double") / F.col("orders_cnt") + 0.5) / 100
    return out.withColumn("aov", aov.cast(MONEY))


def with_week_average(daily: DataFrame) -> DataFrame:
    """daily_sales with the mean over seven calendar days of each channel and category."""
    week = Window.partitionBy("channel", "category").orderBy(F.unix_date("order_date")).rangeBetween(-6, 0)
    return daily.withColumn("avg_7d", F.round(F.avg(F.col("net_revenue").cast("double")).over(week), 4))


def customer_revenue(fact: DataFrame) -> DataFrame:
    return fact.where("is_revenue AND customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"), F.countDistinct("order_id").alias("frequency"), total("net", "monetary")
    )


def rfm(fact: DataFrame, today: date) -> DataFrame:
    """Scores from 1 to 5 for recency, frequency and revenue; equal values go by customer_id. No window without a partition."""
    base = customer_revenue(fact).withColumn("recency_days", F.datediff(F.lit(today), "last_order")).persist()  # read by each ranking
    n, scored = base.count(), base
    for name, column, down in (("r", "last_order", True), ("f", "frequency", False), ("m", "monetary", False)):
        scored = tiles(scored, [(column, down), ("customer_id", False)], 5, name, n)
    scored = scored.withColumn("r", 6 - F.col("r"))
    # The segments.
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    segment = F.when((r >= 4) & (f >= 4), "champions").when(r >= 4, "new_or_promising").when((r <= 2) & (m >= 4), "at_risk_high_value").when(r <= 2, "hibernating").otherwise("loyal")
    return scored.withColumns({"rfm_score": r + f + m, "rfm_segment": segment})


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rfm_segment").agg(F.count("*").alias("customers"), total("monetary", "monetary"))


def top_products(fact: DataFrame, n: int = 10) -> DataFrame:
    """The n best products of each category by revenue; equal ones share a place."""
    each = fact.where("is_revenue").groupBy("category", "product_id", "brand").agg(F.sum("quantity").cast("bigint").alias("units"), total("net", "net_revenue"), F.countDistinct("order_id").alias("orders_cnt"))
    place = F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc("net_revenue")))
    return each.withColumn("position", place.cast("int")).where(F.col("position") <= n)


def sessions(clicks: DataFrame) -> DataFrame:
    """One row per session, day and device. The customer is the one of the earliest event that names one."""
    known = F.min(F.when(F.col("customer_id").isNotNull(), F.struct("event_ts", "event_id", "customer_id")))
    out = clicks.groupBy("session_id", "event_date", "device").agg(
        known.getField("customer_id").alias("customer_id"), F.min("event_ts").alias("started"), F.max("event_ts").alias("ended"), F.count("*").alias("events"),
        F.countDistinct("product_id").alias("products"), F.max(F.col("is_conversion").cast("int")).alias("converted"),
    )
    return out.withColumn("duration_s", seconds_between("started", "ended"))


def customer_360(customers: DataFrame, fact: DataFrame, clicks: DataFrame, today: date) -> DataFrame:
    """Every customer with purchases and behaviour, aggregated before they are joined; zeros where there is none."""
    bought = customer_revenue(fact).select("customer_id", F.col("frequency").alias("orders_cnt"), F.col("monetary").alias("revenue"), "last_order")
    seen = clicks.where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.countDistinct("session_id").alias("sessions"), F.count_if("is_conversion").alias("checkouts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return customers.join(bought, "customer_id", "left").join(seen, "customer_id", "left").select(
        "customer_id", "segment", "country", zero("orders_cnt"), F.coalesce("revenue", F.lit(0).cast("decimal(28,2)")).alias("revenue"), "last_order", zero("sessions"), zero("checkouts"),
        F.datediff(F.lit(today), "last_order").alias("days_since_last_order"),
    )


def revenue_by_day(sold: DataFrame) -> DataFrame:
    return sold.where("is_revenue").groupBy("order_date").agg(total("net", "revenue"), F.countDistinct("order_id").alias("orders_cnt"))


def cohort_retention(sold: DataFrame) -> DataFrame:
    """Share of a first-purchase month's customers that buy again n months later. One pass to (customer, month); the cohort is the
    least month of a customer, its size the row of month 0."""
    month = F.trunc("order_date", "month")
    active = sold.where("is_revenue AND customer_id IS NOT NULL").select("customer_id", month.alias("m")).distinct()
    born = active.withColumn("cohort", F.min("m").over(Window.partitionBy("customer_id")))
    gap = (F.year("m") - F.year("cohort")) * 12 + F.month("m") - F.month("cohort")
    each = born.groupBy("cohort", gap.cast("int").alias("month_no")).agg(F.count("*").alias("customers"))
    size = F.max(F.when(F.col("month_no") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return each.withColumn("cohort_size", size).withColumn("retention_pct", percent(F.col("customers"), F.col("cohort_size"), 1))


def funnel(clicks: DataFrame, first: date, last: date) -> DataFrame:
    """Sessions of each device that view, put into the cart and check out between two days, and the rates."""
    has = lambda kind, name: F.max((F.col("event_type") == kind).cast("int")).alias(name)
    each = clicks.where(F.col("event_date").between(F.lit(first), F.lit(last))).groupBy("session_id", "device").agg(has("product_view", "v"), has("add_to_cart", "c"), has("checkout", "k"))
    out = each.groupBy("device").agg(F.count("*").alias("sessions"), F.sum("v").alias("with_product_view"), F.sum("c").alias("with_add_to_cart"), F.sum("k").alias("with_checkout"))
    rate = lambda a, b: percent(F.col(a), F.col(b), 1)
    return out.withColumns({"view_to_cart_pct": rate("with_add_to_cart", "with_product_view"), "cart_to_checkout_pct": rate("with_checkout", "with_add_to_cart"), "session_conversion_pct": rate("with_checkout", "sessions")})


def revenue_change(daily: DataFrame) -> DataFrame:
    """One number: the latest day's revenue against the mean of the days with sales among the seven before, in percent."""
    days = daily.groupBy("order_date").agg(F.sum("net_revenue").cast("double").alias("revenue"))
    last = days.agg(F.max("order_date").alias("d"))
    near = days.join(F.broadcast(last), F.col("order_date").between(F.date_sub("d", 7), F.col("d")))
    now, usual = F.max(F.when(F.col("order_date") == F.col("d"), F.col("revenue"))), F.avg(F.when(F.col("order_date") < F.col("d"), F.col("revenue")))
    return near.agg(percent(now - usual, usual, 1).alias("revenue_change_pct"))


def cancelled_share(sold: DataFrame, today: date) -> DataFrame:
    """One number: items that are no revenue among those of the last seven days, in percent."""
    return sold.where(F.col("order_date") >= F.date_sub(F.lit(today), 7)).agg(percent(F.count_if(~F.col("is_revenue")), F.count("*"), 1).alias("cancelled_pct"))

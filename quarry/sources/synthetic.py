"""Seeded synthetic feeds, made by the executors: every value is a hash of the seed and the row's number."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The domains of the retail model.
CATEGORIES = ["Electronics", "Home", "Fashion", "Sports", "Beauty"]
BRANDS = [f"Brand{k}" for k in range(1, 9)]
COUNTRIES = ["DE", "FR", "ES", "IT", "NL", "PL", "SE", "AT"]
SEGMENTS = ["consumer", "pro", "vip"]
CHANNELS = ["web", "ios", "android", "partner"]
STATUSES = ["created", "paid", "shipped", "delivered", "cancelled", "returned"]
EVENTS = ["page_view", "product_view", "add_to_cart", "remove_from_cart", "checkout"]
DEVICES = ["desktop", "mobile", "tablet"]


class Feed:
    """Rows of a seed. Equal seeds give equal rows, whatever the partitions."""

    def __init__(self, spark: SparkSession, seed: int) -> None:
        self.spark, self.seed = spark, seed

    def _n(self, what: str, below: int, of: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), F.col(of) if isinstance(of, str) else of), F.lit(below)).cast("int")

    def _pick(self, what: str, values: list[str], of: Column | str = "id") -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self._n(what, len(values), of) + 1)

    def _id(self, prefix: str, *of: Column | str) -> Column:
        return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws("/", F.lit(str(self.seed)), *of).cast("binary")), 1, 12))

    def products(self, n: int, at: datetime) -> DataFrame:
        cents = (self._n("price", 50_000) + 100) / F.lit(100)
        return self.spark.range(n).select(
            self._id("p", "id").alias("product_id"), F.concat(F.lit("Product "), F.col("id")).alias("product_name"), self._pick("cat", CATEGORIES).alias("category"),
            F.concat(F.lit("sub"), self._n("sub", 4)).alias("subcategory"), self._pick("brand", BRANDS).alias("brand"), cents.cast("decimal(12,2)").cast("string").alias("list_price"),
            (self._n("active", 20) > 0).cast("string").alias("is_active"), F.lit(str(at)).alias("updated_at"),
        )

    def customers(self, n: int, at: datetime) -> DataFrame:
        """All strings; two of a hundred e-mails are broken."""
        mark = F.when(self._n("mail", 50) == 0, "#").otherwise("@")
        day = F.date_sub(F.lit(at.date()), self._n("signup", 900) + 1)
        return self.spark.range(n).select(
            self._id("c", "id").alias("customer_id"), F.concat(F.lit("Customer "), F.col("id")).alias("full_name"), F.concat(F.lit("User"), F.col("id"), mark, F.lit("mail.example")).alias("email"),
            F.concat(F.lit("+49"), F.lpad(self._n("phone", 10**8), 9, "0")).alias("phone"), self._pick("country", COUNTRIES).alias("country"), F.concat(F.lit("city "), self._n("city", 30)).alias("city"),
            self._pick("segment", SEGMENTS).alias("segment"), day.cast("string").alias("signup_date"), F.lit(str(at)).alias("updated_at"),
        )

    def evolve(self, customers: DataFrame, at: datetime, share: float = 0.1) -> DataFrame:
        """Of the customers the part that changed: another city and segment, and a later time."""
        some = self._n("evolve", 1000, F.concat("customer_id", F.lit(str(at)))) < int(1000 * share)
        key = F.concat("customer_id", F.lit(str(at)))
        moved = F.concat(F.lit("city "), self._n("newcity", 30, key) + 30)
        return customers.where(some).withColumns({"city": moved, "segment": self._pick("newsegment", SEGMENTS, key), "updated_at": F.lit(str(at))})

    def orders(self, n: int, customers: DataFrame, day: datetime, *, dirty: bool = True) -> DataFrame:
        """Orders of a day, as JSON values. dirty: one of a hundred comes twice, two lack a customer, lie ahead or have an odd status."""
        people = customers.select("customer_id", F.pmod(F.xxhash64("customer_id"), F.lit(1024)).alias("slot")).groupBy("slot").agg(F.min("customer_id").alias("customer_id"))
        any_ = F.lit(customers.agg(F.min("customer_id")).first()[0])  # where a slot has none
        rows = self.spark.range(n).withColumn("key", F.concat_ws("/", F.lit(str(day.date())), "id"))
        at = (F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(secs=self._n("sec", 86_400, "key").cast("decimal(18,6)"))).cast("timestamp_ntz")
        bad = self._n("dirt", 150, "key") if dirty else F.lit(9)
        joined = rows.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(self.seed)), F.lit(1024))).join(F.broadcast(people), "slot", "left")  # 1024 rows at most
        out = joined.select(
            self._id("o", "key").alias("order_id"), F.when(bad == 0, None).otherwise(F.coalesce("customer_id", any_)).alias("customer_id"),
            F.when(bad == 1, at + F.expr("INTERVAL 400 DAYS")).otherwise(at).cast("string").alias("order_ts"), F.when(bad == 2, "odd").otherwise(self._pick("status", STATUSES, "key")).alias("status"),
            self._pick("channel", CHANNELS, "key").alias("channel"), F.lit("eur").alias("currency"), self._pick("ship", COUNTRIES, "key").alias("shipping_country"), (self._n("disc", 31, "key") / F.lit(100)).alias("discount_pct"),
        )
        return out.unionByName(out.where(F.pmod(F.xxhash64("order_id"), F.lit(100)) == 0)) if dirty else out

    def items(self, orders: DataFrame, products: DataFrame, *, dirty: bool = True) -> DataFrame:
        """One to four items of each order."""
        goods = products.select("product_id", "list_price", F.pmod(F.xxhash64("product_id"), F.lit(256)).alias("slot")).groupBy("slot").agg(F.min(F.struct("product_id", "list_price")).alias("p"))
        lines = orders.select("order_id").distinct().select("order_id", F.explode(F.sequence(F.lit(1), 1 + self._n("lines", 4, "order_id"))).alias("line"))
        lines = lines.withColumn("key", F.concat_ws("/", "order_id", "line"))
        bad = (self._n("baditem", 60, "key") == 0) & F.lit(dirty)
        joined = lines.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(256))).join(F.broadcast(goods), "slot", "left")  # 256 rows at most
        first = products.agg(F.min(F.struct("product_id", "list_price")).alias("p")).first().p
        joined = joined.withColumn("p", F.coalesce("p", F.struct(F.lit(first.product_id).alias("product_id"), F.lit(first.list_price).alias("list_price"))))
        price = F.col("p.list_price").cast("decimal(12,2)")
        return joined.select(
            self._id("i", "key").alias("order_item_id"), "order_id", F.col("p.product_id").alias("product_id"), F.when(bad, -self._n("qty", 3, "key")).otherwise(1 + self._n("qty", 5, "key")).alias("quantity"), F.when(bad, -price).otherwise(price).cast("string").alias("unit_price"),
        )

    def clicks(self, n: int, day: datetime, *, late: float = 0.03, late_seconds: tuple[int, int] = (86_400, 259_200)) -> DataFrame:
        """Events of about n / 6 sessions; a session has one device and one customer. late: the part whose event time lies back."""
        rows = self.spark.range(n).withColumn("s", self._n("session", max(1, n // 6)))
        key = F.concat_ws("/", F.lit(str(day)), "id")
        sk = F.concat_ws("/", F.lit(str(day)), "s")
        back = F.when(self._n("late", 1000) < int(1000 * late), late_seconds[0] + self._n("back", late_seconds[1] - late_seconds[0] + 1)).otherwise(0)
        at = F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(secs=(self._n("at", 86_400) - back).cast("decimal(18,6)"))
        return rows.select(
            self._id("e", key).alias("event_id"), self._id("s", sk).alias("session_id"), F.when(self._n("anon", 4, sk) == 0, None).otherwise(self._id("c", F.pmod(F.xxhash64(sk), F.lit(500)).cast("string"))).alias("customer_id"),
            at.cast("string").alias("event_ts"), self._pick("event", EVENTS).alias("event_type"), F.concat(F.lit("p_"), self._n("prod", 300)).alias("product_id"), F.concat(F.lit("/p/"), self._n("prod", 300)).alias("page_url"), self._pick("device", DEVICES, sk).alias("device"),
        )


def live(feed: Feed, folder: str, batches: list[datetime], rows: int = 500) -> None:
    """Write one small JSON file per batch, as a producer of live events would: a tenth of the events 5 to 20 minutes late."""
    for at in batches:
        events = feed.clicks(rows, at, late=0.1, late_seconds=(300, 1200)).withColumn("ingest_ts", F.lit(str(at)))
        events.withColumn("event_ts", F.least(F.col("event_ts"), F.lit(str(at)))).coalesce(1).write.mode("append").json(folder)

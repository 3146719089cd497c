"""Registered queries of the retail engine, by the operators; their DuckDB twins are in oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import all_or, mask_email, mask_name, row_hash, surrogate_key
from quarry.operators import churn, cleaning, history, marts, merge, quality
from quarry.plans import flows, policies, reports
from quarry.settings import scratch
from quarry.sources import landing
from quarry.sources import retail as src
from quarry.sources.versioned import VersionedTable
from quarry.streaming import sinks, windows

#: The time at which the quality rules are held against the tables (the newest orders are later), and 'today' of the marts.
NOW, TODAY = datetime(2001, 7, 1), date(2001, 8, 10)
TRACKED = ["full_name", "email", "phone", "country", "city", "segment"]
CUSTOMER = ["customer_id", "full_name", "email", "phone", "country", "city", "segment", "signup_date", "is_email_valid"]


class Model:
    """The cleaned entities and marts over the tables of a folder, each built when asked for."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    @cached_property
    def orders(self) -> DataFrame:
        return cleaning.clean_orders(src.raw_orders(self.spark, self.d))

    @cached_property
    def items(self) -> DataFrame:
        return cleaning.clean_items(src.raw_items(self.spark, self.d), within="order_id")

    @cached_property
    def products(self) -> DataFrame:
        return cleaning.clean_products(src.raw_products(self.spark, self.d))

    @cached_property
    def clicks(self) -> DataFrame:
        return cleaning.clean_clicks(src.raw_clicks(self.spark, self.d))

    @cached_property
    def feed(self) -> DataFrame:
        """All versions of the customers."""
        return cleaning.clean_customers(src.raw_customers(self.spark, self.d))

    @cached_property
    def customer_history(self) -> DataFrame:
        return history.scd2(self.feed, "customer_id", ["updated_at"], TRACKED)

    @cached_property
    def customers(self) -> DataFrame:
        return history.current(self.customer_history)

    @cached_property
    def sold(self) -> DataFrame:
        return marts.sales(self.orders, self.items)

    @cached_property
    def fact(self) -> DataFrame:
        return marts.fact_items(self.orders, self.items, self.products)

    @cached_property
    def daily(self) -> DataFrame:
        return marts.daily_sales(self.fact)

    @cached_property
    def scores(self) -> DataFrame:
        return marts.rfm(self.sold, TODAY)

    @cached_property
    def cut(self) -> date:
        return churn.cut_off(self.sold)

    @cached_property
    def features(self) -> DataFrame:
        return churn.features(self.customers, self.fact, self.clicks, self.cut)

    @cached_property
    def labels(self) -> DataFrame:
        return churn.labels(self.features, self.sold, self.cut)


QUERIES: dict[str, Callable[[Model], DataFrame]] = {}


def query(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---- cleaning

QUERIES |= {
    "clean_orders": lambda m: m.orders,
    "clean_items": lambda m: m.items.select("item_id", "order_id", "product_id", "quantity", "unit_price", "discount_pct", "line_amount"),
    "clean_customers": lambda m: m.feed,
    "clean_products": lambda m: m.products,
    "clean_clicks": lambda m: m.clicks,
    "masked_customers": lambda m: m.customers.select("customer_id", mask_name("full_name").alias("name"), mask_email("email").alias("email")),
    "surrogate_keys": lambda m: m.customers.select("customer_id", surrogate_key("customer_id").alias("customer_sk")),
    "row_hashes": lambda m: m.feed.select("customer_id", "updated_at", row_hash(TRACKED).alias("row_hash")),
    "email_validity": lambda m: m.customers.groupBy("is_email_valid").agg(F.count("*").alias("customers")),
    "latest_item_of_product": lambda m: cleaning.keep_latest(m.items.select("product_id", "item_id", "quantity"), ["product_id"], [F.desc("quantity"), F.asc("item_id")]),
    "star_except": lambda m: m.spark.sql("SELECT * EXCEPT (currency, order_ts) FROM {o} WHERE is_revenue", o=m.orders),
}


# ---- quality


def _profiled(dataset: str, of: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    return lambda m: quality.profile(of(m), dataset, NOW).select("rule", "severity", "rows_total", "rows_failed", "failure_rate", "passed")


def _rejected(dataset: str, key: str, of: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    return lambda m: quality.quarantine(of(m), dataset, NOW)[1].select(key, F.explode("failed_rules").alias("rule"))


def runs(m: Model) -> DataFrame:
    """Profiles of two runs: over the orders of odd numbers before 1998, then over all."""
    odd = m.orders.where((F.col("order_id").cast("bigint") % 2 == 1) & (F.col("order_date") < "1998-01-01"))
    one = quality.profile(odd, "orders", NOW, "r1", datetime(2001, 6, 30, 3, 30))
    return one.unionByName(quality.profile(m.orders, "orders", NOW, "r2", datetime(2001, 7, 1, 3, 30))).where("rows_failed IS NOT NULL")


QUERIES |= {f"dq_profile_{n}": _profiled(n, f) for n, f in {"orders": lambda m: m.orders, "items": lambda m: m.items, "customers": lambda m: m.feed, "clicks": lambda m: m.clicks}.items()}
QUERIES |= {
    "dq_metrics_clicks": lambda m: quality.profile(m.clicks, "clicks").select("rule", "rows_failed", "rows_total"),
    "dq_quarantine_orders": _rejected("orders", "order_id", lambda m: m.orders),
    "dq_quarantine_items": _rejected("items", "item_id", lambda m: m.items),
    "dq_quarantine_clicks": _rejected("clicks", "event_id", lambda m: m.clicks),
    "dq_valid_orders": lambda m: quality.quarantine(m.orders, "orders", NOW)[0].select("order_id", "order_ts", "status"),
    "dq_reasons": lambda m: quality.breakdown(quality.quarantine(m.orders, "orders", NOW)[1].select("failed_rules").unionByName(quality.quarantine(m.clicks, "clicks", NOW)[1].select("failed_rules"))),
    "dq_trend": lambda m: quality.trend(runs(m)),
    "dq_latest_blocking": lambda m: quality.latest_blocking(runs(m)),
    "alert_hours_since": lambda m: quality.hours_since(runs(m), datetime(2001, 7, 2, 12, 15)),
    "mart_checks": lambda m: quality.mart_checks(m.fact, m.orders, m.daily, marts.calendar(m.spark, date(1995, 1, 1), date(2001, 12, 31)), m.scores, m.customers),
}

# ---- dimensions, fact, marts

QUERIES |= {
    "dim_date": lambda m: marts.calendar(m.spark, date(1995, 1, 1), date(2001, 12, 31)),
    "dim_customer": lambda m: marts.dim_customer(m.customers, TODAY),
    "dim_product": lambda m: marts.dim_product(m.products),
    "fact_items": lambda m: m.fact,
    "daily_sales": lambda m: marts.with_week_average(m.daily),
    "rfm": lambda m: m.scores,
    "rfm_segments": lambda m: marts.rfm_segments(m.scores),
    "top_products": lambda m: marts.top_products(m.fact),
    "sessions": lambda m: marts.sessions(m.clicks),
    "customer_360": lambda m: marts.customer_360(m.customers, m.sold, m.clicks, TODAY),
    "revenue_by_day": lambda m: marts.revenue_by_day(m.sold),
    "revenue_overview": lambda m: reports.revenue_overview(m.daily, date(1996, 1, 1), date(1998, 12, 31)),
    "revenue_overview_channel": lambda m: reports.revenue_overview(m.daily, date(1996, 1, 1), date(1996, 6, 30), "1-urgent"),
    "cohort_retention": lambda m: marts.cohort_retention(m.sold),
    "funnel": lambda m: marts.funnel(m.clicks, date(2024, 1, 5), date(2024, 1, 25)),
    "alert_revenue_drop": lambda m: marts.revenue_change(m.daily),
    "alert_cancelled_share": lambda m: marts.cancelled_share(m.sold, date(2001, 7, 20)),
}

# ---- joins, sets, windows

@query
def calendar_gaps(m: Model) -> DataFrame:
    days = m.orders.where("is_revenue").select("order_date").distinct()
    return marts.calendar(m.spark, date(1995, 1, 1), date(2001, 12, 31)).join(days, F.col("date") == F.col("order_date"), "left_anti").select("date")


@query
def range_price_join(m: Model) -> DataFrame:
    prices = m.spark.createDataFrame([("paid", date(1995, 1, 1), date(1998, 1, 1)), ("paid", date(1998, 1, 1), None)], "sku string, valid_from date, valid_to date")
    valid = (F.col("status") == F.col("sku")) & (F.col("order_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("order_date") < F.col("valid_to")))
    return m.sold.join(F.broadcast(prices), valid).groupBy("valid_from").agg(F.count("*").alias("n"), F.sum("quantity").cast("bigint").alias("units"))


@query
def self_rank_join(m: Model) -> DataFrame:
    """Each customer's latest order beside the one before."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("order_ts"), F.desc("order_id"))
    both = m.orders.select("customer_id", "order_id", "status", F.row_number().over(w).alias("rn"), F.lead("order_id").over(w).alias("before_id"), F.lead("status").over(w).alias("before_status"))
    return both.where("rn = 1 AND before_id IS NOT NULL").drop("rn")


@query
def multi_version_customers(m: Model) -> DataFrame:
    several = m.feed.groupBy("customer_id").agg(F.count("*").alias("n")).where("n > 1")
    return m.feed.join(several, "customer_id", "left_semi").select("customer_id", "city", "updated_at")


QUERIES |= {
    "anti_orphans": lambda m: m.items.join(m.orders, "order_id", "left_anti").agg(F.count("*").alias("orphans")),
    "not_in_anti": lambda m: m.customers.join(m.orders.where("customer_id IS NOT NULL"), "customer_id", "left_anti").select("customer_id"),
    "exists_semi": lambda m: m.customers.join(m.sold.where("net > 1000"), "customer_id", "left_semi").select("customer_id"),
    "share_of_total": lambda m: m.customers.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum(F.count("*")).over(Window.partitionBy()), 6).alias("share")),
    "except_all": lambda m: m.orders.select("customer_id").exceptAll(m.orders.where("is_revenue").select("customer_id")),
    "union_all": lambda m: m.orders.select("customer_id", F.lit("order").alias("kind")).unionByName(m.clicks.select("customer_id", F.lit("click").alias("kind"))),
    "distinct_activity": lambda m: m.orders.select("customer_id", F.trunc("order_date", "month").alias("m")).distinct(),
    "channel_filter": lambda m: m.orders.where(all_or("channel", "5-low") & all_or("currency", "all")).select("order_id", "channel"),
    "latest_day_orders": lambda m: m.spark.sql("SELECT order_id, order_date FROM {o} WHERE order_date = (SELECT max(order_date) FROM {o})", o=m.orders),
    "avg_duration": lambda m: marts.sessions(m.clicks).groupBy("device").agg(F.round(F.avg("duration_s"), 4).alias("avg_s"), F.max("duration_s").alias("max_s")),
    "top_spenders": lambda m: marts.customer_revenue(m.sold).orderBy(F.desc("monetary"), "customer_id").limit(25).select("customer_id", "monetary"),
    "busy_customers": lambda m: m.orders.groupBy("customer_id").agg(F.count("*").alias("orders_cnt")).where("orders_cnt > 15"),
    "windows_5min_exact": lambda m: windows.windowed(m.clicks, exact=True).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "device", "events", "sessions", "products", "carts", "checkouts", "conversion_rate"),
}

# ---- history and merge

CHANNELS = ["channel"]


@query
def scd2_history(m: Model) -> DataFrame:
    feed = m.orders.select("customer_id", "channel", "order_ts", "order_id")
    return history.scd2(feed, "customer_id", ["order_ts", "order_id"], CHANNELS).select("customer_id", "channel", "valid_from", "valid_to")


def _batches(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An empty history, the feed's first versions, and its later ones with late repeats of some first ones."""
    none = m.customer_history.where("false")
    late = F.startswith("city", F.lit("Town"))
    again = m.feed.where(~late & (F.col("customer_id").cast("bigint") % 6 == 0))
    return none, m.feed.where(~late), m.feed.where(late).unionByName(again)


def _merged(m: Model, times: int = 1) -> DataFrame:
    out, one, two = _batches(m)
    for batch in [one, two] * times:
        out = history.merge_scd2(out, batch, "customer_id", "updated_at", TRACKED)
    return out.select("customer_id", "city", "valid_from", "valid_to", "is_current")


QUERIES |= {
    "scd2_rebuilt": lambda m: m.customer_history.select("customer_id", "city", "valid_from", "valid_to", "is_current"),
    "scd2_two_batches": _merged,
    "scd2_idempotent": lambda m: _merged(m, 2),
    "scd2_audit": lambda m: history.audit(m.customer_history, "customer_id"),
    "scd2_invariant": lambda m: history.not_one_current(m.customer_history, "customer_id"),
    "scd1_current": lambda m: history.scd1(m.feed, ["customer_id"], ["updated_at"]).select("customer_id", "city", "updated_at"),
    "current_customers": lambda m: m.customers.select(*CUSTOMER, "valid_from"),
}


def _halves(m: Model) -> tuple[DataFrame, DataFrame]:
    o, num = m.orders.select("order_id", "status"), F.col("order_id").cast("bigint")
    return o.where(num % 5 != 0), o.where(num % 7 != 0).withColumn("status", F.when(num % 3 == 0, "returned").otherwise(F.col("status")))


@query
def change_feed(m: Model) -> DataFrame:
    old, new = _halves(m)
    return merge.changes(old, new, "order_id", ["status"])


@query
def merge_upsert(m: Model) -> DataFrame:
    """Update where the status differs, insert, and mark what the source lacks as deleted."""
    old, new = _halves(m)
    clauses = [
        merge.Clause("matched", "update", "s.status <> t.status", {"status": "s.status", "is_deleted": "false"}),
        merge.Clause("not_matched", "insert", "true", {"order_id": "s.order_id", "status": "s.status", "is_deleted": "false"}),
        merge.Clause("not_matched_by_source", "update", "true", {"is_deleted": "true"}),
    ]
    return merge.merge(old.withColumn("is_deleted", F.lit(False)), new, ["order_id"], clauses)


@query
def merge_insert_only(m: Model) -> DataFrame:
    old, new = _halves(m)
    return merge.merge(old, new, ["order_id"], merge.INSERT_ONLY)


@query
def merge_delete(m: Model) -> DataFrame:
    old, new = _halves(m)
    return merge.merge(old, new, ["order_id"], [merge.Clause("matched", "delete", "s.status = 'returned'"), merge.Clause("not_matched", "insert", "s.status <> 'returned'")])


def _table(m: Model) -> VersionedTable:
    """Version 0: some orders; 1: merged with others; 2: a third less; 3: version 0 again."""
    t, (old, new) = VersionedTable(m.spark, f"{scratch(m.spark)}/versioned-{uuid.uuid4().hex}"), _halves(m)
    t.overwrite(old, datetime(2001, 1, 1))
    t.merge(new, ["order_id"], datetime(2001, 1, 2))
    t.overwrite(t.read().where("CAST(order_id AS BIGINT) % 3 <> 1"), datetime(2001, 1, 3))
    t.restore(0, datetime(2001, 1, 4))
    return t


QUERIES |= {
    "time_travel_diff": lambda m: (t := _table(m)).read(1).exceptAll(t.read(2)),
    "restore_table": lambda m: _table(m).read(),
    "table_changes": lambda m: _table(m).changes("order_id", 0, 2),
    "table_history": lambda m: _table(m).history(),
}


@query
def clone_table(m: Model) -> DataFrame:
    """A clone to which rows are added; the table itself keeps its own."""
    t = _table(m)
    other = t.clone(f"{t.root}-clone", datetime(2001, 1, 5), version=2)
    other.append(m.spark.createDataFrame([("x1", "paid", "new")], "order_id string, status string, note string"), datetime(2001, 1, 6))
    return other.read().withColumn("own", F.lit(t.read().count()))


@query
def rename_column(m: Model) -> DataFrame:
    t = _table(m)
    t.rename("status", "state", datetime(2001, 1, 5))
    t.constrain("has_state", "state IS NOT NULL", datetime(2001, 1, 6))
    t.cluster(["state"], datetime(2001, 1, 7))
    t.compact(datetime(2001, 1, 8))
    return t.read()


# ---- ingest and streams


def _landed(m: Model, clicks: DataFrame, kind: str = "json") -> str:
    folder = f"{scratch(m.spark)}/landing-{uuid.uuid4().hex}"
    out = clicks.withColumn("event_ts", F.col("event_ts").cast("string")).repartition(6).sortWithinPartitions("event_ts")
    (out.write.option("header", True).csv if kind == "csv" else out.write.json)(folder)
    return folder


CLICKS = "event_id string, session_id string, customer_id string, event_ts timestamp, event_type string, product_id string, device string, event_date date, is_conversion boolean"


def _streamed(m: Model, clicks: DataFrame | None = None) -> DataFrame:
    return landing.stream(m.spark, _landed(m, m.clicks if clicks is None else clicks), CLICKS)


@query
def bronze_ingest(m: Model) -> DataFrame:
    """Clicks ingested in two runs; the second has a new column and values that don't fit."""
    root = f"{scratch(m.spark)}/bronze-{uuid.uuid4().hex}"
    raw = src.raw_clicks(m.spark, m.d).select("event_id", F.col("event_id").cast("bigint").alias("n"), "event_type")
    feed = landing.Feed(m.spark, f"{root}/in", f"{root}/table", now=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    raw.where("n % 2 = 0").coalesce(2).write.mode("append").json(f"{root}/in")
    feed.run()
    odd = raw.where("n % 2 = 1").withColumns({"n": F.when(F.col("n") % 10 == 1, F.concat(F.lit("n"), "n")).otherwise(F.col("n").cast("string")), "channel": F.lit("app")})
    odd.select("event_id", F.when(F.startswith("n", F.lit("n")), F.col("n")).alias("n"), "event_type", "channel").coalesce(1).write.mode("append").json(f"{root}/in")
    feed.run()
    feed.run()  # nothing is new
    return feed.read().select("event_id", "n", "event_type", "channel", F.get_json_object("_rescued_data", "$.n").alias("rescued_n"))


@query
def stream_windows_5min(m: Model) -> DataFrame:
    """The windows of a stream, upserted by window and device: as many events as the batch twin finds."""
    root = f"{scratch(m.spark)}/windows-{uuid.uuid4().hex}"
    sink = sinks.Upserts(m.spark, f"{root}/out", ["window_start", "device"])
    sinks.upsert(windows.windowed(_streamed(m), late="60 days"), sink, f"{root}/checkpoint").awaitTermination()
    return sink.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "device", "events", "checkouts")


@query
def stream_upsert_restart(m: Model) -> DataFrame:
    """The same in two runs of the query, with the second half of the files, and some files again, landed between."""
    root = f"{scratch(m.spark)}/restart-{uuid.uuid4().hex}"
    half, number = f"{root}/in", F.col("event_id").cast("bigint")
    sink = sinks.Upserts(m.spark, f"{root}/out", ["window_start", "device"])
    for part in (number % 2 == 0, (number % 2 == 1) | (number % 8 == 0)):
        m.clicks.where(part).withColumn("event_ts", F.col("event_ts").cast("string")).coalesce(2).write.mode("append").json(half)
        events = landing.stream(m.spark, half, CLICKS)
        sinks.upsert(windows.windowed(events, late="60 days"), sink, f"{root}/checkpoint").awaitTermination()
    return sink.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "device", "events", "checkouts")


@query
def stream_enriched(m: Model) -> DataFrame:
    """Stream joined with the products, to a table; events that come twice count once."""
    root = f"{scratch(m.spark)}/enriched-{uuid.uuid4().hex}"
    twice = m.clicks.unionByName(m.clicks.where("CAST(event_id AS BIGINT) % 10 = 0"))
    rows = windows.enriched(windows.once(_streamed(m, twice), late="60 days"), m.products)
    landing.to_table(rows.select("event_id", "product_id", "category", "brand"), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return m.spark.read.parquet(f"{root}/table")


# ---- declared flows and their event log


def _flows(m: Model) -> flows.Flows:
    f = flows.Flows(m.spark, f"{scratch(m.spark)}/flows-{uuid.uuid4().hex}")

    @f.dataset("clicks_by_type", reads=("clicks_silver",))
    def _(read):
        return read("clicks_silver").groupBy("event_type").agg(F.count("*").alias("events"))

    @f.dataset("clicks_silver", reads=("clicks",), expect={"has_product": "product_id <> '0'"}, drop=quality.expectations("clicks", "drop"), fail=quality.expectations("clicks", "fail"))
    def _(read):
        return read("clicks")

    f.run({"clicks": m.clicks}, datetime(2024, 2, 1))
    return f


QUERIES |= {
    "expectation_metrics": lambda m: flows.expectation_metrics(_flows(m).events()),
    "flow_progress": lambda m: flows.flow_progress(_flows(m).events()),
    "flow_result": lambda m: (f := _flows(m)).spark.read.parquet(f"{f.root}/clicks_by_type"),
}


# ---- governance


def access(m: Model) -> DataFrame:
    return m.spark.createDataFrame([("anna", "NATION_1"), ("anna", "NATION_2"), ("analysts", "NATION_3"), ("root", "*"), ("otto", "NATION_4")], "principal string, value string")


@query
def secured_rows(m: Model) -> DataFrame:
    """What a user of one group sees: rows of the granted countries, names and addresses masked."""
    p = policies.Policies()
    p.set_filter("customers", "country")
    p.set_mask("customers", "full_name", "mask_name")
    p.set_mask("customers", "email", "mask_email")
    return p.view("customers", m.customers.select("customer_id", "full_name", "email", "country"), access(m), "anna", ["analysts"])


def _job_runs(m: Model) -> DataFrame:
    o = src.read(m.spark, m.d, "orders")
    key = F.col("o_orderkey")
    took = F.make_dt_interval(secs=(key % 97 * 30).cast("decimal(18,6)"))
    return o.select(F.concat(F.lit("job"), (key % 5).cast("string")).alias("job"), F.col("o_orderdate").alias("started"), (F.col("o_orderdate") + took).alias("ended"), F.when(key % 11 == 0, "failed").otherwise("success").alias("state"))


@query
def cost_per_job(m: Model) -> DataFrame:
    i = src.read(m.spark, m.d, "lineitem")
    usage = i.select(F.concat(F.lit("job"), (F.col("l_orderkey") % 5).cast("string")).alias("job"), F.col("l_returnflag").alias("sku"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_quantity").cast("int").alias("quantity"))
    prices = [("A", 0.5, date(1990, 1, 1), date(1997, 1, 1)), ("A", 0.75, date(1997, 1, 1), None), ("N", 1.25, date(1990, 1, 1), None), ("R", 0.1, date(1998, 1, 1), date(1999, 1, 1))]
    p = m.spark.createDataFrame(prices, "sku string, price double, valid_from date, valid_to date").withColumn("price", F.col("price").cast("decimal(10,4)"))
    return policies.cost_per_job(usage, p)


@query
def lineage_last_seen(m: Model) -> DataFrame:
    o = src.read(m.spark, m.d, "orders")
    events = o.select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("target"), F.col("o_orderdate").alias("at"))
    return policies.lineage_last_seen(events)


@query
def undocumented_tables(m: Model) -> DataFrame:
    n = src.read(m.spark, m.d, "nation")
    return policies.undocumented(n.select(F.col("n_name").alias("table_name"), F.when(F.col("n_nationkey") % 3 == 0, " ").when(F.col("n_nationkey") % 3 == 1, "about").alias("comment")))


QUERIES |= {
    "job_sla": lambda m: policies.job_sla(_job_runs(m), 2400),
    "heavy_queries": lambda m: policies.heavy(src.read(m.spark, m.d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("bytes"))),
    "table_readers": lambda m: policies.readers(src.read(m.spark, m.d, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"), F.when(F.col("o_orderstatus") == "F", "read").otherwise("write").alias("action"), F.col("o_orderpriority").alias("table_name"), F.col("o_orderdate").alias("at")), "1"),
}

# ---- churn

QUERIES |= {
    "churn_features": lambda m: m.features,
    "churn_labels": lambda m: m.labels,
    "class_balance": lambda m: churn.class_balance(m.labels),
    "class_means": lambda m: churn.class_means(m.features, m.labels),
    "risk_distribution": lambda m: churn.distribution(churn.rule_score(m.features)),
    "save_list": lambda m: churn.save_list(churn.rule_score(m.features), m.scores),
    "drift_summary": lambda m: churn.drift(churn.rule_score(m.features), "run1"),
}


@query
def churn_scores(m: Model) -> DataFrame:
    """Scores of a model that is trained here, with few and shallow trees."""
    rows = m.features.join(m.labels, ["customer_id", "as_of_date"])
    model, _, _ = churn.train(rows, None, NOW, iterations=10, depth=3)
    return churn.score(model, 1, m.features, NOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, d, f=f: f(Model(spark, d))) for n, f in QUERIES.items()}


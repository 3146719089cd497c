"""The engine's jobs over the layers of a root: bootstrap, daily medallion, live windows, churn."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import churn, cleaning, history, marts, quality
from quarry.plans.runner import Job, Task
from quarry.settings import LAYERS, Settings
from quarry.sources import landing, synthetic
from quarry.sources.files import Files, write_csv, write_json
from quarry.sources.versioned import VersionedTable
from quarry.streaming import sinks, windows

TRACKED = ["full_name", "email", "phone", "country", "city", "segment"]


def bootstrap(spark: SparkSession, s: Settings, first: datetime, days: int = 21, orders: int = 800, customers: int = 2000, products: int = 300, clicks: int = 4000, seed: int = 42) -> None:
    """Landing files of some days: customers whole on the first day and as changes on later ones, products once."""
    feed = synthetic.Feed(spark, seed)
    goods, people = feed.products(products, first), feed.customers(customers, first)
    write_json(goods, s.landing("products"))
    write_csv(people, s.landing("customers"))
    for k in range(days):
        day = first + timedelta(days=k)
        bought = feed.orders(orders, people, day)
        write_json(bought, s.landing("orders"))
        write_json(feed.items(bought, goods), s.landing("items"))
        write_json(feed.clicks(clicks, day), s.landing("clicks"), rows=800)
        if k:
            write_csv(feed.evolve(people, day), s.landing("customers"))


def bronze(spark: SparkSession, s: Settings, now: datetime) -> dict[str, int]:
    """Read what is new in each landing folder; rows of each table."""
    at = F.lit(now).cast("timestamp")
    kind = lambda name: "csv" if name == "customers" else "json"
    return {name: landing.Feed(spark, s.landing(name), s.table("bronze", name), kind(name), now=at).run() for name in LAYERS["bronze"] if Files(spark, s.landing(name)).exists("")}


def raw(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return landing.Feed(spark, s.landing(name), s.table("bronze", name)).read()


def cleaned(name: str):
    def run(rows: DataFrame) -> DataFrame:
        rows = rows.drop("_rescued_data", "_source_file", "_source_time", "_batch_id")
        if name == "items":
            return cleaning.clean_items(rows.withColumnRenamed("order_item_id", "item_id"))
        out = {"orders": cleaning.clean_orders, "clicks": cleaning.clean_clicks, "products": cleaning.clean_products, "customers": cleaning.clean_customers}[name](rows)
        return cleaning.keep_latest(out, ["event_id"], [F.desc("event_ts"), F.asc("session_id")]) if name == "clicks" else out

    return run


def silver(spark: SparkSession, s: Settings, run_id: str, now: datetime) -> dict[str, dict[str, int]]:
    """Clean and check orders, items and clicks; replace products; merge the customers' latest versions into
    their history, which the first run builds from all of them."""
    out = {name: quality.run(spark, raw(spark, s, name), name, cleaned(name), s.table("ops", "dq_results"), run_id, now) for name in ("orders", "items", "clicks")}
    cleaned("products")(raw(spark, s, "products")).write.mode("overwrite").parquet(s.table("silver", "products"))
    feed, table = cleaned("customers")(raw(spark, s, "customers")), VersionedTable(spark, s.table("silver", "customers_history"))
    if table.versions():
        table.overwrite(history.merge_scd2(table.read(), feed, "customer_id", "updated_at", TRACKED), now, "merge")
    else:
        table.overwrite(history.scd2(feed, "customer_id", ["updated_at"], TRACKED), now)
    broken = history.not_one_current(table.read(), "customer_id").count()
    if broken:
        raise ValueError(f"{broken} customers without exactly one current version")
    return out


def valid(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return spark.read.parquet(f"{s.table('ops', 'dq_results')}/valid/dataset={name}")


def customers_now(spark: SparkSession, s: Settings) -> DataFrame:
    return history.current(VersionedTable(spark, s.table("silver", "customers_history")).read())


def gold(spark: SparkSession, s: Settings, now: datetime) -> list[str]:
    """Dimensions, fact and marts, each replaced; later ones read the fact that was written."""
    today, people = now.date(), customers_now(spark, s)
    products = s.read(spark, "silver", "products")
    put = lambda name, df: df.write.mode("overwrite").parquet(s.table("gold", name))
    put("dim_customer", marts.dim_customer(people, today))
    put("dim_product", marts.dim_product(products))
    put("fact_items", marts.fact_items(valid(spark, s, "orders"), valid(spark, s, "items"), products))
    fact, clicks = s.read(spark, "gold", "fact_items"), valid(spark, s, "clicks")
    span = fact.agg(F.min("order_date"), F.max("order_date")).first()
    put("dim_date", marts.calendar(spark, span[0] or today, span[1] or today))
    put("daily_sales", marts.with_week_average(marts.daily_sales(fact)))
    put("rfm", marts.rfm(fact, today))
    put("product_performance", marts.top_products(fact))
    put("sessions", marts.sessions(clicks))
    put("customer_360", marts.customer_360(people, fact, clicks, today))
    return LAYERS["gold"][:-1]


def report(spark: SparkSession, s: Settings) -> DataFrame:
    """The checks of the marts."""
    read = lambda name: s.read(spark, "gold", name)
    return quality.mart_checks(read("fact_items"), valid(spark, s, "orders"), read("daily_sales"), read("dim_date"), read("rfm"), read("dim_customer"))


def medallion(spark: SparkSession, s: Settings, run_id: str, now: datetime) -> Job:
    """Daily at 03:30 UTC once it isn't paused; the report also runs after a failure, as long as one task before it succeeded."""
    return Job("medallion", [
        Task("bronze", lambda: bronze(spark, s, now), retries=1, timeout=3600),
        Task("silver", lambda: silver(spark, s, run_id, now), ("bronze",), timeout=3600),
        Task("gold", lambda: gold(spark, s, now), ("silver",), timeout=3600),
        Task("report", lambda: [r.asDict() for r in report(spark, s).collect()], ("silver", "gold"), run_if="at_least_one_success"),
    ], schedule="30 3 * * *")


def live(spark: SparkSession, s: Settings, batches: list[datetime], rows: int = 500) -> DataFrame:
    """Produce live events and count them in windows of five minutes; the windows so far."""
    folder = f"{s.landing('clicks')}_live"
    synthetic.live(synthetic.Feed(spark, 1), folder, batches, rows)
    schema = "event_id string, session_id string, customer_id string, event_ts string, event_type string, product_id string, page_url string, device string, ingest_ts string"
    sink = sinks.Upserts(spark, f"{s.root}/gold/live_windows", ["window_start", "device"])
    sinks.upsert(windows.windowed(cleaning.clean_clicks(landing.stream(spark, folder, schema))), sink, s.checkpoint("live_windows")).awaitTermination()
    return sink.read()


def churn_job(spark: SparkSession, s: Settings, now: datetime, window: int = churn.WINDOW, **how) -> Job:
    """Weekly: features and labels, training with the champion gate, scoring if either of the two succeeded."""
    put = lambda layer, name, df: df.write.mode("overwrite").parquet(s.table(layer, name))
    registry = churn.Registry(spark, s.table("ml", "models"))

    def features() -> None:
        fact = s.read(spark, "gold", "fact_items")
        as_of = churn.cut_off(fact, window)
        put("ml", "features", churn.features(customers_now(spark, s), fact, valid(spark, s, "clicks"), as_of))
        put("ml", "labels", churn.labels(s.read(spark, "ml", "features"), fact, as_of))

    def train() -> str:
        rows = s.read(spark, "ml", "features").join(s.read(spark, "ml", "labels"), ["customer_id", "as_of_date"])
        return churn.train(rows, registry, now, **how)[2]

    def score() -> int:
        version, model = registry.load()
        put("gold", "churn_scores", churn.score(model, version, s.read(spark, "ml", "features"), now))
        scores = s.read(spark, "gold", "churn_scores")
        churn.drift(scores, now.isoformat()).write.mode("append").parquet(s.table("ops", "score_history"))
        return scores.count()

    return Job("churn", [Task("features", features, timeout=5400), Task("train", train, ("features",), timeout=5400), Task("score", score, ("features", "train"), run_if="at_least_one_success")], schedule="0 5 * * 1")

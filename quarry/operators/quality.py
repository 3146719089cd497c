"""Data quality: rules, profiles, quarantine, gates, run histories and checks of the marts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severities, event types and the catalogue of rules (names, predicates and severities).
SEVERITIES = ("fail", "drop", "warn")
EVENTS = ["page_view", "product_view", "add_to_cart", "remove_from_cart", "checkout"]


@dataclass(frozen=True)
class Rule:
    """A predicate that must be TRUE: FALSE and NULL both fail. {now} stands for a time that the caller gives; needs: columns
    that not every source has."""

    name: str
    dataset: str
    predicate: str
    severity: str
    needs: tuple[str, ...] = ()
    about: str = ""

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")

    def applies(self, df: DataFrame, now: datetime | None) -> bool:
        return {*self.needs} <= {*df.columns} and (now is not None or "{now}" not in self.predicate)

    def sql(self, now: datetime | None = None) -> str:
        return self.predicate.replace("{now}", f"TIMESTAMP_NTZ '{now:%Y-%m-%d %H:%M:%S.%f}'" if now else "")

    def broken(self, now: datetime | None = None) -> Column:
        return ~F.coalesce(F.expr(self.sql(now)), F.lit(False))


RULES = [
    Rule("orders_id_not_null", "orders", "order_id IS NOT NULL AND length(order_id) > 0", "fail"),
    Rule("orders_customer_known", "orders", "customer_id IS NOT NULL", "drop"),
    Rule("orders_ts_not_null", "orders", "order_ts IS NOT NULL", "drop"),
    Rule("orders_ts_not_in_future", "orders", "order_ts <= {now} + INTERVAL 1 DAY", "drop"),
    Rule("orders_status_known", "orders", "status <> 'unknown'", "warn"),
    Rule("orders_discount_range", "orders", "discount_pct BETWEEN 0 AND 0.9", "warn", ("discount_pct",)),
    Rule("items_quantity_positive", "items", "quantity > 0", "drop"),
    Rule("items_price_positive", "items", "unit_price > 0", "drop"),
    Rule("items_order_ref", "items", "order_id IS NOT NULL", "fail"),
    Rule("items_amount_consistent", "items", "abs(line_amount - quantity * unit_price) < 0.01", "warn"),
    Rule("customers_id_not_null", "customers", "customer_id IS NOT NULL", "fail"),
    Rule("customers_email_valid", "customers", "is_email_valid", "warn"),
    Rule("customers_signup_past", "customers", "signup_date <= to_date({now})", "warn", ("signup_date",)),
    Rule("events_id_not_null", "clicks", "event_id IS NOT NULL", "fail"),
    Rule("events_ts_not_null", "clicks", "event_ts IS NOT NULL", "drop"),
    Rule("events_type_known", "clicks", "event_type IN ('" + "', '".join(EVENTS) + "')", "drop"),
]


def rules_for(dataset: str, *severities: str) -> list[Rule]:
    return [r for r in RULES if r.dataset == dataset and r.severity in (severities or SEVERITIES)]


def expectations(dataset: str, *severities: str, now: datetime | None = None) -> dict[str, str]:
    """name -> SQL predicate, for declarative flows. Rules that need a time are left out without now."""
    return {r.name: r.sql(now) for r in rules_for(dataset, *severities) if now or "{now}" not in r.predicate}


def profile(df: DataFrame, dataset: str, now: datetime | None = None, run_id: str | None = None, run_ts: datetime | None = None) -> DataFrame:
    """A row per rule from one scan: rows_total, rows_failed, failure_rate, passed, with the run's id and time. The measures but the
    first are null where the rule could not be evaluated: without now, or without a column the rule needs."""
    rules = rules_for(dataset)
    if not rules:
        raise ValueError(f"no rules for {dataset}")
    one = df.agg(F.count("*").alias("rows_total"), *[(F.count_if(r.broken(now)) if r.applies(df, now) else F.lit(None).cast("bigint")).alias(r.name) for r in rules])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.predicate).alias("expression"), F.col(r.name).alias("rows_failed")) for r in rules])
    rate = F.when((F.col("rows_total") == 0) & F.col("rows_failed").isNotNull(), 0.0).otherwise(F.try_divide(F.col("rows_failed").cast("double"), F.col("rows_total")))
    return one.select("rows_total", F.inline(each)).withColumns(
        {"failure_rate": rate, "passed": F.col("rows_failed") == 0, "dataset": F.lit(dataset), "run_id": F.lit(run_id), "run_ts": F.lit(run_ts).cast("timestamp_ntz")}
    )


def quarantine(df: DataFrame, dataset: str, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest with failed_rules and quarantined_at; warnings do not reject. Without now, rules that need it reject
    nothing and the time is null."""
    blocking = [r for r in rules_for(dataset, "fail", "drop") if r.applies(df, now)]
    at = F.lit(now).cast("timestamp_ntz")
    if not blocking:
        return df, df.where("false").withColumns({"failed_rules": F.array().cast("array<string>"), "quarantined_at": at})
    tagged = df.withColumn("failed_rules", F.array_compact(F.array(*[F.when(r.broken(now), F.lit(r.name)) for r in blocking])))
    return tagged.where(F.size("failed_rules") == 0).drop("failed_rules"), tagged.where(F.size("failed_rules") > 0).withColumn("quarantined_at", at)


def gate(measured: DataFrame) -> None:
    """Raise when a rule of severity fail is broken in a profile."""
    bad = [f"{r.rule}={r.rows_failed}" for r in measured.where("severity = 'fail' AND NOT passed").orderBy("rule").collect()]
    if bad:
        raise ValueError("DQ blocking failures: " + ", ".join(bad))


def run(
    spark: SparkSession, raw: DataFrame, dataset: str, clean: Callable[[DataFrame], DataFrame], out: str, run_id: str, now: datetime
) -> dict[str, int]:
    """Clean, append the profile, gate, then replace the valid rows and append the rejected ones. A run that is repeated under its
    id replaces its own profile and rejected rows, so a retry counts nothing twice."""
    cleaned = clean(raw).persist()
    try:
        place = lambda kind: f"{out}/{kind}/dataset={dataset}/run_id={run_id}"
        profile(cleaned, dataset, now, run_id, now).drop("dataset", "run_id").write.mode("overwrite").parquet(place("metrics"))
        measured = spark.read.parquet(place("metrics"))
        gate(measured)
        good, bad = quarantine(cleaned, dataset, now)
        good.write.mode("overwrite").parquet(f"{out}/valid/dataset={dataset}")
        bad.write.mode("overwrite").parquet(place("quarantine"))
        total = measured.agg(F.max("rows_total")).first()[0]
        rejected = spark.read.parquet(place("quarantine")).count()
        return {"rows": total, "valid": total - rejected, "rejected": rejected}
    finally:
        cleaned.unpersist()


def breakdown(bad: DataFrame) -> DataFrame:
    """How many rejected rows broke each rule."""
    return bad.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def trend(history: DataFrame, alarm: float = 0.05) -> DataFrame:
    """Each rule's latest failure rate against the run before; alarm where it rose by more."""
    w = Window.partitionBy("dataset", "rule").orderBy(F.desc("run_ts"), F.desc("run_id"))
    both = history.withColumns({"rn": F.row_number().over(w), "previous_rate": F.lead("failure_rate").over(w)}).where("rn = 1 AND previous_rate IS NOT NULL")
    delta = F.col("failure_rate") - F.col("previous_rate")
    return both.select("dataset", "rule", "severity", "run_id", "failure_rate", "previous_rate", delta.alias("delta"), (delta > alarm).alias("alarm"))


def latest_blocking(history: DataFrame) -> DataFrame:
    """One number: rules of severity fail that the latest run of each broke."""
    w = Window.partitionBy("dataset", "rule").orderBy(F.desc("run_ts"), F.desc("run_id"))
    last = history.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return last.agg(F.count_if((F.col("severity") == "fail") & ~F.col("passed")).alias("blocking_failures"))


def hours_since(history: DataFrame, now: datetime) -> DataFrame:
    """One number: hours from the latest run to now, to one digit."""
    gone = F.timestamp_diff("SECOND", F.max("run_ts"), F.lit(now).cast("timestamp_ntz"))
    return history.agg(F.round(gone / F.lit(3600.0), 1).alias("hours_since_last_run"))


def mart_checks(fact: DataFrame, orders: DataFrame, daily: DataFrame, calendar: DataFrame, rfm: DataFrame, customers: DataFrame) -> DataFrame:
    """Five checks over the marts: a row each with severity, rows_failed and passed."""
    days = daily.select("order_date").distinct()
    span = days.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    inside = calendar.join(span, F.col("date").between(F.col("lo"), F.col("hi")))
    buyers = fact.where("is_revenue AND customer_id IS NOT NULL").select("customer_id").distinct()
    found = [
        ("orphan_items", "fail", fact.join(orders.select("order_id"), "order_id", "left_anti")),
        ("unknown_products", "warn", fact.where("category IS NULL")),
        ("negative_revenue", "fail", daily.where("net_revenue < 0")),
        ("calendar_gaps", "warn", inside.join(days, inside["date"] == days["order_date"], "left_anti")),
        ("customers_without_rfm", "warn", buyers.join(customers.select("customer_id"), "customer_id").join(rfm.select("customer_id"), "customer_id", "left_anti")),
    ]
    rows = [df.agg(F.count("*").alias("rows_failed")).select(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), "rows_failed", (F.col("rows_failed") == 0).alias("passed")) for n, s, df in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

"""Cleaning, quality, marts and history on hand-computed cases."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import cleaning, history, marts, quality, ranks

NOW = datetime(2026, 8, 10, 12)
ORDERS = "order_id string, customer_id string, order_ts string, status string, channel string, currency string, shipping_country string, discount_pct string, _ingested_at string"


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("O1", "C1", "2026-07-01 10:00:00", " PAID ", "WEB", "eur", "de", "0.1", "2026-07-02"),
        ("O1", "C1", "2026-07-01 10:00:00", "Shipped", "Web", "eur", "de", "x", "2026-07-03"),
        ("O2", " ", "2026-07-02 10:00:00", "paid", "ios", "eur", "fr", "0.95", "2026-07-02"),
        ("O3", "C3", "2026-09-03 10:00:00", "odd", "web", "eur", "fr", None, "2026-07-02"),
        ("O4", "C4", "not a time", None, "web", "eur", "fr", "0", "2026-07-02"),
    ]
    return cleaning.clean_orders(spark.createDataFrame(rows, ORDERS))


def test_orders(orders):
    got = {r.order_id: r for r in orders.collect()}
    assert len(got) == 4
    assert (got["O1"].status, got["O1"].channel, got["O1"].currency, got["O1"].shipping_country, got["O1"].is_revenue, got["O1"].discount_pct) == ("shipped", "web", "EUR", "DE", True, None)
    assert got["O2"].customer_id is None and got["O3"].status == got["O4"].status == "unknown" and not got["O3"].is_revenue
    assert got["O4"].order_ts is None and got["O4"].order_date is None


def test_items(spark):
    rows = [("I1", "O1", "P", " 2 ", "10.00", 1), ("I2", "O1", "P", "-1", "10", 1), ("I3", "O1", "P", "1", "-5.00", 1), ("I4", "O2", "P", "1", "7", 1), ("I4", "O2", "P", "3", "7", 2), ("I5", "O2", "P", "x", "y", 1)]
    raw = spark.createDataFrame(rows, "item_id string, order_id string, product_id string, quantity string, unit_price string, _ingested_at int")
    for within in (None, "order_id"):
        got = {r.item_id: r for r in cleaning.clean_items(raw, within).collect()}
        assert len(got) == 5 and got["I1"].line_amount == Decimal("20.00") and got["I2"].quantity == -1 and got["I3"].unit_price == Decimal("-5.00") and got["I4"].quantity == 3 and got["I5"].line_amount is None
    good, bad = quality.quarantine(cleaning.clean_items(raw), "items")
    assert {r.item_id for r in good.collect()} == {"I1", "I4"}
    assert {r.item_id: r.failed_rules for r in bad.collect()} == {"I2": ["items_quantity_positive"], "I3": ["items_price_positive"], "I5": ["items_quantity_positive", "items_price_positive"]}


def test_customers_products_clicks(spark):
    cols = "customer_id string, full_name string, email string, phone string, country string, city string, segment string, signup_date string, updated_at string"
    rows = [("C1", "A", " A@x.De ", "", "de", " berlin", "PRO", "2020-01-01", "2021-01-01"), ("C1", "A", "a@x.de", "1", "de", "bonn", "vip", "2020-01-01", "2021-02-01"), ("C2", "B", "b#x.de", "1", "de", "ulm", "pro", "no date", "2021-01-01")]
    got = sorted(cleaning.clean_customers(spark.createDataFrame(rows + rows[:1], cols)).collect(), key=lambda r: (r.customer_id, r.updated_at))
    assert [(r.customer_id, r.email, r.phone, r.country, r.city, r.segment, r.is_email_valid) for r in got] == [
        ("C1", "a@x.de", None, "DE", "Berlin", "pro", True), ("C1", "a@x.de", "1", "DE", "Bonn", "vip", True), ("C2", "b#x.de", "1", "DE", "Ulm", "pro", False)]
    assert got[2].signup_date is None
    goods = spark.createDataFrame([("P", " n", "home goods", "BIG", "b", "1.5", "true", "2021-01-01"), ("P", "m", "x", "y", "b", "z", "false", "2021-02-01")], "product_id string, product_name string, category string, subcategory string, brand string, list_price string, is_active string, updated_at string")
    p = cleaning.clean_products(goods).first()
    assert (p.product_name, p.category, p.list_price, p.is_active) == ("m", "X", None, False)
    clicks = spark.createDataFrame([("1", " ", " ", "2026-01-01 00:00:00", " CheckOut", "", "Mobile")], "event_id string, session_id string, customer_id string, event_ts string, event_type string, product_id string, device string")
    c = cleaning.clean_clicks(clicks).first()
    assert (c.session_id, c.customer_id, c.product_id, c.event_type, c.device, c.is_conversion, c.event_date) == (None, None, None, "checkout", "mobile", True, date(2026, 1, 1))


def test_rules(orders):
    assert len(quality.RULES) == 16 and set(quality.expectations("items", "drop")) == {"items_quantity_positive", "items_price_positive"}
    assert "orders_ts_not_in_future" not in quality.expectations("orders") and "2026-08-10" in quality.expectations("orders", now=NOW)["orders_ts_not_in_future"]
    rate = {r.rule: r for r in quality.profile(orders, "orders", NOW, "r", NOW).collect()}
    assert rate["orders_customer_known"].failure_rate == 0.25 and rate["orders_ts_not_null"].rows_failed == 1 and rate["orders_ts_not_in_future"].rows_failed == 2
    assert rate["orders_discount_range"].rows_failed == 3 and rate["orders_id_not_null"].passed and rate["orders_id_not_null"].run_id == "r"
    assert quality.profile(orders.drop("discount_pct"), "orders").where("rows_failed IS NULL").count() == 2
    assert quality.profile(orders.where("false"), "orders", NOW).agg(F.max("failure_rate")).first()[0] == 0.0
    good, bad = quality.quarantine(orders, "orders", NOW)
    assert {r.order_id for r in good.collect()} == {"O1"}
    assert {r.order_id: (r.failed_rules, r.quarantined_at) for r in bad.collect()} == {
        "O2": (["orders_customer_known"], NOW), "O3": (["orders_ts_not_in_future"], NOW), "O4": (["orders_ts_not_null", "orders_ts_not_in_future"], NOW)}
    quality.gate(quality.profile(orders, "orders"))
    with pytest.raises(ValueError, match="DQ blocking failures: orders_id_not_null=4"):
        quality.gate(quality.profile(orders.withColumn("order_id", F.lit(None).cast("string")), "orders"))
    with pytest.raises(ValueError):
        quality.Rule("x", "orders", "true", "loud")
    with pytest.raises(ValueError):
        quality.profile(orders, "nothing")
    assert {r.rule: r.rows for r in quality.breakdown(bad).collect()} == {"orders_customer_known": 1, "orders_ts_not_in_future": 2, "orders_ts_not_null": 1}


def test_quality_run_may_be_repeated(spark, orders, tmp_path):
    for _ in range(2):
        assert quality.run(spark, orders, "orders", lambda df: df, str(tmp_path), "r1", NOW) == {"rows": 4, "valid": 1, "rejected": 3}
    quality.run(spark, orders.where("order_id <> 'O2'"), "orders", lambda df: df, str(tmp_path), "r2", datetime(2026, 8, 11))
    metrics = spark.read.parquet(f"{tmp_path}/metrics")
    assert metrics.count() == 12 and spark.read.parquet(f"{tmp_path}/quarantine").count() == 5
    with pytest.raises(ValueError):
        quality.run(spark, orders.withColumn("order_id", F.lit("")), "orders", lambda df: df, str(tmp_path), "r3", NOW)
    assert spark.read.parquet(f"{tmp_path}/valid").count() == 1


def test_trend_and_alerts(spark):
    rows = [("orders", "a", "fail", "r1", datetime(2026, 1, 1), 0.1, True), ("orders", "a", "fail", "r2", datetime(2026, 1, 2), 0.2, False), ("orders", "b", "warn", "r1", datetime(2026, 1, 1), 0.1, False)]
    past = spark.createDataFrame(rows, "dataset string, rule string, severity string, run_id string, run_ts timestamp_ntz, failure_rate double, passed boolean")
    assert [(r.rule, round(r.delta, 6), r.alarm) for r in quality.trend(past).collect()] == [("a", 0.1, True)]
    assert quality.latest_blocking(past).first()[0] == 1
    assert quality.hours_since(past, datetime(2026, 1, 3, 1, 30)).first()[0] == 25.5


@pytest.fixture(scope="module")
def shop(spark):
    at = lambda d: datetime(2026, 8, d, 10)
    o = [("O1", "C1", at(1), date(2026, 8, 1), "paid", "web", "EUR", "DE", 0.1, True), ("O2", "C2", at(1), date(2026, 8, 1), "paid", "ios", "EUR", "DE", None, True), ("O3", "C1", at(2), date(2026, 8, 2), "cancelled", "web", "EUR", "DE", 0.0, False)]
    orders = spark.createDataFrame(o, "order_id string, customer_id string, order_ts timestamp_ntz, order_date date, status string, channel string, currency string, shipping_country string, discount_pct double, is_revenue boolean")
    i = [("I1", "O1", "P1", 1, Decimal("100"), Decimal("100")), ("I2", "O2", "P2", 2, Decimal("15"), Decimal("30")), ("I3", "O3", "P9", 1, Decimal("50"), Decimal("50"))]
    items = spark.createDataFrame(i, "item_id string, order_id string, product_id string, quantity int, unit_price decimal(12,2), line_amount decimal(14,2)")
    products = spark.createDataFrame([("P1", "a", "Electronics", "Phones", "X", Decimal("100"), True), ("P2", "b", "Home", "Kitchen", "Y", Decimal("15"), True)], "product_id string, product_name string, category string, subcategory string, brand string, list_price decimal(12,2), is_active boolean")
    return orders, items, products


def test_fact_and_marts(spark, shop):
    fact = marts.fact_items(*shop)
    got = {r.item_id: r for r in fact.collect()}
    assert (got["I1"].gross, got["I1"].discount, got["I1"].net, got["I1"].category) == (Decimal("100.00"), Decimal("10.00"), Decimal("90.00"), "Electronics")
    assert got["I2"].net == Decimal("30.00") and not got["I3"].is_revenue and got["I3"].category is None and len(got) == 3 and len(got["I1"].customer_sk) == 16
    daily = marts.with_week_average(marts.daily_sales(fact))
    assert {r.order_date for r in daily.collect()} == {date(2026, 8, 1)} and daily.agg(F.sum("net_revenue")).first()[0] == Decimal("120.00")
    web = daily.where("channel = 'web'").first()
    assert (web.orders_cnt, web.aov) == (1, Decimal("90.00"))
    scores = {r.customer_id: r for r in marts.rfm(fact, date(2026, 8, 10)).collect()}
    assert {*scores} == {"C1", "C2"} and all(r.recency_days == 9 and 1 <= r.r <= 5 and 1 <= r.f <= 5 and 1 <= r.m <= 5 and r.rfm_segment for r in scores.values())
    days = marts.calendar(spark, date(2026, 8, 1), date(2026, 8, 7)).collect()
    assert len(days) == 7 and {r.date for r in days if r.is_weekend} == {date(2026, 8, 1), date(2026, 8, 2)}
    assert [r.position for r in marts.top_products(fact).collect()] == [1, 1]
    product = marts.dim_product(shop[2]).first()
    assert len(product.product_sk) == 16


def test_week_average_counts_days_not_rows(spark):
    rows = [("web", "a", date(2026, 1, d), Decimal(v)) for d, v in ((1, 10), (2, 20), (8, 60), (20, 5))]
    daily = spark.createDataFrame(rows, "channel string, category string, order_date date, net_revenue decimal(28,2)")
    got = {r.order_date.day: r.avg_7d for r in marts.with_week_average(daily).collect()}
    assert got == {1: 10, 2: 15, 8: 40, 20: 5}


def test_revenue_change_and_sessions(spark):
    rows = [(date(2026, 1, d), Decimal(v)) for d, v in ((1, 999), (5, 100), (9, 300), (10, 100))]
    daily = spark.createDataFrame(rows, "order_date date, net_revenue decimal(28,2)")
    assert marts.revenue_change(daily).first()[0] == -50.0
    clicks = spark.createDataFrame([("1", "s", "m", date(2026, 1, 1), datetime(2026, 1, 1, 1), None, "p", False), ("2", "s", "m", date(2026, 1, 1), datetime(2026, 1, 1, 1, 5), "c", "p", True)], "event_id string, session_id string, device string, event_date date, event_ts timestamp_ntz, customer_id string, product_id string, is_conversion boolean")
    s = marts.sessions(clicks).first()
    assert (s.customer_id, s.events, s.products, s.converted, s.duration_s) == ("c", 2, 1, 1, 300)


@pytest.mark.parametrize("rows", [10, 300])
def test_ranks_in_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "ROWS", rows)
    values = [(k, (k * 37) % 11 if k % 13 else None) for k in range(200)]
    df = spark.createDataFrame(values, "id long, v long").repartition(3).cache()
    for down in (False, True):
        least = lambda v: -1 if v is None else v
        order = sorted(values, key=lambda r: (-least(r[1]) if down else least(r[1]), r[0]))
        got = {r.id: r["rank"] for r in ranks.ranked(df, [("v", down), ("id", False)]).collect()}
        assert [got[k] for k, _ in order] == [*range(200)]
    tiles = ranks.tiles(df, [("id", False)], 7, "t").orderBy("id").collect()
    assert [r.t for r in tiles] == [r[0] for r in df.selectExpr("ntile(7) OVER (ORDER BY id) t", "id").orderBy("id").select("t").collect()]


def feed(spark, rows):
    return spark.createDataFrame(rows, "k string, seq int, v string")


def test_scd2_rebuilt(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "x"), ("a", 4, "x"), ("b", 1, "z"), ("b", 1, "z")]
    got = sorted(tuple(r) for r in history.scd2(feed(spark, rows), "k", ["seq"], ["v"]).select("k", "valid_from", F.coalesce("valid_to", F.lit(99)), "v", "is_current").collect())
    assert got == [("a", 1, 3, "x", False), ("a", 3, 4, "y", False), ("a", 4, 99, "x", True), ("b", 1, 99, "z", True)]


def test_scd2_merged(spark):
    past = history.scd2(feed(spark, []), "k", ["seq"], ["v"])
    step = lambda past, rows: history.merge_scd2(past, feed(spark, rows), "k", "seq", ["v"])
    show = lambda past: sorted(tuple(r) for r in past.select("k", "v", "valid_from", F.coalesce("valid_to", F.lit(99)), "is_current").collect())
    one = step(past, [("a", 1, "x"), (None, 1, "n")])
    assert show(one) == [("a", "x", 1, 99, True)]
    assert show(step(one, [("a", 1, "x")])) == show(one)
    two = step(one, [("a", 2, "y"), ("a", 3, "z"), ("b", 1, "q")])  # the latest of a batch counts
    assert show(two) == [("a", "x", 1, 3, False), ("a", "z", 3, 99, True), ("b", "q", 1, 99, True)]
    assert show(step(two, [("a", 2, "late"), ("a", 3, "z")])) == show(two)
    three = step(two, [("a", 5, "x"), ("b", 5, "q")])
    assert show(three) == [("a", "x", 1, 3, False), ("a", "x", 5, 99, True), ("a", "z", 3, 5, False), ("b", "q", 1, 99, True)]
    assert history.not_one_current(three, "k").count() == 0 and [r.k for r in history.audit(three, "k").collect()] == ["a"] and history.current(three).count() == 2
    assert [(r.k, r.v) for r in history.scd1(feed(spark, [("a", 1, "x"), ("a", 2, "y")]), ["k"], ["seq"]).collect()] == [("a", "y")]

"""The DuckDB SQL that gives the rows of each registered query, written apart from the operators."""

from __future__ import annotations

BASE = """
WITH orders_raw AS (
  SELECT o_orderkey::VARCHAR order_id, o_custkey::VARCHAR customer_id, o_orderdate::TIMESTAMP order_ts,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'created' ELSE 'paid' END status,
         lower(trim(o_orderpriority)) channel, 'EUR' currency, upper(n_name) shipping_country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
orders_c AS (
  SELECT *, order_ts::DATE order_date, status IN ('paid','shipped','delivered') is_revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_ts DESC NULLS LAST, status DESC) rn FROM orders_raw) WHERE rn = 1),
items_c AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ingested_at DESC, discount_pct DESC, line_amount DESC, product_id DESC, quantity DESC, supplier_id DESC, unit_price DESC) rn FROM (
      SELECT *, (quantity * unit_price)::DECIMAL(14,2) line_amount FROM (
      SELECT l_orderkey || '-' || l_linenumber item_id, l_orderkey::VARCHAR order_id, l_partkey::VARCHAR product_id, l_quantity::INT quantity,
             p_retailprice::DECIMAL(12,2) unit_price, l_discount::DECIMAL(4,2) discount_pct, l_shipdate ingested_at, l_suppkey supplier_id
      FROM lineitem JOIN part ON l_partkey = p_partkey))) WHERE rn = 1),
products_c AS (
  SELECT p_partkey::VARCHAR product_id, p_name product_name, upper(p_type[1]) || lower(p_type[2:]) category,
         CASE WHEN p_size <= 15 THEN 'Small' WHEN p_size <= 35 THEN 'Medium' ELSE 'Large' END subcategory, p_brand brand, p_retailprice::DECIMAL(12,2) list_price,
         p_size % 10 <> 0 is_active, TIMESTAMP '2001-01-01' updated_at
  FROM part),
clicks_c AS (
  SELECT event_id::VARCHAR event_id, user_id || '-' || strftime(ts, '%Y%m%d') session_id, user_id::VARCHAR customer_id, ts event_ts,
         CASE event_type WHEN 'signup' THEN 'page_view' WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'checkout' ELSE 'other' END event_type,
         json_extract_string(props, '$.k') product_id,
         CASE (json_extract_string(props, '$.k')::INT) % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END device,
         ts::DATE event_date, event_type = 'purchase' is_conversion FROM events),
sold_c AS (
  SELECT item_id, i.order_id, customer_id, product_id, order_date, order_ts, status, channel, currency, shipping_country, is_revenue, quantity, unit_price,
         line_amount gross, (line_amount * discount_pct)::DECIMAL(14,2) discount,
         (line_amount - (line_amount * discount_pct)::DECIMAL(14,2))::DECIMAL(14,2) net
  FROM items_c i JOIN orders_c o USING (order_id)),
fact_c AS (
  SELECT sold_c.*, category, subcategory, brand, substr(sha256(customer_id), 1, 16) customer_sk, substr(sha256(product_id), 1, 16) product_sk
  FROM sold_c LEFT JOIN (SELECT product_id, category, subcategory, brand FROM products_c) USING (product_id)),
first_c AS (
  SELECT c_custkey k, c_custkey::VARCHAR customer_id, c_name full_name, lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 50 = 0 THEN '#' ELSE '@' END || 'mail.example' email,
         CASE WHEN c_custkey % 9 <> 0 THEN '+49' || c_custkey END phone, upper(n_name) country, 'City ' || (c_custkey % 7) city, lower(c_mktsegment) segment,
         DATE '1994-01-01' + (c_custkey % 1500)::INT signup_date, c_custkey % 50 <> 0 is_email_valid, (DATE '2000-01-01' + (c_custkey % 300)::INT)::TIMESTAMP updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
feed_c AS (
  SELECT * FROM first_c UNION ALL
  SELECT k, customer_id, full_name, email, phone, country, 'Town ' || (k % 5), segment, signup_date, is_email_valid, updated_at + INTERVAL 30 DAY FROM first_c WHERE k % 4 = 0),
history_c AS (
  SELECT *, updated_at valid_from, lead(updated_at) OVER (PARTITION BY k ORDER BY updated_at) valid_to FROM feed_c),
customers_c AS (SELECT * FROM history_c WHERE valid_to IS NULL),
daily_c AS (
  SELECT order_date, channel, category, count(DISTINCT order_id) orders_cnt, count(DISTINCT customer_id) customers_cnt, CAST(sum(quantity) AS BIGINT) units,
    CAST(sum(gross) AS DECIMAL(28,2)) gross_revenue, CAST(sum(discount) AS DECIMAL(28,2)) discount_total, CAST(sum(net) AS DECIMAL(28,2)) net_revenue,
    CAST(floor(100 * CAST(CAST(sum(net) AS DECIMAL(28,2)) AS DOUBLE) / count(DISTINCT order_id) + 0.5) / 100 AS DECIMAL(14,2)) aov
  FROM fact_c WHERE is_revenue GROUP BY order_date, channel, category),
rfm_c AS (
  SELECT *, r + f + m rfm_score, CASE WHEN r >= 4 AND f >= 4 THEN 'champions' WHEN r >= 4 THEN 'new_or_promising' WHEN r <= 2 AND m >= 4 THEN 'at_risk_high_value'
    WHEN r <= 2 THEN 'hibernating' ELSE 'loyal' END rfm_segment FROM (SELECT *, (DATE '2001-08-10' - last_order)::INT recency_days,
    CAST(6 - ntile(5) OVER (ORDER BY last_order DESC, customer_id) AS INT) r, CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INT) f, CAST(ntile(5) OVER (ORDER BY monetary, customer_id) AS INT) m
    FROM (SELECT customer_id, max(order_date) last_order, count(DISTINCT order_id) frequency, CAST(sum(net) AS DECIMAL(28,2)) monetary FROM sold_c WHERE is_revenue GROUP BY customer_id))),
days_c AS (SELECT d::DATE date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d)),
cut_c AS (SELECT (max(order_date) - 30)::DATE cut FROM sold_c),
features_c AS (
  SELECT c.customer_id, cut as_of_date, country, segment, (cut - signup_date)::INT tenure_days, orders_cnt, items_cnt, total_spent, avg_item_amount, categories_cnt, channels_cnt, avg_quantity, cancelled_items,
    (cut - last)::INT recency_days, (last - first)::INT active_span_days, orders_last_30d, spent_last_30d, coalesce(sessions_cnt, 0) sessions_cnt, coalesce(events_cnt, 0) events_cnt,
    coalesce(add_to_cart_cnt, 0) add_to_cart_cnt, coalesce(remove_from_cart_cnt, 0) remove_from_cart_cnt, coalesce(checkout_cnt, 0) checkout_cnt,
    coalesce(round(checkout_cnt::DOUBLE / nullif(add_to_cart_cnt, 0), 6), 0.0) cart_conversion_rate
  FROM customers_c c CROSS JOIN cut_c JOIN (SELECT customer_id, count(DISTINCT order_id) orders_cnt, count(*) items_cnt, CAST(sum(net) AS DECIMAL(28,2)) total_spent, round(avg(net::DOUBLE), 6) avg_item_amount,
      max(order_date) last, min(order_date) first, count(DISTINCT category) categories_cnt, count(DISTINCT channel) channels_cnt, round(avg(quantity::DOUBLE), 6) avg_quantity, count(*) FILTER (WHERE NOT is_revenue) cancelled_items,
      count(DISTINCT CASE WHEN is_revenue AND order_date >= cut - 30 THEN order_id END) orders_last_30d, CAST(coalesce(sum(CASE WHEN is_revenue AND order_date >= cut - 30 THEN net END), 0) AS DECIMAL(28,2)) spent_last_30d
      FROM fact_c CROSS JOIN cut_c WHERE order_date <= cut GROUP BY customer_id) p ON p.customer_id = c.customer_id
    LEFT JOIN (SELECT customer_id, count(DISTINCT session_id) sessions_cnt, count(*) events_cnt, count(*) FILTER (WHERE event_type = 'add_to_cart') add_to_cart_cnt, count(*) FILTER (WHERE event_type = 'remove_from_cart') remove_from_cart_cnt,
      count(*) FILTER (WHERE is_conversion) checkout_cnt FROM clicks_c CROSS JOIN cut_c WHERE event_date <= cut GROUP BY customer_id) b ON b.customer_id = c.customer_id),
labels_c AS (
  SELECT customer_id, as_of_date, (CASE WHEN customer_id IN (SELECT customer_id FROM sold_c, cut_c WHERE is_revenue AND order_date > cut) THEN 0 ELSE 1 END)::INT churned FROM features_c),
risk_c AS (
  SELECT *, CASE WHEN churn_probability >= 0.7 THEN 'high' WHEN churn_probability >= 0.4 THEN 'medium' ELSE 'low' END risk_band FROM (
    SELECT customer_id, segment, total_spent, round(least(1.0::DOUBLE, recency_days / (active_span_days + 30.0::DOUBLE)), 6) churn_probability FROM features_c)),
halves_a AS (SELECT order_id, status FROM orders_c WHERE order_id::BIGINT % 5 <> 0),
halves_b AS (SELECT order_id, CASE WHEN order_id::BIGINT % 3 = 0 THEN 'returned' ELSE status END status FROM orders_c WHERE order_id::BIGINT % 7 <> 0),
v1_c AS (SELECT coalesce(b.order_id, a.order_id) order_id, coalesce(b.status, a.status) status FROM halves_a a FULL JOIN halves_b b USING (order_id))
"""

FAILED = "count(*) FILTER (WHERE NOT coalesce({}, false))"


def profile(frame: str, rules: list[tuple[str, str, str | None]], cols: str = "") -> str:
    """rule, severity and the condition that must be true; None: the tables lack what it needs."""
    each = " UNION ALL ".join(f"SELECT '{r}' rule, '{s}' severity, count(*) rows_total, {FAILED.format(c) if c else 'NULL::BIGINT'} rows_failed FROM {frame}" for r, s, c in rules)
    return f"SELECT *, CASE WHEN rows_failed IS NULL THEN NULL WHEN rows_total = 0 THEN 0.0::DOUBLE ELSE rows_failed::DOUBLE / rows_total END failure_rate, rows_failed = 0 passed{cols} FROM ({each})"


ORDER_RULES = [
    ("orders_id_not_null", "fail", "order_id IS NOT NULL AND length(order_id) > 0"), ("orders_customer_known", "drop", "customer_id IS NOT NULL"), ("orders_ts_not_null", "drop", "order_ts IS NOT NULL"),
    ("orders_ts_not_in_future", "drop", "order_ts <= TIMESTAMP '2001-07-02'"), ("orders_status_known", "warn", "status <> 'unknown'"),
]
R1 = "(SELECT * FROM orders_c WHERE order_id::BIGINT % 2 = 1 AND order_date < DATE '1998-01-01')"
SHARE = "round(100.0::DOUBLE * ({})::DOUBLE / nullif({}, 0), 1)"
FUNNEL = "count(*) sessions, CAST(sum(v) AS BIGINT) with_product_view, CAST(sum(c) AS BIGINT) with_add_to_cart, CAST(sum(k) AS BIGINT) with_checkout"
OVERVIEW = """SELECT order_date, channel, category, CAST(sum(net_revenue) AS DECIMAL(28,2)) net_revenue, CAST(sum(orders_cnt) AS BIGINT) orders, CAST(sum(units) AS BIGINT) units,
  floor(100 * sum(net_revenue)::DOUBLE / sum(orders_cnt) + 0.5) / 100 avg_order_value, round(100 * sum(discount_total)::DOUBLE / nullif((sum(net_revenue) + sum(discount_total))::DOUBLE, 0), 2) discount_share_pct
  FROM daily_c WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '{}' {} GROUP BY ALL"""
WINDOWS = "SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) window_start, device, {} FROM clicks_c GROUP BY ALL"
HISTORY = "SELECT customer_id, city, valid_from, valid_to, valid_to IS NULL is_current FROM history_c"
CHANGES = """SELECT order_id, 'insert' change, b.status status{v} FROM {b} b WHERE order_id NOT IN (SELECT order_id FROM {a}) UNION ALL SELECT order_id, 'delete', a.status{v} FROM {a} a WHERE order_id NOT IN (SELECT order_id FROM {b})
  UNION ALL SELECT order_id, 'update_preimage', a.status{v} FROM {a} a JOIN {b} b USING (order_id) WHERE a.status <> b.status UNION ALL SELECT order_id, 'update_postimage', b.status{v} FROM {a} a JOIN {b} b USING (order_id) WHERE a.status <> b.status"""
V2 = "(SELECT * FROM v1_c WHERE order_id::BIGINT % 3 <> 1)"
PRICES = "(VALUES ('A', 0.5, DATE '1990-01-01', DATE '1997-01-01'), ('A', 0.75, DATE '1997-01-01', NULL), ('N', 1.25, DATE '1990-01-01', NULL), ('R', 0.1, DATE '1998-01-01', DATE '1999-01-01')) p(sku, price, valid_from, valid_to)"
CUSTOMER = "customer_id, full_name, email, phone, country, city, segment, signup_date, is_email_valid"
MEANS = ", ".join(f"round(avg({c}::DOUBLE), 2) avg_{c}" for c in ("recency_days", "orders_cnt", "total_spent", "sessions_cnt", "orders_last_30d"))

SQL = {
    "clean_orders": "SELECT order_id, customer_id, order_ts, status, channel, currency, shipping_country, order_date, is_revenue FROM orders_c",
    "clean_items": "SELECT item_id, order_id, product_id, quantity, unit_price, discount_pct, line_amount FROM items_c",
    "clean_customers": f"SELECT {CUSTOMER}, updated_at FROM feed_c",
    "clean_products": "SELECT * FROM products_c",
    "clean_clicks": "SELECT * FROM clicks_c",
    "masked_customers": "SELECT customer_id, concat(left(full_name, 1), '***') AS name, concat('***@', split_part(email, '@', 2)) email FROM customers_c",
    "surrogate_keys": "SELECT customer_id, substr(sha256(customer_id), 1, 16) customer_sk FROM customers_c",
    "row_hashes": "SELECT customer_id, updated_at, sha256(full_name || '||' || email || '||' || coalesce(phone, '~') || '||' || country || '||' || city || '||' || segment) row_hash FROM feed_c",
    "email_validity": r"SELECT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') is_email_valid, count(*) customers FROM customers_c GROUP BY 1",
    "latest_item_of_product": "SELECT product_id, arg_max(item_id, quantity) item_id, max(quantity) quantity FROM (SELECT product_id, min(item_id) item_id, quantity FROM items_c GROUP BY product_id, quantity) GROUP BY product_id",
    "star_except": "SELECT order_id, customer_id, status, channel, shipping_country, order_date, is_revenue FROM orders_c WHERE is_revenue",
    "dq_profile_orders": profile("orders_c", [*ORDER_RULES, ("orders_discount_range", "warn", None)]),
    "dq_profile_items": profile("items_c", [
        ("items_quantity_positive", "drop", "quantity > 0"), ("items_price_positive", "drop", "unit_price > 0"), ("items_order_ref", "fail", "order_id IS NOT NULL"), ("items_amount_consistent", "warn", "abs(line_amount - quantity * unit_price) < 0.01")]),
    "dq_profile_customers": profile("feed_c", [
        ("customers_id_not_null", "fail", "customer_id IS NOT NULL"), ("customers_email_valid", "warn", r"regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"), ("customers_signup_past", "warn", "signup_date <= DATE '2001-07-01'")]),
    "dq_profile_clicks": profile("clicks_c", [("events_id_not_null", "fail", "event_id IS NOT NULL"), ("events_ts_not_null", "drop", "event_ts IS NOT NULL"), ("events_type_known", "drop", "event_type <> 'other'")]),
    "dq_metrics_clicks": "SELECT unnest(['events_id_not_null', 'events_ts_not_null', 'events_type_known']) rule, unnest([count(*) FILTER (WHERE event_id IS NULL), count(*) FILTER (WHERE event_ts IS NULL), count(*) FILTER (WHERE event_type = 'other')]) rows_failed, count(*) rows_total FROM clicks_c",
    "dq_quarantine_orders": "SELECT order_id, 'orders_ts_not_in_future' rule FROM orders_c WHERE NOT coalesce(order_ts <= TIMESTAMP '2001-07-02', false) UNION ALL SELECT order_id, 'orders_customer_known' FROM orders_c WHERE customer_id IS NULL",
    "dq_quarantine_items": "SELECT item_id, 'items_quantity_positive' rule FROM items_c WHERE NOT coalesce(quantity > 0, false) UNION ALL SELECT item_id, 'items_price_positive' FROM items_c WHERE NOT coalesce(unit_price > 0, false)",
    "dq_quarantine_clicks": "SELECT event_id, 'events_type_known' rule FROM clicks_c WHERE event_type = 'other'",
    "dq_valid_orders": "SELECT order_id, order_ts, status FROM orders_c WHERE order_ts <= TIMESTAMP '2001-07-02' AND customer_id IS NOT NULL",
    "dq_reasons": "SELECT rule, count(*) rows FROM (SELECT 'orders_ts_not_in_future' rule FROM orders_c WHERE order_ts > TIMESTAMP '2001-07-02' UNION ALL SELECT 'events_type_known' FROM clicks_c WHERE event_type = 'other') GROUP BY rule",
    "dq_trend": f"SELECT 'orders' dataset, b.rule, b.severity, 'r2' run_id, b.failure_rate, a.failure_rate previous_rate, b.failure_rate - a.failure_rate delta, b.failure_rate - a.failure_rate > 0.05 alarm FROM ({profile(R1, ORDER_RULES)}) a JOIN ({profile('orders_c', ORDER_RULES)}) b USING (rule)",
    "dq_latest_blocking": f"SELECT count(*) FILTER (WHERE severity = 'fail' AND rows_failed > 0) blocking_failures FROM ({profile('orders_c', ORDER_RULES)})",
    "alert_hours_since": "SELECT round(date_diff('second', TIMESTAMP '2001-07-01 03:30:00', TIMESTAMP '2001-07-02 12:15:00') / 3600.0::DOUBLE, 1) hours_since_last_run",
    "mart_checks": """SELECT check_name, severity, rows_failed, rows_failed = 0 passed FROM (
        SELECT 'orphan_items' check_name, 'fail' severity, (SELECT count(*) FROM fact_c f WHERE NOT EXISTS (SELECT 1 FROM orders_c o WHERE o.order_id = f.order_id)) rows_failed
        UNION ALL SELECT 'unknown_products', 'warn', (SELECT count(*) FROM fact_c WHERE category IS NULL) UNION ALL SELECT 'negative_revenue', 'fail', (SELECT count(*) FROM daily_c WHERE net_revenue < 0)
        UNION ALL SELECT 'calendar_gaps', 'warn', (SELECT count(*) FROM days_c WHERE date BETWEEN (SELECT min(order_date) FROM daily_c) AND (SELECT max(order_date) FROM daily_c) AND date NOT IN (SELECT order_date FROM daily_c))
        UNION ALL SELECT 'customers_without_rfm', 'warn', 0)""",
    "dim_date": "SELECT date, year(date)::INT AS year, quarter(date)::INT AS quarter, month(date)::INT AS month, day(date)::INT AS day, week(date)::INT AS week, (dayofweek(date) + 1)::INT day_of_week, dayname(date) day_name, dayofweek(date) IN (0, 6) is_weekend, date_trunc('month', date)::DATE month_start FROM days_c",
    "dim_customer": "SELECT substr(sha256(customer_id), 1, 16) customer_sk, customer_id, full_name, email, country, city, segment, signup_date, is_email_valid, valid_from, (DATE '2001-08-10' - signup_date)::INT tenure_days FROM customers_c",
    "dim_product": "SELECT substr(sha256(product_id), 1, 16) product_sk, product_id, product_name, category, subcategory, brand, list_price, is_active FROM products_c",
    "fact_items": "SELECT * FROM fact_c",
    "daily_sales": "SELECT *, round(avg(net_revenue::DOUBLE) OVER (PARTITION BY channel, category ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) avg_7d FROM daily_c",
    "rfm": "SELECT * FROM rfm_c",
    "rfm_segments": "SELECT rfm_segment, count(*) customers, CAST(sum(monetary) AS DECIMAL(28,2)) monetary FROM rfm_c GROUP BY rfm_segment",
    "top_products": """SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY category ORDER BY net_revenue DESC) AS INT) AS position FROM (SELECT category, product_id, brand,
        CAST(sum(quantity) AS BIGINT) units, CAST(sum(net) AS DECIMAL(28,2)) net_revenue, count(DISTINCT order_id) orders_cnt FROM fact_c WHERE is_revenue GROUP BY category, product_id, brand)) WHERE position <= 10""",
    "sessions": """SELECT session_id, event_date, device, min(customer_id) customer_id, min(event_ts) started, max(event_ts) ended, count(*) events, count(DISTINCT product_id) products, max(is_conversion::INT) converted,
        date_diff('second', min(event_ts), max(event_ts)) - CASE WHEN min(event_ts) + to_seconds(date_diff('second', min(event_ts), max(event_ts))) > max(event_ts) THEN 1 ELSE 0 END duration_s FROM clicks_c GROUP BY session_id, event_date, device""",
    "customer_360": """SELECT c.customer_id, segment, country, coalesce(frequency, 0) orders_cnt, coalesce(monetary, 0::DECIMAL(28,2)) revenue, last_order, coalesce(sessions, 0) sessions, coalesce(checkouts, 0) checkouts, recency_days days_since_last_order
        FROM customers_c c LEFT JOIN rfm_c r ON r.customer_id = c.customer_id LEFT JOIN (SELECT customer_id, count(DISTINCT session_id) sessions, count(*) FILTER (WHERE is_conversion) checkouts FROM clicks_c GROUP BY customer_id) b ON b.customer_id = c.customer_id""",
    "revenue_by_day": "SELECT order_date, CAST(sum(net) AS DECIMAL(28,2)) revenue, count(DISTINCT order_id) orders_cnt FROM sold_c WHERE is_revenue GROUP BY order_date",
    "revenue_overview": OVERVIEW.format("1998-12-31", ""),
    "revenue_overview_channel": OVERVIEW.format("1996-06-30", "AND channel = '1-urgent'"),
    "cohort_retention": """SELECT cohort, month_no, customers, cohort_size, round(100.0::DOUBLE * customers / cohort_size, 1) retention_pct FROM (
        SELECT cohort, (date_diff('month', cohort, m))::INT month_no, count(*) customers, max(max(n)) OVER (PARTITION BY cohort) cohort_size FROM (SELECT DISTINCT customer_id, date_trunc('month', order_date)::DATE m FROM sold_c WHERE is_revenue)
        JOIN (SELECT customer_id, min(date_trunc('month', order_date))::DATE cohort FROM sold_c WHERE is_revenue GROUP BY 1) USING (customer_id)
        JOIN (SELECT cohort, count(*) n FROM (SELECT customer_id, min(date_trunc('month', order_date))::DATE cohort FROM sold_c WHERE is_revenue GROUP BY 1) GROUP BY 1) USING (cohort) GROUP BY cohort, 2)""",
    "funnel": f"""SELECT device, {FUNNEL}, {SHARE.format('sum(c)', 'sum(v)')} view_to_cart_pct, {SHARE.format('sum(k)', 'sum(c)')} cart_to_checkout_pct, {SHARE.format('sum(k)', 'count(*)')} session_conversion_pct FROM (SELECT session_id, device,
        max((event_type = 'product_view')::INT) v, max((event_type = 'add_to_cart')::INT) c, max((event_type = 'checkout')::INT) k FROM clicks_c WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY session_id, device) GROUP BY device""",
    "alert_revenue_drop": """, d AS (SELECT order_date, sum(net_revenue)::DOUBLE revenue FROM daily_c GROUP BY 1), t AS (SELECT max(order_date) today FROM d), u AS (SELECT avg(revenue) usual FROM d, t WHERE order_date BETWEEN today - 7 AND today - 1)
        SELECT round(100.0::DOUBLE * ((SELECT revenue FROM d, t WHERE order_date = today) - usual) / nullif(usual, 0), 1) revenue_change_pct FROM u""",
    "alert_cancelled_share": "SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE NOT is_revenue) / nullif(count(*), 0), 1) cancelled_pct FROM sold_c WHERE order_date >= DATE '2001-07-13'",
    "anti_orphans": "SELECT count(*) orphans FROM items_c i WHERE NOT EXISTS (SELECT 1 FROM orders_c o WHERE o.order_id = i.order_id)",
    "not_in_anti": "SELECT customer_id FROM customers_c WHERE customer_id NOT IN (SELECT customer_id FROM orders_c WHERE customer_id IS NOT NULL)",
    "exists_semi": "SELECT customer_id FROM customers_c c WHERE EXISTS (SELECT 1 FROM sold_c f WHERE f.customer_id = c.customer_id AND f.net > 1000)",
    "share_of_total": "SELECT segment, count(*) n, round(count(*)::DOUBLE / (SELECT count(*) FROM customers_c), 6) AS share FROM customers_c GROUP BY segment",
    "except_all": "SELECT customer_id FROM orders_c EXCEPT ALL SELECT customer_id FROM orders_c WHERE is_revenue",
    "union_all": "SELECT customer_id, 'order' kind FROM orders_c UNION ALL SELECT customer_id, 'click' FROM clicks_c",
    "distinct_activity": "SELECT DISTINCT customer_id, date_trunc('month', order_date)::DATE m FROM orders_c",
    "channel_filter": "SELECT order_id, channel FROM orders_c WHERE channel = '5-low'",
    "latest_day_orders": "SELECT order_id, order_date FROM orders_c WHERE order_date = (SELECT max(order_date) FROM orders_c)",
    "avg_duration": """SELECT device, round(avg(s), 4) avg_s, max(s) max_s FROM (SELECT device, session_id, event_date, floor(epoch(max(event_ts)) - epoch(min(event_ts)))::BIGINT s FROM clicks_c GROUP BY ALL) GROUP BY device""",
    "top_spenders": "SELECT customer_id, monetary FROM rfm_c ORDER BY monetary DESC, customer_id LIMIT 25",
    "busy_customers": "SELECT customer_id, count(*) orders_cnt FROM orders_c GROUP BY 1 HAVING count(*) > 15",
    "calendar_gaps": "SELECT date FROM days_c WHERE NOT EXISTS (SELECT 1 FROM orders_c WHERE is_revenue AND order_date = date)",
    "range_price_join": """SELECT p.valid_from, count(*) n, CAST(sum(f.quantity) AS BIGINT) units FROM sold_c f JOIN (SELECT 'paid' status, DATE '1995-01-01' valid_from, DATE '1998-01-01' valid_to
        UNION ALL SELECT 'paid', DATE '1998-01-01', CAST(NULL AS DATE)) p ON f.status = p.status AND f.order_date >= p.valid_from AND (p.valid_to IS NULL OR f.order_date < p.valid_to) GROUP BY p.valid_from""",
    "self_rank_join": ", o AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_ts DESC, order_id DESC) place FROM orders_c) SELECT a.customer_id, a.order_id, a.status, b.order_id before_id, b.status before_status FROM o a JOIN o b ON a.customer_id = b.customer_id AND a.place = 1 AND b.place = 2",
    "multi_version_customers": "SELECT customer_id, city, updated_at FROM feed_c WHERE k % 4 = 0",
    "windows_5min_exact": WINDOWS.format("count(*) events, count(DISTINCT session_id) sessions, count(DISTINCT product_id) products, count(*) FILTER (WHERE event_type = 'add_to_cart') carts, count(*) FILTER (WHERE is_conversion) checkouts, round(count(*) FILTER (WHERE is_conversion)::DOUBLE / count(DISTINCT session_id), 6) conversion_rate"),
    "scd2_history": """SELECT customer_id, channel, order_ts valid_from, lead(order_ts) OVER (PARTITION BY customer_id ORDER BY order_ts, order_id) valid_to FROM (
        SELECT *, lag(channel) OVER (PARTITION BY customer_id ORDER BY order_ts, order_id) was FROM orders_c) q WHERE was IS NULL OR was <> channel""",
    "scd2_rebuilt": HISTORY,
    "scd2_two_batches": HISTORY,
    "scd2_idempotent": HISTORY,
    "scd2_audit": "SELECT customer_id, count(*) versions, min(valid_from) first_change, max(valid_from) last_change, count(*) FILTER (WHERE valid_to IS NULL) open_versions FROM history_c GROUP BY 1 HAVING count(*) > 1",
    "scd2_invariant": "SELECT customer_id, count(*) FILTER (WHERE valid_to IS NULL) open_versions FROM history_c GROUP BY 1 HAVING count(*) FILTER (WHERE valid_to IS NULL) <> 1",
    "scd1_current": "SELECT customer_id, city, updated_at FROM customers_c",
    "current_customers": f"SELECT {CUSTOMER}, valid_from FROM customers_c",
    "change_feed": CHANGES.format(a="halves_a", b="halves_b", v=""),
    "merge_upsert": "SELECT order_id, coalesce(b.status, a.status) status, b.order_id IS NULL is_deleted FROM halves_a a FULL JOIN halves_b b USING (order_id)".replace("b.order_id IS NULL", "b.status IS NULL"),
    "merge_insert_only": "SELECT order_id, coalesce(a.status, b.status) status FROM halves_a a FULL JOIN halves_b b USING (order_id)",
    "merge_delete": "SELECT order_id, coalesce(a.status, b.status) status FROM halves_a a FULL JOIN halves_b b USING (order_id) WHERE coalesce(b.status, '') <> 'returned'",
    "time_travel_diff": "SELECT * FROM v1_c WHERE order_id::BIGINT % 3 = 1",
    "restore_table": "SELECT * FROM halves_a",
    "table_changes": CHANGES.format(a="halves_a", b="v1_c", v=", 1::BIGINT commit_version") + " UNION ALL " + CHANGES.format(a="v1_c", b=V2, v=", 2::BIGINT commit_version"),
    "table_history": """SELECT * FROM (VALUES (0::BIGINT, TIMESTAMP '2001-01-01', 'overwrite', (SELECT count(*) FROM halves_a), 1), (1, TIMESTAMP '2001-01-02', 'merge', (SELECT count(*) FROM v1_c), 1),
        (2, TIMESTAMP '2001-01-03', 'overwrite', (SELECT count(*) FROM v1_c WHERE order_id::BIGINT % 3 <> 1), 1), (3, TIMESTAMP '2001-01-04', 'restore', 0, 1)) t(version, "at", operation, rows_written, folders)""",
    "clone_table": f"SELECT order_id, status, NULL::VARCHAR note, (SELECT count(*) FROM halves_a)::INT own FROM {V2} UNION ALL SELECT 'x1', 'paid', 'new', (SELECT count(*) FROM halves_a)::INT",
    "rename_column": "SELECT order_id, status state FROM halves_a",
    "bronze_ingest": """SELECT event_id, CASE WHEN event_id::BIGINT % 2 = 0 THEN event_id::BIGINT END n, event_type, CASE WHEN event_id::BIGINT % 2 = 1 THEN 'app' END channel, CASE WHEN event_id::BIGINT % 10 = 1 THEN 'n' || event_id END rescued_n FROM clicks_c""",
    "stream_windows_5min": WINDOWS.format("count(*) events, count(*) FILTER (WHERE is_conversion) checkouts"),
    "stream_upsert_restart": WINDOWS.format("count(*) events, count(*) FILTER (WHERE is_conversion) checkouts"),
    "stream_enriched": "SELECT event_id, product_id, category, brand FROM clicks_c LEFT JOIN products_c USING (product_id)",
    "expectation_metrics": """SELECT 'clicks_silver' dataset, unnest(['has_product', 'events_ts_not_null', 'events_type_known', 'events_id_not_null']) expectation, unnest([count(*) FILTER (WHERE product_id <> '0'), count(*), count(*) FILTER (WHERE event_type <> 'other'), count(*)]) passed,
        unnest([count(*) FILTER (WHERE product_id = '0'), 0, count(*) FILTER (WHERE event_type = 'other'), 0]) failed, round(unnest([count(*) FILTER (WHERE product_id = '0'), 0, count(*) FILTER (WHERE event_type = 'other'), 0])::DOUBLE / count(*), 6) failure_rate FROM clicks_c""",
    "flow_progress": """SELECT 'clicks_silver' dataset, count(*) FILTER (WHERE event_type <> 'other') rows_written, count(*) FILTER (WHERE event_type = 'other') rows_dropped, TIMESTAMP '2024-02-01' last_at FROM clicks_c
        UNION ALL SELECT 'clicks_by_type', count(DISTINCT event_type), 0, TIMESTAMP '2024-02-01' FROM clicks_c WHERE event_type <> 'other'""",
    "flow_result": "SELECT event_type, count(*) events FROM clicks_c WHERE event_type <> 'other' GROUP BY 1",
    "secured_rows": "SELECT customer_id, left(full_name, 1) || '***' full_name, '***@' || split_part(email, '@', 2) email, country FROM customers_c WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3')",
    "job_sla": """SELECT 'job' || (o_orderkey % 5) job, count(*) runs, round(avg((o_orderkey % 97 * 30)::DOUBLE), 2) avg_s, max(o_orderkey % 97 * 30) max_s, count(*) FILTER (WHERE o_orderkey % 11 = 0) failed, count(*) FILTER (WHERE o_orderkey % 97 * 30 > 2400) over_limit FROM orders GROUP BY 1""",
    "cost_per_job": f"SELECT 'job' || (l_orderkey % 5) job, sku, CAST(sum(l_quantity::INT) AS BIGINT) units, CAST(sum(l_quantity::INT * price::DECIMAL(10,4)) AS DECIMAL(28,4)) AS cost FROM lineitem JOIN {PRICES} ON l_returnflag = sku AND l_shipdate::DATE >= valid_from AND (valid_to IS NULL OR l_shipdate::DATE < valid_to) GROUP BY 1, 2",
    "lineage_last_seen": "SELECT o_orderpriority AS source, o_orderstatus AS target, count(*) times, max(o_orderdate) last_seen FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1, 2",
    "undocumented_tables": "SELECT n_name table_name FROM nation WHERE n_nationkey % 3 <> 1",
    "heavy_queries": "SELECT o_orderkey AS id, o_totalprice AS bytes FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "table_readers": "SELECT 'u' || o_custkey AS user, o_orderpriority table_name, count(*) AS reads, max(o_orderdate) last_read FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY 1, 2",
    "churn_features": "SELECT * FROM features_c",
    "churn_labels": "SELECT * FROM labels_c",
    "class_balance": "SELECT churned, count(*) customers, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM labels_c), 1) share_pct FROM labels_c GROUP BY 1",
    "class_means": f"SELECT churned, {MEANS} FROM features_c JOIN labels_c USING (customer_id) GROUP BY 1",
    "risk_distribution": "SELECT risk_band, segment, count(*) customers, round(avg(churn_probability), 4) avg_probability, CAST(sum(total_spent) AS DECIMAL(28,2)) spent FROM risk_c GROUP BY 1, 2",
    "save_list": "SELECT r.customer_id, r.segment, rfm_segment, churn_probability, total_spent FROM risk_c r LEFT JOIN rfm_c USING (customer_id) WHERE risk_band = 'high' ORDER BY total_spent DESC, r.customer_id LIMIT 50",
    "drift_summary": "SELECT count(*) customers, round(avg(churn_probability), 6) avg_probability, count(*) FILTER (WHERE risk_band = 'high') high, count(*) FILTER (WHERE risk_band = 'medium') medium, count(*) FILTER (WHERE risk_band = 'low') low, 'run1' run_id FROM risk_c",
}


def oracle_sql() -> dict[str, str]:
    return {n: BASE.rstrip() + ("" if q.startswith(",") else "\n") + q for n, q in SQL.items()}

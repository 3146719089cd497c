"""Dashboard queries in SQL with named parameters; tables are named by IDENTIFIER, so one text serves every environment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

REVENUE_OVERVIEW = """
SELECT order_date, channel, category, CAST(sum(net_revenue) AS DECIMAL(28,2)) AS net_revenue, CAST(sum(orders_cnt) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units,
  floor(100 * CAST(sum(net_revenue) AS DOUBLE) / nullif(CAST(sum(orders_cnt) AS DOUBLE), 0) + 0.5) / 100 AS avg_order_value,
  round(100 * CAST(sum(discount_total) AS DOUBLE) / nullif(CAST(sum(net_revenue) + sum(discount_total) AS DOUBLE), 0), 2) AS discount_share_pct
FROM IDENTIFIER(:prefix || 'daily_sales')
WHERE order_date BETWEEN :date_from AND :date_to AND (:channel = 'all' OR channel = :channel)
GROUP BY ALL ORDER BY order_date
"""


def revenue_overview(daily: DataFrame, first: date, last: date, channel: str = "all") -> DataFrame:
    """Revenue, orders, units, order value and discount share by day, channel and category. An order of several categories counts
    in each."""
    spark: SparkSession = daily.sparkSession
    daily.createOrReplaceTempView("quarry_daily_sales")
    return spark.sql(REVENUE_OVERVIEW, args={"prefix": "quarry_", "date_from": first, "date_to": last, "channel": channel})

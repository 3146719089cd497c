"""The jobs from landing files to scores, run twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.plans import jobs
from quarry.settings import Settings
from quarry.sources.versioned import VersionedTable

FIRST = datetime(2026, 1, 1)


def test_daily_job_is_idempotent_and_feeds_the_others(spark, tmp_path):
    s = Settings(f"file://{tmp_path}")
    jobs.bootstrap(spark, s, FIRST, days=3, orders=120, customers=60, products=20, clicks=150)
    now = FIRST + timedelta(days=3)
    one = jobs.medallion(spark, s, "r1", now).run()
    assert {k: v["state"] for k, v in one.items()} == {"bronze": "success", "silver": "success", "gold": "success", "report": "success", "_run": "success"}, one
    orders = one["silver"]["value"]["orders"]
    assert orders["rows"] == 360 and 0 < orders["rejected"] < 40 and orders["valid"] + orders["rejected"] == 360
    checks = {r["check_name"]: r["rows_failed"] for r in one["report"]["value"]}
    assert checks["orphan_items"] == 0 and checks["negative_revenue"] == 0 and checks["calendar_gaps"] == 0
    fact, past = s.read(spark, "gold", "fact_items").count(), VersionedTable(spark, s.table("silver", "customers_history")).read()
    assert past.count() > 60 == past.where("is_current").count()
    two = jobs.medallion(spark, s, "r2", now).run()  # nothing new has landed
    assert two["_run"]["state"] == "success" and two["bronze"]["value"] == one["bronze"]["value"]
    assert s.read(spark, "gold", "fact_items").count() == fact
    assert VersionedTable(spark, s.table("silver", "customers_history")).read().exceptAll(past).count() == 0
    assert spark.read.parquet(s.table("ops", "dq_results") + "/metrics").select("run_id").distinct().count() == 2
    churned = jobs.churn_job(spark, s, now, window=1, iterations=2, depth=2).run()
    assert churned["_run"]["state"] == "success" and churned["train"]["value"] == "champion" and churned["score"]["value"] == s.read(spark, "ml", "features").count(), churned
    seen = jobs.live(spark, s, [now + timedelta(minutes=5 * k) for k in range(2)], rows=40)
    assert 0 < seen.agg(F.sum("events")).first()[0] <= 80

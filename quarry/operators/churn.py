"""Churn: features and labels at a cut-off, training with a champion gate, batch scoring, drift."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import percent, total

#: Days after the cut-off in which a customer has to buy again.
WINDOW = 30
CATEGORICAL = ["country", "segment"]
NUMERIC = [
    "tenure_days", "orders_cnt", "items_cnt", "total_spent", "avg_item_amount", "categories_cnt", "channels_cnt", "avg_quantity", "cancelled_items", "recency_days", "active_span_days",
    "orders_last_30d", "spent_last_30d", "sessions_cnt", "events_cnt", "add_to_cart_cnt", "remove_from_cart_cnt", "checkout_cnt", "cart_conversion_rate",
]


def cut_off(sold: DataFrame, window: int = WINDOW) -> date:
    """The last day of purchases less the label window: one number to the driver."""
    return sold.agg(F.max("order_date")).first()[0] - timedelta(days=window)


def features(customers: DataFrame, fact: DataFrame, clicks: DataFrame, as_of: date) -> DataFrame:
    """One row per customer that bought on or before as_of, from nothing later than that."""
    day, known = F.lit(as_of), F.col("customer_id").isNotNull()
    past = fact.where(known & (F.col("order_date") <= day))
    recent = F.col("is_revenue") & (F.col("order_date") >= F.date_sub(day, WINDOW))
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    bought = past.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("orders_cnt"), F.count("*").alias("items_cnt"), total("net", "total_spent"), mean("net").alias("avg_item_amount"),
        F.max("order_date").alias("last"), F.min("order_date").alias("first"), F.countDistinct("category").alias("categories_cnt"), F.countDistinct("channel").alias("channels_cnt"),
        mean("quantity").alias("avg_quantity"), F.count_if(~F.col("is_revenue")).alias("cancelled_items"),
        F.countDistinct(F.when(recent, F.col("order_id"))).alias("orders_last_30d"), total(F.when(recent, F.col("net")), "spent_last_30d"),
    )
    kind = lambda k, name: F.count_if(F.col("event_type") == k).alias(name)
    seen = clicks.where(known & (F.col("event_date") <= day)).groupBy("customer_id").agg(
        F.countDistinct("session_id").alias("sessions_cnt"), F.count("*").alias("events_cnt"), kind("add_to_cart", "add_to_cart_cnt"), kind("remove_from_cart", "remove_from_cart_cnt"), F.count_if("is_conversion").alias("checkout_cnt")
    )
    out = customers.select("customer_id", *CATEGORICAL, "signup_date").join(bought, "customer_id").join(seen, "customer_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("sessions_cnt", "events_cnt", "add_to_cart_cnt", "remove_from_cart_cnt", "checkout_cnt")}
    out = out.withColumns(zeros).withColumns({
        "as_of_date": day, "tenure_days": F.datediff(day, "signup_date"), "recency_days": F.datediff(day, "last"), "active_span_days": F.datediff("last", "first"),
        "cart_conversion_rate": F.coalesce(F.round(F.try_divide(F.col("checkout_cnt").cast("double"), F.col("add_to_cart_cnt")), 6), F.lit(0.0)),
    })
    return out.select("customer_id", "as_of_date", *CATEGORICAL, *NUMERIC)


def labels(of: DataFrame, sold: DataFrame, as_of: date) -> DataFrame:
    """churned = 1 for customers with features that have no revenue order after as_of."""
    later = sold.where(F.col("is_revenue") & (F.col("order_date") > F.lit(as_of)) & F.col("customer_id").isNotNull()).select("customer_id").distinct().withColumn("again", F.lit(1))
    return of.select("customer_id").join(later, "customer_id", "left").select("customer_id", F.lit(as_of).alias("as_of_date"), F.when(F.col("again").isNull(), 1).otherwise(0).alias("churned"))


def class_balance(labelled: DataFrame) -> DataFrame:
    n = F.count("*")
    share = percent(n, F.sum(n).over(Window.partitionBy()), 1)  # the window has a row for each class
    return labelled.groupBy("churned").agg(n.alias("customers"), share.alias("share_pct"))


def class_means(of: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean features of each class: a feature that tells the classes apart too well is a leak."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 2).alias("avg_" + c)
    return of.join(labelled, ["customer_id", "as_of_date"]).groupBy("churned").agg(*[mean(c) for c in ("recency_days", "orders_cnt", "total_spent", "sessions_cnt", "orders_last_30d")])


def split(rows: DataFrame, share: float = 0.75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, the same share of each class; a customer's side depends on its id alone, so both are stable."""
    place = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(10_000)) / 10_000
    spot = F.percent_rank().over(Window.partitionBy("churned", F.pmod(F.xxhash64("customer_id"), F.lit(64))).orderBy(place, "customer_id"))
    dealt = rows.withColumn("_at", spot)
    return dealt.where(F.col("_at") < share).drop("_at"), dealt.where(F.col("_at") >= share).drop("_at")


def pipeline(iterations: int = 200, rate: float = 0.08, depth: int = 6) -> Pipeline:
    index = [StringIndexer(inputCol=c, outputCol=c + "_i", handleInvalid="keep") for c in CATEGORICAL]
    hot = OneHotEncoder(inputCols=[c + "_i" for c in CATEGORICAL], outputCols=[c + "_v" for c in CATEGORICAL], handleInvalid="keep")
    put = VectorAssembler(inputCols=[*NUMERIC, *[c + "_v" for c in CATEGORICAL]], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*index, hot, put, GBTClassifier(labelCol="churned", maxIter=iterations, stepSize=rate, maxDepth=depth, seed=42)])


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


def measure(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    scored = model.transform(_typed(rows))
    return {name: BinaryClassificationEvaluator(labelCol="churned", metricName=kind).evaluate(scored) for name, kind in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR"))}


def importance(model: PipelineModel, rows: DataFrame, top: int = 15, seed: int = 42) -> list[tuple[str, float]]:
    """How much ROC-AUC falls when a feature's values are dealt to other rows; the largest first. One pass over the rows per
    feature: values are paired by row numbers within hash groups, so nothing is gathered in one place."""
    base, out = measure(model, rows)["roc_auc"], []
    group = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(64))
    number = lambda *by: F.row_number().over(Window.partitionBy("_g").orderBy(*by))
    held = rows.withColumn("_g", group).withColumn("_n", number("customer_id")).persist()
    for c in (*NUMERIC, *CATEGORICAL):
        other = held.select("_g", number(F.xxhash64("customer_id", F.lit(c))).alias("_n"), F.col(c).alias("_x"))
        mixed = held.join(other, ["_g", "_n"]).withColumn(c, F.col("_x")).drop("_x")
        out.append((c, base - measure(model, mixed)["roc_auc"]))
    held.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))[:top]


class Registry:
    """Model versions in a folder of any file system that Spark knows, with aliases; no wall clock, no server."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _rows(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("version long, at string, metrics string, alias string").json(f"{self.root}/log")

    def _add(self, version: int, at: datetime, metrics: dict, alias: str) -> None:
        row = [(version, at.isoformat(), json.dumps(metrics), alias)]
        self.spark.createDataFrame(row, "version long, at string, metrics string, alias string").coalesce(1).write.mode("append").json(f"{self.root}/log")

    def champion(self) -> tuple[int, dict] | None:
        rows = self._rows()
        last = rows and rows.where("alias = 'champion'").orderBy(F.desc("version")).first()
        return (last.version, json.loads(last.metrics)) if last else None

    def register(self, model: PipelineModel, metrics: dict[str, float], at: datetime) -> str:
        """Save the model; it becomes the champion only if its ROC-AUC beats the present one's, or else a challenger."""
        rows, best = self._rows(), self.champion()
        version = 1 + (rows.agg(F.max("version")).first()[0] if rows is not None else 0)
        alias = "champion" if best is None or metrics["roc_auc"] > best[1]["roc_auc"] else "challenger"
        model.write().overwrite().save(f"{self.root}/models/{version}")
        self._add(version, at, metrics, alias)
        return alias

    def load(self) -> tuple[int, PipelineModel]:
        best = self.champion()
        if best is None:
            raise LookupError("no champion")
        return best[0], PipelineModel.load(f"{self.root}/models/{best[0]}")


def train(rows: DataFrame, registry: Registry | None, at: datetime, **how) -> tuple[PipelineModel, dict[str, float], str]:
    """Fit on three quarters of the rows (features with churned), measure on the rest, and register."""
    learn, test = split(_typed(rows))
    model = pipeline(**how).fit(learn)
    found = measure(model, test)
    return model, found, registry.register(model, found, at) if registry else ""


def band(p: Column) -> Column:
    """The risk bands."""
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def score(model: PipelineModel, version: int, rows: DataFrame, at: datetime) -> DataFrame:
    """Probability of churn and its band for each customer; a JVM transform, no Python function."""
    p = vector_to_array("probability")[1]
    out = model.transform(_typed(rows)).select("customer_id", "as_of_date", F.col("segment"), F.col("total_spent"), p.alias("churn_probability"))
    return out.withColumns({"risk_band": band(F.col("churn_probability")), "model_version": F.lit(version), "scored_at": F.lit(at).cast("timestamp_ntz")})


def rule_score(of: DataFrame) -> DataFrame:
    """A model-free score for tests and first runs: recency against the span of purchases, between 0 and 1."""
    p = F.round(F.least(F.lit(1.0), F.col("recency_days") / (F.col("active_span_days") + 30.0)), 6)
    return of.select("customer_id", "segment", "total_spent", p.alias("churn_probability")).withColumn("risk_band", band(F.col("churn_probability")))


def distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_band", "segment").agg(F.count("*").alias("customers"), F.round(F.avg("churn_probability"), 4).alias("avg_probability"), total("total_spent", "spent"))


def save_list(scores: DataFrame, segments: DataFrame, k: int = 50) -> DataFrame:
    """The k high-risk customers who spent most, with their RFM segment: a top-k report."""
    high = scores.where("risk_band = 'high'").join(segments.select("customer_id", "rfm_segment"), "customer_id", "left")
    return high.select("customer_id", "segment", "rfm_segment", "churn_probability", "total_spent").orderBy(F.desc("total_spent"), "customer_id").limit(k)


def drift(scores: DataFrame, run_id: str) -> DataFrame:
    """One row of a scoring run, to append to a history."""
    return scores.agg(F.count("*").alias("customers"), F.round(F.avg("churn_probability"), 6).alias("avg_probability"), F.count_if(F.col("risk_band") == "high").alias("high"), F.count_if(F.col("risk_band") == "medium").alias("medium"), F.count_if(F.col("risk_band") == "low").alias("low")).withColumn("run_id", F.lit(run_id))

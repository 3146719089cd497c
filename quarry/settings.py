"""Where things are, and the session that tests, bench and jobs share."""

from __future__ import annotations

import logging
import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Layers, and the tables of each.
LAYERS = {
    "raw": ["orders", "items", "customers", "products", "clicks"],
    "bronze": ["orders", "items", "customers", "products", "clicks"],
    "silver": ["orders", "items", "customers", "customers_history", "products", "clicks"],
    "gold": ["dim_date", "dim_customer", "dim_product", "fact_items", "daily_sales", "rfm", "product_performance", "sessions", "customer_360", "churn_scores"],
    "ops": ["dq_results", "quarantine", "event_log", "access", "score_history"],
    "ml": ["features", "labels", "models"],
}
CONF, ENV, DEFAULT = "spark.quarry.root", "QUARRY_ROOT", "warehouse/dev"


def conf(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    """A setting of the session; a key that is missing is no error on any kind of session."""
    try:
        return spark.conf.get(key)
    except Exception:  # the kind depends on the session
        return default


@dataclass(frozen=True)
class Settings:
    """Paths below a root. Which root: the argument, or else the session's setting, the environment, the default."""

    root: str = DEFAULT

    @staticmethod
    def find(root: str | None = None, spark: SparkSession | None = None) -> Settings:
        return Settings(root or (conf(spark, CONF) if spark else None) or os.environ.get(ENV) or DEFAULT)

    @staticmethod
    def of(environment: str, base: str = "warehouse") -> Settings:
        """dev, test and prod have a root each."""
        if environment not in ("dev", "test", "prod"):
            raise ValueError(environment)
        return Settings(f"{base}/{environment}")

    def table(self, layer: str, name: str) -> str:
        if name not in LAYERS[layer]:
            raise KeyError(f"{layer}.{name}")
        return f"{self.root}/{layer}/{name}"

    def landing(self, dataset: str) -> str:
        return self.table("raw", dataset)

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/_checkpoints/{stream}"

    def read(self, spark: SparkSession, layer: str, name: str) -> DataFrame:
        return spark.read.parquet(self.table(layer, name))


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or on a local master one beside its temporary files."""
    folder = conf(spark, "spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/quarry-{spark.sparkContext.applicationId}"


def session(cores: int | str = 4, partitions: int = 4, memory: str | None = None, **more: str) -> SparkSession:
    """The active session, or a local one in UTC with few shuffle partitions."""
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions)
    for k, v in ({"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"} | ({"spark.driver.memory": memory} if memory else {}) | more).items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("OFF")
    return out


def can(spark: SparkSession, statement: str) -> bool:
    """Whether the session's parser and analyser accept a statement."""
    try:
        spark.sql("EXPLAIN " + statement)
    except Exception:  # whatever the session lacks
        return False
    return True


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def scalar(df: DataFrame):
    """The one value of a result of one row, None if it has none."""
    row = df.first()
    return row[0] if row else None


def logger(name: str) -> logging.Logger:
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        out.addHandler(handler)
        out.setLevel(logging.INFO)
    return out

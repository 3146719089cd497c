"""Row filters and column masks as secured views, tags, lineage and operations reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import mask_email, mask_name


def allowed(rows: DataFrame, access: DataFrame, principals: list[str], column: str = "country") -> DataFrame:
    """Rows whose value of column is granted to one of the principals (a user and its groups); '*' grants all.

    access: principal, value. A semi join, so grants never multiply rows; rows without a value need the wildcard."""
    granted = access.where(F.col("principal").isin(principals)).select("value")
    every = granted.where("value = '*'").limit(1).select(F.lit(True).alias("_all"))
    named = rows.join(granted.select(F.col("value").alias("_granted")).distinct(), F.col(column) == F.col("_granted"), "left_semi")
    return rows.join(F.broadcast(every), F.lit(True), "left_semi").unionByName(named.join(F.broadcast(every), F.lit(True), "left_anti"))


@dataclass
class Policies:
    """Row filters and masks by table, bound and unbound by name; view() applies them for a user and its groups."""

    filters: dict[str, str] = field(default_factory=dict)
    masks: dict[tuple[str, str], str] = field(default_factory=dict)
    tags: dict[tuple[str, str | None], dict[str, str]] = field(default_factory=dict)
    privileged: str = "admins"
    functions = {"mask_email": mask_email, "mask_name": mask_name, "hide": lambda c: F.lit(None).cast("string")}

    def set_filter(self, table: str, column: str) -> None:
        self.filters[table] = column

    def drop_filter(self, table: str) -> None:
        self.filters.pop(table, None)

    def set_mask(self, table: str, column: str, function: str) -> None:
        if function not in self.functions:
            raise KeyError(function)
        self.masks[table, column] = function

    def drop_mask(self, table: str, column: str) -> None:
        self.masks.pop((table, column), None)

    def bound(self, spark: SparkSession) -> DataFrame:
        """What is bound to which table and column."""
        rows = [(t, c, "row_filter", "allowed") for t, c in self.filters.items()] + [(t, c, "mask", f) for (t, c), f in self.masks.items()]
        return spark.createDataFrame(rows, "table_name string, column_name string, kind string, function string")

    def view(self, name: str, rows: DataFrame, access: DataFrame, user: str, groups: list[str]) -> DataFrame:
        if name in self.filters:
            rows = allowed(rows, access, [user, *groups], self.filters[name])
        if self.privileged in groups:
            return rows
        shown = {c: self.functions[f](c) for (t, c), f in self.masks.items() if t == name}
        return rows.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in rows.columns])

    def tag(self, table: str, column: str | None = None, **tags: str) -> None:
        self.tags[table, column] = self.tags.get((table, column), {}) | tags

    def tagged(self, spark: SparkSession) -> DataFrame:
        rows = [(t, c, k, v) for (t, c), kv in self.tags.items() for k, v in kv.items()]
        return spark.createDataFrame(rows, "table_name string, column_name string, tag string, value string")


def undocumented(tables: DataFrame) -> DataFrame:
    """Tables (table_name, comment) without a comment."""
    return tables.where(F.coalesce(F.trim("comment"), F.lit("")) == "").select("table_name")


def lineage_last_seen(events: DataFrame) -> DataFrame:
    """Each edge between tables with its runs and the last of them."""
    both = F.col("source").isNotNull() & F.col("target").isNotNull()
    return events.where(both).groupBy("source", "target").agg(F.count("*").alias("times"), F.max("at").alias("last_seen"))


def cost_per_job(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage at the price that was valid at its time; a price without an end is still valid. An equi join with a range on top."""
    p = prices.select(F.col("sku").alias("_sku"), "price", "valid_from", "valid_to")
    valid = (F.col("sku") == F.col("_sku")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    cost = F.sum(F.col("quantity") * F.col("price")).cast("decimal(28,4)")
    return usage.join(p, valid).groupBy("job", "sku").agg(F.sum("quantity").cast("bigint").alias("units"), cost.alias("cost"))


def job_sla(runs: DataFrame, limit_s: int) -> DataFrame:
    """Runs of each job, the mean and largest seconds, failures, and runs over the limit."""
    s: Column = F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))
    return runs.groupBy("job").agg(
        F.count("*").alias("runs"), F.round(F.avg(s), 2).alias("avg_s"), F.max(s).alias("max_s"), F.count_if(F.col("state") != "success").alias("failed"), F.count_if(s > limit_s).alias("over_limit")
    )


def heavy(statements: DataFrame, k: int = 20) -> DataFrame:
    """The k statements that read most: a top-k report."""
    return statements.orderBy(F.desc("bytes"), "id").limit(k)


def readers(audit: DataFrame, prefix: str) -> DataFrame:
    """Who read tables whose name begins with prefix, and when last."""
    return audit.where(F.col("action").like("read%") & F.startswith("table_name", F.lit(prefix))).groupBy("user", "table_name").agg(F.count("*").alias("reads"), F.max("at").alias("last_read"))

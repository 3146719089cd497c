"""Declared datasets with expectations: a graph by names, run in order of what each reads, with an event log."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The nested part of an event: what DQ reports read back.
DETAILS = "struct<flow_progress: struct<status: string, metrics: struct<num_output_rows: bigint>, data_quality: struct<dropped_records: bigint, expectations: array<struct<name: string, dataset: string, passed_records: bigint, failed_records: bigint>>>>>"


@dataclass
class Dataset:
    name: str
    make: Callable[[Callable[[str], DataFrame]], DataFrame]
    reads: tuple[str, ...]
    expect: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    fail: dict[str, str] = field(default_factory=dict)
    view: bool = False


@dataclass
class Flows:
    """Datasets written below a root, each by a function of read(name). Tables are written; views are only read through.

    Expectations are SQL predicates; FALSE and NULL break them. expect counts, drop also leaves rows out, fail stops the run. They are
    counted while the rows are written, in the same pass."""

    spark: SparkSession
    root: str
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def dataset(self, name: str, reads: tuple[str, ...] = (), *, view: bool = False, **rules: dict[str, str]) -> Callable:
        def declare(make: Callable) -> Callable:
            if name in self.datasets:
                raise ValueError(f"{name} is declared twice")
            self.datasets[name] = Dataset(name, make, reads, view=view, **rules)
            return make

        return declare

    def order(self) -> list[str]:
        """Names so that each comes after those that it reads; the order of declaration plays no part."""
        out: list[str] = []
        while len(out) < len(self.datasets):
            ready = sorted(n for n, d in self.datasets.items() if n not in out and all(r in out or r not in self.datasets for r in d.reads))
            if not ready:
                raise ValueError("datasets read each other in a circle")
            out += ready
        return out

    def run(self, sources: dict[str, DataFrame], at: datetime) -> list[dict]:
        """Write every table; the events of the run, also appended to the event log."""
        made, events = dict(sources), []
        for name in self.order():
            d = self.datasets[name]
            missing = [r for r in d.reads if r not in made]
            if missing:
                raise KeyError(f"{name} reads {missing}")
            rows = d.make(made.__getitem__)
            if d.view:
                made[name] = rows
                continue
            try:
                rows, counts = self._checked(d, rows)
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
            except Exception as e:
                events.append(self._event(at, name, "FAILED", "ERROR", str(e).splitlines()[0], {}, d))
                self._log(events)
                raise
            events.append(self._event(at, name, "COMPLETED", "INFO", f"wrote {name}", counts.get, d))
            made[name] = self.spark.read.parquet(f"{self.root}/{name}")
        self._log(events)
        return events

    def _checked(self, d: Dataset, rows: DataFrame) -> tuple[DataFrame, Observation]:
        holds = lambda p: F.coalesce(F.expr(p), F.lit(False))
        every, counts = d.expect | d.drop | d.fail, Observation()
        keep = F.lit(True)
        for p in d.drop.values():
            keep = keep & holds(p)
        kept = F.count_if(keep).alias("_kept")
        rows = rows.observe(counts, F.count(F.lit(1)).alias("_all"), kept, *[F.count_if(holds(p)).alias(n) for n, p in every.items()])
        for n, p in d.fail.items():
            rows = rows.where(F.when(holds(p), F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation {n} failed: {p}")).cast("boolean")))
        return rows.where(keep), counts

    @staticmethod
    def _event(at: datetime, name: str, status: str, level: str, message: str, got: dict, d: Dataset) -> dict:
        every, total = d.expect | d.drop | d.fail, got.get("_all", 0)
        expectations = [{"name": n, "dataset": name, "passed_records": got.get(n, 0), "failed_records": total - got.get(n, 0)} for n in every]
        progress = {"status": status, "metrics": {"num_output_rows": got.get("_kept", 0)}, "data_quality": {"dropped_records": total - got.get("_kept", 0), "expectations": expectations}}
        return {"at": at, "event_type": "flow_progress", "level": level, "dataset": name, "message": message, "details": json.dumps({"flow_progress": progress})}

    def _log(self, events: list[dict]) -> None:
        schema = "at timestamp_ntz, event_type string, level string, dataset string, message string, details string"
        self.spark.createDataFrame([tuple(e.values()) for e in events], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_events")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_events")


def expectation_metrics(events: DataFrame) -> DataFrame:
    """Passed and failed records of each expectation, from the JSON of an event log."""
    one = events.where("event_type = 'flow_progress' AND details IS NOT NULL").select("at", F.from_json("details", DETAILS).alias("d"))
    each = one.select("at", F.explode("d.flow_progress.data_quality.expectations").alias("e"))
    failed, passed = F.sum("e.failed_records"), F.sum("e.passed_records")
    rate = F.round(F.try_divide(failed.cast("double"), failed + passed), 6)
    return each.groupBy(F.col("e.dataset").alias("dataset"), F.col("e.name").alias("expectation")).agg(passed.alias("passed"), failed.alias("failed"), rate.alias("failure_rate"))


def flow_progress(events: DataFrame) -> DataFrame:
    """Rows written and dropped by each flow, by paths into the JSON."""
    at = lambda p: F.get_json_object("details", "$.flow_progress." + p).cast("bigint")
    return events.where("event_type = 'flow_progress'").groupBy("dataset").agg(F.sum(at("metrics.num_output_rows")).alias("rows_written"), F.sum(at("data_quality.dropped_records")).alias("rows_dropped"), F.max("at").alias("last_at"))


def troubles(events: DataFrame) -> DataFrame:
    """Warnings and errors, the newest first."""
    return events.where("level IN ('WARN', 'ERROR')").select("at", "level", "dataset", "message").orderBy(F.desc("at"))

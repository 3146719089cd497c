"""Incremental ingest of landing folders: new files only, schemas that grow, values that don't fit kept beside."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StringType, StructType

from quarry.sources.files import Files

RESCUED, STAMPS = "_rescued_data", ["_source_file", "_source_time", "_ingested_at", "_batch_id"]


def grown(known: StructType | None, found: StructType) -> StructType:
    """known with the fields of found that it lacks; the types of known fields stay."""
    out = StructType([*(known.fields if known else [])])
    for f in found.fields:
        if f.name not in out.names:
            out.add(f.name, f.dataType, True)
    return out


def parsed(lines: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """JSON lines as the columns of schema, and _rescued_data: a JSON object of the values that have no column or don't fit its
    type, the line itself if it is no object, null if all fits. Other columns of lines stay."""
    rest = [c for c in lines.columns if c != value]
    raw = F.from_json(value, "map<string,string>")
    both = lines.select(*rest, F.col(value).alias("_line"), F.from_json(value, schema).alias("_row"), raw.alias("_raw"))
    misfit = F.array(*[F.when(F.col("_row")[f.name].isNull() & F.try_element_at("_raw", F.lit(f.name)).isNotNull(), F.lit(f.name)) for f in schema.fields])
    odd = F.map_filter("_raw", lambda k, v: v.isNotNull() & (~k.isin(schema.names) | F.array_contains(F.array_compact(misfit), k)))
    # a line that is cut off has no map, or an empty one
    broken = F.col("_raw").isNull() | ((F.size("_raw") == 0) & ~F.rlike(F.col("_line"), F.lit(r"^\s*\{\s*\}\s*$")))
    rescued = F.when(broken, F.col("_line")).when(F.size(odd) > 0, F.to_json(odd))
    return both.select(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields], rescued.alias(RESCUED), *rest)


class Feed:
    """A landing folder that is read into a Parquet table.

    Each micro-batch is a folder of its own, named by the batch, that a retry replaces; so a restart neither loses nor doubles a
    file. The schema is kept beside the data; grow: new JSON fields become columns, or else they are rescued. CSV columns are
    strings. files: at most so many in a micro-batch, which bounds the list of paths on the driver."""

    def __init__(self, spark: SparkSession, landing: str, table: str, kind: str = "json", *, grow: bool = True, files: int = 50, now: Column | None = None) -> None:
        self.spark, self.landing, self.table, self.kind, self.grow, self.files = spark, landing, table, kind, grow, files
        self.now = now if now is not None else F.current_timestamp()
        self.store = Files(spark, table)

    def schema(self) -> StructType | None:
        return StructType.fromJson(json.loads(self.store.read("schema.json"))) if self.store.exists("schema.json") else None

    def _schema_for(self, paths: list[str]) -> StructType:
        known = self.schema()
        if known is not None and not self.grow:
            return known
        if self.kind == "csv":
            found = StructType()
            for p in paths:  # each file has its own header
                for name in self.spark.read.option("header", True).csv(p).columns:
                    if name not in found.names:
                        found.add(name, StringType())
        else:
            found = self.spark.read.json(paths).schema
            found = StructType([f for f in found.fields if f.name != "_corrupt_record"])
        out = grown(known, found)
        if known is None or out != known:
            self.store.write("schema.json", out.json())
        return out

    def _stamped(self, df: DataFrame, batch: int) -> DataFrame:
        return df.withColumns({"_source_file": F.col("_metadata.file_path"), "_source_time": F.col("_metadata.file_modification_time"), "_ingested_at": self.now, "_batch_id": F.lit(batch).cast("long")})

    def _batch(self, rows: DataFrame, batch: int) -> None:
        paths = [r[0] for r in rows.select("path").distinct().orderBy("path").collect()]
        if not paths:
            return
        schema = self._schema_for(paths)
        if self.kind == "csv":
            out = None
            for names, group in self._by_header(paths).items():
                one = self._stamped(self.spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(group), batch)
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
            out = out.withColumns({f.name: F.lit(None).cast("string") for f in schema.fields if f.name not in out.columns})
            extra = [c for c in out.columns if c not in (*schema.names, *STAMPS)]
            rescued = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
            out = out.withColumn(RESCUED, F.nullif(rescued, F.lit("{}"))).select(*schema.names, RESCUED, *STAMPS)
        else:
            out = parsed(self._stamped(self.spark.read.text(paths), batch), schema)
        out.write.mode("overwrite").parquet(f"{self.table}/data/batch={batch}")

    def _by_header(self, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
        out: dict[tuple[str, ...], list[str]] = {}
        for p in paths:
            out.setdefault(tuple(self.spark.read.option("header", True).csv(p).columns), []).append(p)
        return out

    def run(self) -> int:
        """Read all files that are new, then stop. Rows of the table."""
        files = self.spark.readStream.option("maxFilesPerTrigger", self.files).text(self.landing).select(F.col("_metadata.file_path").alias("path")).distinct()
        query = files.writeStream.outputMode("update").foreachBatch(lambda df, k: self._batch(df, k)).option("checkpointLocation", f"{self.table}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.read().count()

    def read(self) -> DataFrame:
        """The table with all columns that any batch has."""
        schema = StructType([*(self.schema() or StructType()).fields])
        for c, kind in ((RESCUED, "string"), ("_source_file", "string"), ("_source_time", "timestamp"), ("_ingested_at", "timestamp"), ("_batch_id", "long")):
            schema.add(c, kind)
        if not self.store.names("data"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.table}/data").drop("batch")


def stream(spark: SparkSession, folder: str, schema: str | StructType, kind: str = "json", files: int = 20) -> DataFrame:
    """A stream of the files of a folder: json, csv or parquet."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("header", True)
    return getattr(reader, kind)(folder)


def to_table(df: DataFrame, folder: str, checkpoint: str, *, partition_by: list[str] = (), name: str | None = None, available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Start a stream that appends to a Parquet folder."""
    out = df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    out = out.partitionBy(*partition_by) if partition_by else out
    out = out.queryName(name) if name else out
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def query_path(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A folder as a table: SELECT * FROM json.`path`."""
    return spark.sql(f"SELECT * FROM {kind}.`{path}`")

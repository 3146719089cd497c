"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without that setting only a local master, whose
    executors run beside the driver, has one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/quarry-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release() -> None:
    """Hand the memory that a Python worker no longer uses back to the system: workers live on between tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean() -> None:
    """Arrays of 4 MB and more are memory of their own, given back at once: malloc else learns to keep those of up to 32 MB in one heap, with
    what is freed between them. For tasks that hold some dozens of such arrays."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over the frames of a partition, after which its memory is given back."""

    @functools.wraps(run)
    def wrapped(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            release()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """run over the frame, or the two frames, of a group, after which its memory is given back. Spark asks for the number of arguments."""

    def both(*frames):
        try:
            return run(*frames)
        finally:
            release()

    return (lambda one, two: both(one, two)) if run.__code__.co_argcount == 2 else (lambda one: both(one))


def remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shelf:
    """Tables of one run in the shared folder: compressed columns in place of checkpoints, each put away once it is used up."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"
        self.held = 0
        self.sent: list = []

    def share(self, value: object):
        """Broadcast a value of bounded size until unshare."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def unshare(self) -> None:
        for x in self.sent:
            x.destroy()
        self.sent.clear()

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and read it again; lineage ends there."""
        self.held += 1
        path = f"{self.folder}/{self.held}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.place = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no unfinished result reads."""
        for t in tables:
            remove(self.spark, t.place)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of plans that are done with; it does so once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty ones."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def bucket(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key that is never null and stands for one text: doc_id, but a new number above all ids for a row whose id
    is null or has several texts; whether there are such rows. They share a key where id and text are the same."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    odd = cut(docs.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("doc_id IS NULL OR a <> b").select(F.col("doc_id").alias("odd")))
    if odd.isEmpty():
        return docs.withColumn("key", F.col("doc_id")), False
    top, same = docs.agg(F.max("doc_id")).first()[0] or 0, F.col("doc_id").eqNullSafe(F.col("odd"))
    of = cut(docs.join(odd, same, "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).distinct().select("doc_id", F.sha2("_t", 256).alias("_h"), (F.monotonically_increasing_id() + F.lit(top + 1)).alias("key")))
    new = docs.join(odd, same, "left_semi").withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("d").join(of.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d._h") == F.col("o._h"))).select(*[F.col("d." + c) for c in docs.columns], F.col("o.key"))
    return docs.join(odd, same, "left_anti").withColumn("key", F.col("doc_id")).unionByName(new), True

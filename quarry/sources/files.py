"""Small files on any file system that Spark knows, and writers for landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Files:
    """What the log of a table and the schema of a feed need of a file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, *, replace: bool = True) -> None:
        """Whole or not at all: written beside its place, then renamed. Without replace a file that exists is an error, so of two
        writers of one name the second fails."""
        part = f"{name}.part-{self.jvm.java.util.UUID.randomUUID()}"
        stream = self.fs.create(self.path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            self.fs.delete(self.path(name), False)
        if self.exists(name) or not self.fs.rename(self.path(part), self.path(name)):
            self.fs.delete(self.path(part), False)
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> tuple[int, int]:
        """Bytes and Parquet files below a folder."""
        found, todo = [], [self.path(name)]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append(s.getLen())
        return sum(found), len(found)


def write_json(df: DataFrame, folder: str, rows: int = 0, mode: str = "append") -> None:
    """JSON lines; rows: of a file at most."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).json(folder)


def write_csv(df: DataFrame, folder: str, rows: int = 0, mode: str = "append") -> None:
    """CSV with a header in each file."""
    df.write.mode(mode).option("header", True).option("maxRecordsPerFile", rows).csv(folder)


def append_merged(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Append to a Parquet folder whatever columns are new or missing; the whole is read with all columns."""
    df.write.mode("append").parquet(folder)
    return spark.read.option("mergeSchema", True).parquet(folder)

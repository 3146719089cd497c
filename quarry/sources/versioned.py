"""Tables with versions: Parquet folders that never change, and a log of which of them make up each version."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import merge as merging
from quarry.sources.files import Files


class VersionedTable:
    """A table in a folder. A commit writes new data folders, then one log entry, which fails if another writer took its number.

    An entry has the version, operation, time, data folders, schema, logical to physical names of renamed columns, constraints,
    clustering, comment and properties, and the rows written. Readers take an entry and never see a part of a commit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    # the log

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("log") if n.endswith(".json")]

    def entry(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"no version {version} of {self.root}")
        return json.loads(self.files.read(f"log/{known[-1] if version is None else version:08d}.json"))

    def _commit(self, operation: str, at: datetime, **changes) -> int:
        known = self.versions()
        old = self.entry() if known else {"folders": [], "names": {}, "constraints": {}, "cluster_by": [], "comment": None, "properties": {}, "schema": None, "rows_written": 0}
        new = old | {"rows_written": 0} | changes | {"version": known[-1] + 1 if known else 0, "operation": operation, "at": at.isoformat(sep=" ")}
        self.files.write(f"log/{new['version']:08d}.json", json.dumps(new), replace=False)
        return new["version"]

    def history(self) -> DataFrame:
        """A row per version."""
        rows = [(e["version"], datetime.fromisoformat(e["at"]), e["operation"], e["rows_written"], len(e["folders"])) for e in map(self.entry, self.versions())]
        return self.spark.createDataFrame(rows, "version long, at timestamp_ntz, operation string, rows_written long, folders int")

    def detail(self) -> DataFrame:
        e = self.entry()
        sizes = [Files(self.spark, f).size("") for f in e["folders"]]
        row = (self.root, e["version"], sum(n for _, n in sizes), sum(b for b, _ in sizes), e["cluster_by"], e["comment"], e["properties"], sorted(e["constraints"]))
        return self.spark.createDataFrame([row], "root string, version long, files long, bytes long, cluster_by array<string>, comment string, properties map<string,string>, constraints array<string>")

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        e = self.entry(version)
        schema = StructType.fromJson(json.loads(e["schema"]))
        held = StructType([*schema.fields])
        stored = StructType()
        for f in held.fields:
            stored.add(e["names"].get(f.name, f.name), f.dataType, True)
        rows = self.spark.read.schema(stored).parquet(*e["folders"]) if e["folders"] else self.spark.createDataFrame([], stored)
        return rows.select(*[F.col(f"`{e['names'].get(f.name, f.name)}`").alias(f.name, metadata=f.metadata) for f in held.fields])

    def changes(self, key: str, since: int, to: int | None = None) -> DataFrame:
        """Rows inserted, deleted and updated (before and after) by each version after since, with its number."""
        out, last = None, self.versions()[-1] if to is None else to
        for v in [v for v in self.versions() if since < v <= last]:
            cols = [c for c in self.read(v).columns if c != key]
            old = self.read(v - 1)
            old = old.withColumns({c: F.lit(None).cast(kind) for c, kind in self.read(v).dtypes if c not in old.columns})
            one = merging.changes(old, self.read(v), key, cols).withColumn("commit_version", F.lit(v).cast("long"))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    # writing

    def _put(self, df: DataFrame, names: dict[str, str], cluster_by: list[str], constraints: dict[str, str]) -> tuple[str, int]:
        for name, predicate in constraints.items():
            wrong = F.raise_error(F.lit(f"constraint {name} is violated: {predicate}")).cast("boolean")
            df = df.where(F.when(F.coalesce(F.expr(predicate), F.lit(False)), F.lit(True)).otherwise(wrong))
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        count, folder = Observation(), f"{self.root}/data/{uuid.uuid4().hex}"
        df = df.observe(count, F.count(F.lit(1)).alias("rows"))
        df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]).write.parquet(folder)
        return folder, count.get["rows"]

    def overwrite(self, df: DataFrame, at: datetime, operation: str = "overwrite") -> int:
        """Replace rows and schema."""
        e = self.entry() if self.versions() else {"cluster_by": [], "constraints": {}}
        kept = {n: p for n, p in e["constraints"].items()}
        folder, rows = self._put(df, {}, [c for c in e["cluster_by"] if c in df.columns], kept)
        return self._commit(operation, at, folders=[folder], schema=df.schema.json(), names={}, rows_written=rows)

    def append(self, df: DataFrame, at: datetime) -> int:
        """Add rows; columns that the table lacks are added, those that df lacks are null."""
        e = self.entry()
        schema = StructType.fromJson(json.loads(e["schema"]))
        for f in df.schema.fields:
            if f.name not in schema.names:
                schema.add(f.name, f.dataType, True)
        folder, rows = self._put(df, e["names"], e["cluster_by"], e["constraints"])
        return self._commit("append", at, folders=[*e["folders"], folder], schema=schema.json(), rows_written=rows)

    def merge(self, source: DataFrame, keys: list[str], at: datetime, clauses: list[merging.Clause] = merging.UPSERT) -> int:
        return self.overwrite(merging.merge(self.read(), source, keys, clauses), at, "merge")

    def restore(self, version: int, at: datetime) -> int:
        """The rows of an earlier version as a new one; data are not copied."""
        e = self.entry(version)
        return self._commit("restore", at, **{k: e[k] for k in ("folders", "schema", "names", "cluster_by")})

    def clone(self, root: str, at: datetime, version: int | None = None) -> VersionedTable:
        """A table of its own on the same data folders; writes to either don't show in the other."""
        e, other = self.entry(version), VersionedTable(self.spark, root)
        other._commit("clone", at, **{k: e[k] for k in ("folders", "schema", "names", "constraints", "cluster_by", "comment", "properties")})
        return other

    def compact(self, at: datetime, files: int = 1) -> int:
        """The same rows in fewer files, sorted by the clustering columns; earlier versions keep theirs."""
        e, rows = self.entry(), self.read()
        rows = rows if e["cluster_by"] else rows.repartition(files)
        folder, n = self._put(rows, e["names"], e["cluster_by"], {})
        return self._commit("compact", at, folders=[folder], rows_written=n)

    def vacuum(self, before: datetime, *, dry_run: bool = True) -> list[str]:
        """Data folders that only versions older than before read, but for the latest; deleted without dry_run, with the log
        entries that read them. Folders of other tables, which a clone reads, are left alone."""
        entries = [self.entry(v) for v in self.versions()]
        kept = {f for e in entries if datetime.fromisoformat(e["at"]) >= before or e is entries[-1] for f in e["folders"]}
        old = sorted({f for e in entries for f in e["folders"] if f.startswith(f"{self.root}/data/")} - kept)
        if not dry_run:
            for e in entries[:-1]:
                if {*e["folders"]} & {*old}:
                    self.files.delete(f"log/{e['version']:08d}.json")
            for f in old:
                self.files.delete(f.removeprefix(f"{self.root}/"))
        return old

    # the table's definition

    def rename(self, old: str, new: str, at: datetime) -> int:
        """A column's name; data stay as they are."""
        e = self.entry()
        fields = json.loads(e["schema"])
        if new in [f["name"] for f in fields["fields"]] or old not in [f["name"] for f in fields["fields"]]:
            raise ValueError(f"can't rename {old} to {new}")
        for f in fields["fields"]:
            f["name"] = new if f["name"] == old else f["name"]
        names = {k: v for k, v in e["names"].items() if k != old} | {new: e["names"].get(old, old)}
        return self._commit("rename", at, schema=json.dumps(fields), names=names)

    def constrain(self, name: str, predicate: str, at: datetime) -> int:
        """A predicate that every row must meet, now and in later writes; one that exists under the name and says the same is no error."""
        e = self.entry()
        if e["constraints"].get(name) == predicate:
            return e["version"]
        bad = self.read().where(~F.coalesce(F.expr(predicate), F.lit(False))).limit(1).count()
        if bad or name in e["constraints"]:
            raise ValueError(f"constraint {name}: " + ("rows violate it" if bad else "the name is taken"))
        return self._commit("constrain", at, constraints=e["constraints"] | {name: predicate})

    def cluster(self, columns: list[str], at: datetime) -> int:
        """Columns by which later writes and compact lay rows out."""
        return self._commit("cluster", at, cluster_by=columns)

    def describe(self, at: datetime, comment: str | None = None, columns: dict[str, str] = {}, properties: dict[str, str] = {}) -> int:  # noqa: B006
        e = self.entry()
        fields = json.loads(e["schema"])
        for f in fields["fields"]:
            if f["name"] in columns:
                f["metadata"] = f["metadata"] | {"comment": columns[f["name"]]}
        return self._commit("describe", at, comment=comment or e["comment"], properties=e["properties"] | properties, schema=json.dumps(fields))

    def drop(self) -> None:
        self.files.delete("")

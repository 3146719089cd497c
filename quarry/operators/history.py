"""History of slowly changing rows: rebuilt from a feed, or merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import row_hash
from quarry.operators.cleaning import keep_latest


def scd1(feed: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The latest row per key by sequence; all other columns break ties."""
    rest = [c for c in sorted(feed.columns) if c not in (*keys, *seq)]
    return keep_latest(feed, keys, [F.desc_nulls_last(c) for c in (*seq, *rest)])


def scd2(feed: DataFrame, key: str, seq: list[str], tracked: list[str], except_: list[str] = ()) -> DataFrame:
    """Versions per key from a change feed in any order: valid_from, valid_to (null while open), is_current.

    Rows that change no tracked column are left out, and of rows of equal key and sequence one stays. except_ columns are not
    kept. Running it again over the same feed, or one with rows repeated, gives the same history."""
    rest = [c for c in sorted(feed.columns) if c not in (key, *seq)]
    once = keep_latest(feed, [key, *seq], [F.desc_nulls_last(c) for c in rest]) if rest else feed.distinct()
    w = Window.partitionBy(key).orderBy(*seq)
    seen = once.withColumn("_h", row_hash(tracked)).withColumn("_before", F.lag("_h").over(w))
    points = seen.where(F.col("_before").isNull() | (F.col("_before") != F.col("_h"))).drop("_before", "_h", *except_)
    out = points.withColumn("valid_to", F.lead(seq[0]).over(w)).withColumnRenamed(seq[0], "valid_from")
    return out.withColumn("is_current", F.col("valid_to").isNull())


def merge_scd2(history: DataFrame, batch: DataFrame, key: str, seq: str, tracked: list[str]) -> DataFrame:
    """history after a batch with any number of rows per key, of which the latest counts.

    A key with an open version: where the incoming hash differs and its sequence is later, that version is closed at the new one's
    start; otherwise nothing changes, so a late or repeated batch has no effect. Other keys get an open version. One shuffle by key;
    closed versions are not joined."""
    cols = [c for c in history.columns if c not in ("valid_from", "valid_to", "is_current")]
    new = scd1(batch, [key], [seq]).where(F.col(key).isNotNull())
    new = new.select(*[F.col(c) for c in cols], F.col(seq).alias("valid_from"), F.lit(None).cast(dict(history.dtypes)["valid_to"]).alias("valid_to"), F.lit(True).alias("is_current"))
    names, whole = history.columns, lambda df, name: df.select(F.col(key).alias("k" + name), row_hash(tracked).alias("h" + name), F.struct(*df.columns).alias(name))
    open_ = whole(history.where("is_current"), "o")
    both = open_.join(whole(new.select(names), "n"), F.col("ko") == F.col("kn"), "full_outer")
    changed = F.col("ko").isNotNull() & F.col("kn").isNotNull() & (F.col("ho") != F.col("hn")) & (F.col("n.valid_from") > F.col("o.valid_from"))
    closed = F.struct(*[F.col("n.valid_from").alias(c) if c == "valid_to" else F.lit(False).alias(c) if c == "is_current" else F.col("o." + c).alias(c) for c in names])
    rows = F.when(F.col("ko").isNull(), F.array("n")).when(changed, F.array(closed, F.col("n"))).otherwise(F.array("o"))
    return history.where("NOT is_current").unionByName(both.select(F.inline(rows)))


def current(history: DataFrame) -> DataFrame:
    """The open versions; valid_from stays."""
    return history.where("is_current").drop("valid_to", "is_current")


def not_one_current(history: DataFrame, key: str) -> DataFrame:
    """Keys that break the invariant of exactly one open version; empty when all is well."""
    return history.groupBy(key).agg(F.count_if("is_current").alias("open_versions")).where("open_versions <> 1")


def audit(history: DataFrame, key: str) -> DataFrame:
    """Keys with several versions: how many, the first and last change, and open versions."""
    return history.groupBy(key).agg(F.count("*").alias("versions"), F.min("valid_from").alias("first_change"), F.max("valid_from").alias("last_change"), F.count_if("is_current").alias("open_versions")).where("versions > 1")

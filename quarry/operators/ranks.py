"""Global ranks without one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, of the sample that ranges are cut from, and most ranges. They affect balance, not results.
ROWS, SAMPLE, RANGES = 250_000, 4096, 256


def ranked(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank", total: int | None = None) -> DataFrame:
    """df with the number, from 0, of each row in the order of the columns (name, descending), which should be total.

    Rows are dealt to ranges of the order, cut at fixed values of a bounded sample; a range's rows are numbered in their own
    task, and the sizes of the ranges before it, which the driver sums, are added. Null counts as the least value. total: the
    rows of df if known. df is read again for each of these, so it should be at hand."""
    keys = [c for c, _ in order]
    total = df.count() if total is None else total
    ranges = min(RANGES, 1 + total // ROWS)
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    if ranges == 1:  # no more than ROWS
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).cast("bigint") - 1)
    rows = df.select(*keys).sample(min(1.0, 4.0 * SAMPLE / max(1, total)), seed=7).limit(SAMPLE).collect()

    def before(a: Column, b: Column, down: bool) -> Column:
        x, y = (b, a) if down else (a, b)
        return (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))

    schema = {f.name: f.dataType for f in df.schema}
    sorted_ = rows
    for c, down in reversed(order):
        sorted_ = sorted(sorted_, key=lambda r, c=c: (r[c] is not None, r[c] if r[c] is not None else 0), reverse=down)
    cuts = [sorted_[k * len(sorted_) // ranges] for k in range(1, ranges)] if sorted_ else []
    part = F.lit(0)
    for r in dict.fromkeys(cuts):
        less, same = F.lit(False), F.lit(True)
        for c, down in order:
            v = F.lit(r[c]).cast(schema[c])
            less = less | (same & before(F.col(c), v, down))
            same = same & F.col(c).eqNullSafe(v)
        part = part + F.when(less, 0).otherwise(1)
    dealt = df.withColumn("_part", part)
    sizes = {r._part: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for k in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(k, 0)
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("_part") + 1)
    return dealt.withColumn(name, number + start).drop("_part")


def tiles(df: DataFrame, order: list[tuple[str, bool]], k: int, name: str, total: int | None = None) -> DataFrame:
    """df with the tile from 1 to k of each row in the order: as ntile(k) gives, the first tiles one larger."""
    n = df.count() if total is None else total
    size, rest = divmod(n, k)
    big = rest * (size + 1)
    r = F.col("_rank")
    tile = F.when(r < big, F.floor(r / (size + 1))).otherwise(rest + F.floor((r - big) / max(1, size)))
    return ranked(df, order, "_rank", n).withColumn(name, (tile + 1).cast("int")).drop("_rank")

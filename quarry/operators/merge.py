"""MERGE of a source into a target as one full outer join, and the change feed between two versions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    """What becomes of a row: matched, not_matched or not_matched_by_source; update, insert or delete; if (SQL over s and t, the
    source and target rows) holds. set: column -> SQL over s and t; without it all columns of s."""

    when: Literal["matched", "not_matched", "not_matched_by_source"]
    do: Literal["update", "insert", "delete"]
    if_: str = "true"
    set: dict[str, str] = field(default_factory=dict)


UPSERT = [Clause("matched", "update"), Clause("not_matched", "insert")]
INSERT_ONLY = [Clause("not_matched", "insert")]


def merge(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[Clause] = UPSERT) -> DataFrame:
    """The target's rows after the merge, in its columns. Of the clauses of a row's kind the first whose condition holds decides;
    without one a target row stays and a source row is left out. A null key matches nothing, so such a source row is not matched.

    Several source rows for the key of a target row are an error when there is a clause for matched rows; it is raised while the
    result is computed. Target and source are shuffled by key once for either side of the join."""
    kinds = dict(target.dtypes)
    whole = source.select(F.struct(*[source[c] for c in source.columns]).alias("s"), *[source[k].alias(f"_s{i}") for i, k in enumerate(keys)])
    here = target.select(F.struct(*[target[c] for c in target.columns]).alias("t"), *[target[k].alias(f"_t{i}") for i, k in enumerate(keys)])
    on = [F.col(f"_t{i}") == F.col(f"_s{i}") for i in range(len(keys))]
    by = [F.col(f"_s{i}") for i in range(len(keys))]

    def row(c: Clause):
        old = lambda x: F.col("t." + x) if c.do == "update" else F.lit(None)
        new = lambda x: F.col("s." + x) if not c.set and x in source.columns else old(x)
        return F.struct(*[(F.expr(c.set[x]) if x in c.set else new(x)).cast(kinds[x]).alias(x) for x in target.columns])

    def decided(rows: DataFrame, when: str, otherwise, once: bool = False) -> DataFrame:
        # the error names the target's key, so that Spark can't move it below the join, to source rows that match nothing
        named = F.concat_ws(", ", *[F.col(f"_t{i}").cast("string") for i in range(len(keys))]) if once else F.lit("")
        twice, empty = F.raise_error(F.concat(F.lit("a target row matches several source rows: "), named)), F.lit(None)
        out = F.when(F.col("times") > 1, twice) if once else F.when(F.lit(False), otherwise)
        for c in clauses:
            if c.when == when:
                out = out.when(F.coalesce(F.expr(c.if_), F.lit(False)), empty if c.do == "delete" else row(c))
        return rows.select(out.otherwise(otherwise).alias("r")).where("r IS NOT NULL").select("r.*")

    one = whole.groupBy(*by).agg(F.first("s").alias("s"), F.count("*").alias("times"))
    for k in by:
        one = one.where(k.isNotNull())
    both = here.join(one, on, "left")
    strict = any(c.when == "matched" for c in clauses)
    kept = F.col("t")
    matched = decided(both.where("times IS NOT NULL"), "matched", kept, strict)
    alone = decided(both.where("times IS NULL"), "not_matched_by_source", kept)
    fresh = whole.join(here, on, "left_anti")
    added = decided(fresh, "not_matched", F.lit(None))
    return matched.unionByName(alone).unionByName(added)


def changes(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Change feed between two versions: insert, delete, update_preimage, update_postimage."""
    a = old.select(F.col(key).alias("ka"), F.struct(*cols).alias("a"))
    b = new.select(F.col(key).alias("kb"), F.struct(*cols).alias("b"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    row = lambda kind, c: F.struct(F.lit(kind).alias("change"), F.col(c).alias("v"))
    kinds = F.when(F.col("ka").isNull(), F.array(row("insert", "b"))).when(F.col("kb").isNull(), F.array(row("delete", "a"))).otherwise(F.array(row("update_preimage", "a"), row("update_postimage", "b")))
    return both.select(F.coalesce("ka", "kb").alias(key), F.inline(kinds)).select(key, "change", "v.*")

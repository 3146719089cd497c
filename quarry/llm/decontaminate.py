"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import frugal, table, texts

Q, ERRORS = 8, 0.1
#: Bytes of benchmark text that a task holds at once; a larger benchmark is searched in blocks of this size.
BLOCK = 8 << 20
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def normal(text: str) -> bytes:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split()).encode()


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """The q bytes from each position as one number."""
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw + b"\0" * 8, np.uint64, 1), (max(0, len(raw) - q + 1),), (1,))
    return eight if q == Q else eight & np.uint64((1 << 8 * q) - 1)


def distance(item: bytes, region: bytes, budget: int) -> int:
    """Least edits between item and any part of region that starts within 2 * budget of its begin; over budget: budget + 1."""
    width = 4 * budget + 1
    a, cols = np.frombuffer(item, np.uint8), np.arange(width)
    b = np.concatenate([np.frombuffer(region, np.uint8).astype(np.int16), np.full(len(item) + width + 1, -1, np.int16)])
    row = np.zeros(width + 1, np.int64)
    row[-1] = budget + 1
    for i in range(a.size):  # cell j of row i ends at region[i + j]
        best = np.minimum(row[:-1] + (b[i : i + width] != a[i]), row[1:] + 1)
        row[:-1] = np.minimum.accumulate(best - cols) + cols
        if row.min() > budget:
            return budget + 1
    return int(min(row[:-1].min(), budget + 1))


class Index:
    """Grams of Q bytes; fewer for an item of which the budget of edits could break each of those."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = [(i, t) for i, t in items if t]
        self.budgets = [int(ERRORS * len(t)) for _, t in self.items]
        size = [min(Q, len(t) // (k + 1)) if len(t) >= Q else Q for (_, t), k in zip(self.items, self.budgets, strict=True)]
        self.need = np.array([max(1, len(t) - q + 1 - k * q) for (_, t), k, q in zip(self.items, self.budgets, size, strict=True)])
        self.wide = np.array(self.budgets, int) + 1
        self.short = [k for k, (_, t) in enumerate(self.items) if len(t) < Q]
        self.tables = []
        for q in sorted({*size}, reverse=True):
            codes = [(k, grams(t, q)) for k, (_, t) in enumerate(self.items) if size[k] == q]
            code = np.concatenate([*(c for _, c in codes), np.zeros(0, np.uint64)])
            order = np.argsort(code, kind="stable")
            item, at = np.repeat([k for k, _ in codes], [c.size for _, c in codes])[order], np.concatenate([*(np.arange(c.size) for _, c in codes), np.zeros(0, int)])[order]
            seen = np.zeros(1 << _BITS, bool)
            seen[(code * _MIX) >> np.uint64(64 - _BITS)] = True
            self.tables.append((q, code[order], item, at, seen))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, first byte of the region in the normalised text), the best region of each item found."""
        raw = normal(text)
        found: dict[int, tuple[int, int]] = {k: (0, p) for k in self.short if (p := raw.find(self.items[k][1])) >= 0}
        for q, known, items, places, seen in self.tables:
            code = grams(raw, q)
            pos = np.flatnonzero(seen[(code * _MIX) >> np.uint64(64 - _BITS)]) if code.size and known.size else np.zeros(0, int)
            if not pos.size:
                continue
            lo, hi = np.searchsorted(known, code[pos], "left"), np.searchsorted(known, code[pos], "right")
            n = hi - lo
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, diagonal = items[rows], np.repeat(pos, n) - places[rows]
            # an item with too few grams in the whole text has too few in any band
            some = np.bincount(item, minlength=self.need.size)[item] >= self.need[item]
            item, diagonal = item[some], diagonal[some]
            wide = self.wide[item]
            for half in (0, 1):  # bands of twice the budget, each overlapping the next by half
                band = (diagonal + (1 << 20) * wide + half * wide) // (2 * wide)
                keys, counts = np.unique(item << 40 | band, return_counts=True)
                keys = keys[counts >= self.need[keys >> 40]]
                for k, b in zip((keys >> 40).tolist(), (keys & (1 << 40) - 1).tolist(), strict=True):
                    budget = self.budgets[k]
                    start = max(0, b * 2 * (budget + 1) - (1 << 20) * (budget + 1) - half * (budget + 1) - budget)
                    size = len(self.items[k][1])
                    d = distance(self.items[k][1], raw[start : start + size + 4 * budget + 2], budget)
                    if d <= budget and (k not in found or (d, start) < found[k]):
                        found[k] = (d, start)
        return [(self.items[k][0], d, p) for k, (d, p) in sorted(found.items())]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, at: each benchmark item that a document's normalised text holds within 10 % edits (bytes).

    Null and empty texts and items match nothing; repeated rows match each; items under 10 bytes must occur exactly, as
    10 % of them is no edit. Items go to the tasks in blocks of bounded size."""
    items = texts(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    blocks = 1 + int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK)
    out = None
    for k in range(blocks):
        index = Index(sorted((r.doc_id, normal(r.text)) for r in items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).collect()))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @frugal
        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = [(d, *m) for d, t in zip(f["doc_id"], f["text"], strict=True) for m in shared.value.find(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "edits", "at"])

        part = texts(docs).mapInPandas(run, "doc_id long, item_id long, edits int, at long")
        out = part if out is None else out.unionByName(part)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

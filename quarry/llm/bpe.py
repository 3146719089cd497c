"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import frugal, table, texts

#: Pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 150_000
#: Bytes of ids that a task holds before it hands them on.
HELD = 8 << 20


class PerfectHash:
    """Hash and displace: one slot per key, and no more slots than keys."""

    def __init__(self, keys: list[bytes]) -> None:
        import xxhash

        self.n, self.size = len(keys), max(1, len(keys) // 2)
        self.shift, self.slots = np.zeros(self.size, np.int64), [0] * self.n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.size, []).append((h, i))
        free, at = set(range(self.n)), 0
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                slot = free.pop()
                self.shift[b], self.slots[slot] = -slot - 1, members[0][1]
                continue
            at = 0
            while True:
                got = [self.probe(h, at) for h, _ in members]
                if len({*got}) == len(got) and free.issuperset(got):
                    break
                at += 1
            self.shift[b] = at
            for slot, (_, i) in zip(got, members, strict=True):
                free.discard(slot)
                self.slots[slot] = i
        self.shift = self.shift.tolist()

    def probe(self, h: int, shift: int) -> int:
        x = (h + shift * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def find(self, h: int) -> int:
        """The index of the key that h may stand for; the caller compares the key."""
        shift = self.shift[h % self.size]
        return self.slots[-shift - 1 if shift < 0 else self.probe(h, shift)]


class Codec(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; remembers a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.keys_ = ranks, list(ranks)
        self.hash = PerfectHash(self.keys_)
        self.bytes_of = {r: k for k, r in ranks.items()}

    def __missing__(self, word: str) -> bytes:
        import xxhash

        raw = word.encode()
        key = self.keys_[self.hash.find(xxhash.xxh3_64_intdigest(raw))]
        ids = np.array([self.ranks[key]] if key == raw else self.merge(raw), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        n, rank = len(raw), self.ranks.get
        before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue
            end[i], after[i], end[j] = stop, after[j], -1
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        i, out = 0, []
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str, pattern) -> bytes:
        return b"".join(map(self.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str):
    """Each Python worker builds it once from the installed vocabulary."""
    import regex

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return Codec(ranks), regex.compile(pattern)


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32 bits each), ids_sha256, decoded_sha256 for every row.

    Null counts as empty: no ids. Texts of any length are encoded whole; repeated rows are encoded each."""

    columns = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, split = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for f in frames:
            rows, size = [], 0
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                ids = code.encode(t, split)
                rows.append((d, len(ids) // 4, ids, sha(ids), sha(code.decode(ids))))
                size += len(ids)
                if size > HELD:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return tokenize(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN).drop("ids")

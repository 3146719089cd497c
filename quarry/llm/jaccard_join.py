"""N-gram Jaccard join over a token-group matrix.

Documents of equal shingle sets are one class. Classes that share rare shingles with a leading class form a group around
it. The matrix holds, for each shingle of the index prefixes, the groups that have it; a class asks it with the shingles of
its probe prefix. Of two linked sets the larger one's probe prefix (its rarest n - ceil(t * n) + 1) meets the smaller one's
index prefix (its rarest n - ceil(2 * t / (1 + t) * n) + 1) in an order that all documents use, so a link to a smaller or
equal set of another group is always found. A group is stored in blocks of members, each with the union of its shingles
and, for each, the members that have it. A block is opened for a class only where the class shares as many shingles with
the union as a link to any member asks for. A sketch of parities, of which each shingle flips one bit, bounds how many two
sets can't share, and keeps sets that it rules out from being fetched. Links with a group's leader come first; members that have one are
joined by it, the others ask their own group too. How classes are grouped and ordered affects speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Shelf, frugal, keyed, table, texts
from quarry.llm.features import A, B, Words, hashes, words_of

#: Frequent shingles that the order puts last: at most so many, those found in FREQUENT documents of a batch.
HINTS, FREQUENT = 100_000, 8
#: Bits of the filter that picks documents by id: 16 for each id, at least and at most 2**these.
BITMAP = (20, 28)
#: Bytes of the sets of a group's members, or of classes that ask for it, in a block, on average.
BLOCK = 4 << 20
#: Followers of a leader that are many.
CROWD = 64
#: Parts that joins on one vertex or label are dealt to.
SALT = 16
#: Bytes of sets that a task holds before it hands them on.
HELD = 8 << 20


def shingles(text: str, k: int, memo: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k words in sequence; fewer words are one shingle; none without words."""
    w = hashes(memo, words_of(text))
    if not w.size:
        return w
    width = min(k, w.size)
    h = np.full(w.size - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ w[j : w.size - width + 1 + j]) * (A if j % 2 else B)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Frequent shingles, the most frequent last."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for f in frames:
            held, size = [], 0
            for at, t in enumerate(f["text"]):
                held.append(shingles(t, k, memo))
                size += held[-1].size
                if size > 2_000_000 or at == len(f) - 1:
                    code, count = np.unique(np.concatenate(held), return_counts=True)
                    often = count >= FREQUENT
                    yield pd.DataFrame({"token": code[often].view(np.int64), "n": count[often]})
                    held, size = [], 0

    found = docs.mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(HINTS).collect()
    return np.array([r.token for r in reversed(top)], np.int64).view(np.uint64)


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids.astype(np.uint64) * A) >> np.uint64(64 - bits)


def _marks(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap with a bit set for each id; its size is bounded whatever the number of ids."""
    low, high = BITMAP
    bits = min(high, max(low, int(16 * ids.count()).bit_length()))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for f in frames:
            bit = _bit(f["id"].to_numpy(np.int64), bits)
            np.bitwise_or.at(out, bit >> np.uint64(3), (128 >> (bit & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        if out.any():
            yield pd.DataFrame({"part": np.arange(64), "bits": [x.tobytes() for x in np.split(out, 64)]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f["part"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in f["bits"]]).tobytes()]})

    few = ids.repartition(8, "id").mapInPandas(run, "part long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = out.size // 64
    for r in few.groupBy("part").applyInPandas(merged, "part long, bits binary").toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return bits, out


def _marked(marks: tuple[int, np.ndarray], ids: np.ndarray) -> np.ndarray:
    bit = _bit(ids, marks[0])
    return (marks[1][bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _postings(shelf: Shelf, classes: DataFrame, common: DataFrame) -> DataFrame:
    """token, id, n, pos of the shingles in common, and of a few that share their bit."""
    shared = shelf.share(_marks(common.select(F.col("token").alias("id"))))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = np.array([len(p) for p in f["prefix"]])
            token = np.concatenate([np.asarray(p, np.int64) for p in f["prefix"]])
            pos = np.arange(token.size) - np.repeat(np.cumsum(size) - size, size)
            keep = _marked(shared.value, token)
            yield pd.DataFrame({"token": token, "id": np.repeat(f["id"].to_numpy(), size), "n": np.repeat(f["n"].to_numpy(), size), "pos": pos})[keep]

    return classes.select("id", "n", "prefix").mapInPandas(run, "token long, id long, n int, pos int")


def _sets(shelf: Shelf, docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, size in bytes, tokens of the documents with these ids, and of a few that share their bit: texts needn't move to be picked."""
    shared = shelf.share(_marks(ids))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for f in frames:
            rows, size = [], 0
            f = f[_marked(shared.value, f["doc_id"].to_numpy(np.int64))]
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                tokens = shingles(t, k, memo).tobytes()
                rows.append((d, len(tokens), tokens))
                size += len(tokens)
                if size > HELD:
                    yield pd.DataFrame(rows, columns=["id", "size", "tokens"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["id", "size", "tokens"])

    return shelf.put(docs.mapInPandas(run, "id long, size long, tokens binary"))


def _bins(n: int) -> int:
    """Bits of the sketch of n shingles."""
    return 2 << max(5, int(n - 1).bit_length())


def _sketch(s: np.ndarray) -> bytes:
    """A bit for the parity of each of 2**k bins of the set, two to four for each shingle: unlike sets differ in enough of them."""
    bins = _bins(s.size)
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def _differ(one: bytes, two: bytes, n: int) -> int:
    """At least so many shingles are in one of the two sets alone: each flips one bit. Sketches are compared at the bits that a set of
    n shingles has, or fewer."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = min(x.size, y.size, _bins(n) // 8)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))).sum())


def _near(shelf: Shelf, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs id, g whose sizes, and whose sketches, compared at the bits of least shingles, differ in no more than x * the size of
    id + y * that of g. A sketch of few bits is full when it meets a much larger set: sizes tell these apart, and do so before any
    sketch is moved."""
    size = lambda c: heads.select(F.col("id").alias(c), F.col("n").alias("n" + c))
    most = (F.col("x") * F.col("nid") + F.col("y") * F.col("ng") + 1e-6).alias("most")
    alike = pairs.join(size("id"), "id").join(size("g"), "g").where(F.abs(F.col("nid") - F.col("ng")) <= most).select("id", "g", "least", most)
    alike = shelf.put(alike)
    shared = shelf.share(_marks(alike.select("id").union(alike.select("g")).distinct()))

    @frugal
    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[_marked(shared.value, f["id"].to_numpy(np.int64))]

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            differ = np.fromiter(map(_differ, f["sid"], f["sg"], f["least"]), np.int64, len(f))
            yield f.loc[differ <= f["most"], ["id", "g"]]

    some = shelf.put(heads.select("id", "sketch").mapInPandas(pick, "id long, sketch binary"))
    side = lambda c: some.select(F.col("id").alias(c), F.col("sketch").alias("s" + c))
    out = shelf.put(alike.join(side("id"), "id").join(side("g"), "g").mapInPandas(run, "id long, g long"))
    shelf.drop(alike, some)
    return out


def _signed(shelf: Shelf, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, key of the set, a sketch, and the probe prefix in the common order."""
    often = _frequent(docs, k)
    order = np.argsort(often)
    shared = shelf.share((often[order], order))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        memo, (known, rank) = Words(), shared.value
        for f in frames:
            rows, size = [], 0
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                s = shingles(t, k, memo)
                prefix = s
                if s.size:
                    place = np.full(s.size, -1)
                    if known.size:
                        at = np.minimum(np.searchsorted(known, s), known.size - 1)
                        place = np.where(known[at] == s, rank[at], -1)
                    prefix = s[np.lexsort((s, place))[: s.size - -(-percent * s.size // 100) + 1]]
                rows.append((d, s.size, xxhash.xxh3_128_digest(s.tobytes()), prefix.view(np.int64), _sketch(s)))
                size += prefix.nbytes + s.size // 2 + 64
                if size > HELD:
                    yield pd.DataFrame(rows, columns=["doc_id", "n", "key", "prefix", "sketch"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "n", "key", "prefix", "sketch"])

    return shelf.put(docs.mapInPandas(run, "doc_id long, n long, key binary, prefix array<long>, sketch binary"))


class _Forest(dict):
    """Roots of labels; the least one that a set of joined labels has."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _block_links(asked: list[dict], members: list[dict], label: dict[int, int], percent: int) -> tuple[list[tuple[int, int]], _Forest]:
    """Links between classes of a block and members of a block, without those that others, or equal labels, imply."""
    sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
    size = np.array([s.size for s in sets])
    union, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(size.size), size)[np.argsort(of, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=union.size))])
    least, joined, out = int(size.min()), _Forest(), []
    for q in asked:
        s = np.frombuffer(q["tokens"], np.uint64)
        at = np.minimum(np.searchsorted(union, s), union.size - 1)
        at = at[union[at] == s]
        if (100 + percent) * at.size < percent * (s.size + max(least, -(-percent * s.size // 100))):
            continue  # the union has too few of its shingles: no member can be linked
        n = start[at + 1] - start[at]
        both = np.bincount(owner[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=size.size)
        for m in np.flatnonzero(100 * both >= percent * (s.size + size - both)).tolist():
            if joined.join(label.get(q["id"], q["id"]), label.get(members[m]["id"], members[m]["id"])):
                out.append((q["id"], members[m]["id"]))
    return out, joined


def _groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """g, mk, blocks, m: the members of each group (g, id) in blocks of bounded size, with their sets; the leader is in all of them."""
    parts = rows.join(sets.select("id", "size"), "id").groupBy("g").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    place = F.when(F.col("id") == F.col("g"), every).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    dealt = rows.join(parts, "g").select("g", "id", "blocks", F.explode(place).alias("mk"))
    return dealt.join(sets.select("id", "tokens"), "id").groupBy("g", "mk", "blocks").agg(F.collect_list(F.struct("id", "tokens")).alias("m"))


def _within(groups: DataFrame, percent: int) -> DataFrame:
    """g, mk, blocks, id, label for the members of each block: equal labels for what links join there, the leader where it is one of
    them."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, mk, blocks, m in zip(f["g"], f["mk"], f["blocks"], f["m"], strict=True):
                ids = np.array([x["id"] for x in m], np.int64)
                joined = _block_links(m, m, {}, percent)[1] if len(m) > 1 else _Forest()
                lead = joined.find(g)
                roots = [g if (r := joined.find(int(i))) == lead else r for i in ids]
                yield pd.DataFrame({"g": g, "mk": mk, "blocks": blocks, "id": ids, "label": roots})

    return groups.mapInPandas(run, "g long, mk long, blocks long, id long, label long")


def _across(asked: DataFrame, groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes (g, id, label) and the members of the groups that they ask. Rows are pairs of blocks, so neither
    side of a group is ever in one place."""
    sized = asked.join(sets.select("id", "size"), "id").groupBy("g").agg(F.ceil(F.sum("size") / BLOCK).alias("ak"))
    dealt = asked.join(sized, "g").withColumn("ak", F.pmod(F.xxhash64("id"), F.col("ak"))).join(sets.select("id", "tokens"), "id")
    one = dealt.groupBy("g", "ak").agg(F.collect_list(F.struct("id", "label", "tokens")).alias("a"))
    wanted = asked.select("g").distinct()
    known = labels.join(wanted, "g", "left_semi").groupBy("g", "mk").agg(F.collect_list(F.struct("id", "label")).alias("l"))
    two = groups.join(wanted, "g", "left_semi")
    each = one.join(labels.join(wanted, "g", "left_semi").select("g", "blocks").distinct(), "g").select("g", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("mk"))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, m, l in zip(f["a"], f["m"], f["l"], strict=True):
                label = {x["id"]: x["label"] for x in l} | {x["id"]: x["label"] for x in a}
                yield pd.DataFrame(_block_links(a, m, label, percent)[0], columns=["a", "b"], dtype=np.int64)

    return two.join(known, ["g", "mk"]).join(each, ["g", "mk"]).select("a", "m", "l").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """v, c: the smallest vertex that each vertex of the edges (a, b) reaches. Each round takes the least label around a
    vertex and that label's own label; joins are salted, so a vertex of many edges or a label of many vertices is dealt out."""
    salted = lambda df, c: df.withColumn("salt", F.pmod(F.xxhash64(c), F.lit(SALT)))
    copied = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    both = shelf.put(salted(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct(), "v"))
    label = shelf.put(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")).withColumn("old", F.lit(None).cast("long")))
    while True:
        known = label.select("v", "c")
        near = both.join(copied(known.withColumnRenamed("v", "u")), ["u", "salt"]).groupBy("v").agg(F.min("c").alias("near"))
        low = known.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        roots = known.join(low.select(F.col("c").alias("v")).distinct(), "v", "left_semi")
        far = copied(roots.select(F.col("v").alias("c"), F.col("c").alias("far")))
        new = shelf.put(salted(low, "v").join(far, ["c", "salt"]).select("v", F.least("c", "far").alias("c"), "old"))
        shelf.drop(label)
        label = new
        if new.where("old <> c").isEmpty():
            shelf.drop(both)
            return new.select("v", "c")


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents link when 100 * intersection >= percent * union.

    Words are [^ \x09-\x0D]+ with A-Z lower-cased; shingles are compared by 64 bits of hash, whole sets by 128. Null,
    empty and blank texts have no shingles and link with nothing; repeated rows are rows of one class; rows of one id with
    several texts, and those without an id, are documents each, of which ids alone name a component (null where it has
    none); an empty table gives none; other columns are ignored."""
    rows, odd = keyed(texts(docs))
    if not odd:
        return _linked(rows.select("doc_id", "text"), k, percent)
    found = _linked(rows.select(F.col("key").alias("doc_id"), "text"), k, percent).withColumnRenamed("doc_id", "key")
    named = found.join(rows.select("key", "doc_id").distinct(), "key")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """linked for ids that are never null and stand for one text each."""
    shelf = Shelf(docs.sparkSession)
    signed = _signed(shelf, docs, k, percent)
    classes = shelf.put(signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))
    keys = shelf.put(signed.select("doc_id", "n", "key"))
    shelf.drop(signed)
    shelf.tidy()
    indexed = F.col("pos") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    whole = classes.select("n", F.posexplode("prefix").alias("pos", "token")).select("token", indexed.alias("indexed"))
    common = shelf.put(whole.groupBy("token").agg(F.count("*").alias("df"), F.max("indexed").alias("indexed")).where("df > 1 AND indexed").select("token"))
    posted = shelf.put(_postings(shelf, classes, common).withColumn("indexed", indexed).join(common, "token"))
    heads = shelf.put(classes.select("key", "id", "n", "sketch"))
    shelf.drop(classes, common)
    shelf.tidy()

    # of the classes with a shingle, the one that has the largest part of its prefix in common with others leads the rest;
    # a class goes to the leader that most of its shingles name, if it can be linked to it; if many name that leader, also if
    # both can be linked to a third, so that near misses of a large group are of it
    shares = posted.groupBy("id").agg(F.count("*").alias("o"))
    part = F.struct(F.col("o") / F.col("n"), (-F.col("id")).alias("x"))
    firsts = posted.join(shares, "id").groupBy("token").agg((-F.max(part).getField("x")).alias("first"))
    votes = posted.join(firsts, "token").groupBy("id", "first").agg(F.count("*").alias("o"))
    own = shelf.put(votes.groupBy("id").agg((-F.max(F.struct("o", (-F.col("first")).alias("x"))).getField("x")).alias("g")))
    follow = own.where("id <> g")
    crowded = shelf.put(follow.groupBy("g").agg((F.count("*") > CROWD).alias("many")))
    # sketches of linked sets differ by a * both sizes at most; those of two sets with a link to a third by b * both sizes
    a, b = (100 - percent) / (100 + percent), (200 - 2 * percent) / (2 * percent)
    every = F.lit(1 << 40).alias("least")  # sketches are compared at all bits that both have
    reach = F.when(F.col("many"), b).otherwise(a)
    named = shelf.put(heads.join(own, "id", "left_semi").select("id", "n", "sketch"))  # the few classes that share a rare shingle
    near = _near(shelf, follow.join(crowded, "g").select("id", "g", reach.alias("x"), reach.alias("y"), every), named)
    led = own.select("id").join(near, "id", "left").select("id", F.coalesce("g", "id").alias("g"))
    grouped = shelf.put(posted.join(led, "id"))
    shelf.drop(posted, own)

    # the token-group matrix, with what bounds the overlap with any member that has the shingle in its index prefix
    matrix = grouped.where("indexed").groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    asks = grouped.select("token", "id", "n", "pos", F.col("g").alias("home"))
    fewest = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    met = (F.col("g") != F.col("home")) & F.col("n").between(F.col("least"), F.floor(100 * F.col("most") / percent))
    met &= (100 + percent) * F.least(F.col("rest"), F.col("n") - F.col("pos")) >= percent * (F.col("n") + fewest)
    pairs = asks.join(matrix, "token").where(met).select("id", "g").distinct()
    own = shelf.put(grouped.select("id", "g").distinct())
    led_by = shelf.put(grouped.where("id <> g").groupBy("g").agg(F.min("n").alias("least")))
    leaders = led_by.select("g")
    # differences of sketches add up, and so do those of sizes: from a class to the smaller member that it links to, and on to the
    # leader; those of sketches only at bits that all three have
    spread = led_by.join(crowded, "g", "left").select("g", "least", F.when(F.col("many"), b).otherwise(a).alias("y"))
    to = pairs.join(spread, "g", "left").select("id", "g", F.coalesce(F.col("y") + 2 * a, F.lit(a)).alias("x"), F.coalesce("y", F.lit(a)).alias("y"), F.coalesce("least", every).alias("least"))
    loose = _near(shelf, to, named)
    members = shelf.put(own.select("g", "id").union(leaders.select("g", F.col("g").alias("id"))).distinct())
    # members of groups that aren't crowded are few: their own sketches tell more than the leader's
    large = crowded.where("many").select("g")
    few, of = loose.join(large, "g", "left_anti"), members.select("g", F.col("id").alias("m"))
    each = few.join(of, "g").where("m <> id").select("id", F.col("m").alias("g"), F.lit(a).alias("x"), F.lit(a).alias("y"), every).distinct()
    close = _near(shelf, each, named).withColumnRenamed("g", "m").join(of, "m").select("id", "g").distinct().join(few, ["id", "g"], "left_semi")
    abroad = shelf.put(close.unionByName(loose.join(large, "g", "left_semi")))
    shelf.drop(grouped, near, crowded, loose, named)
    shelf.tidy()

    inside = members.join(leaders.union(abroad.select("g")).distinct(), "g", "left_semi")
    sets = _sets(shelf, docs, inside.select("id").union(abroad.select("id")).distinct(), k)
    shelf.tidy()
    groups = shelf.put(_groups(inside, sets))
    labels = shelf.put(_within(groups, percent))
    # members of groups of several blocks that no link joins to the leader ask their own group, others those that they may link to
    apart = labels.where("blocks > 1 AND label <> g AND id <> g").select("g", "id", "label")
    asked = shelf.put(abroad.select("g", "id", F.col("id").alias("label")).unionByName(apart))
    shelf.tidy()
    edges = labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    links = shelf.put(edges.unionByName(_across(asked, groups, labels, sets, percent)))
    shelf.drop(sets, groups, labels, asked, own, led_by, members, abroad)
    shelf.tidy()
    found = components(links, shelf).select(F.col("v").alias("id"), "c")
    shelf.drop(links)
    shelf.unshare()
    ids = heads.join(found, "id", "left").select("key", F.coalesce("c", "id").alias("c"))
    return keys.join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), 4, 85)

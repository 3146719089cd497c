"""Toxicity by weak supervision: voters that may abstain, a generative label model, and a linear classifier on its posteriors.

Lexicon voters are a declared list of insults and word beginnings that labelled rows show to be toxic; each fires where a word
begins with its entry, some only where several do. Pattern voters look at how many entries a text has and how dense they are;
some of them vote for a clean text. The label model sees no label: over labelled and unlabelled texts alike it estimates by EM how often each voter fires
in either class, and how voters that fire together depend on each other. A logistic regression on the posteriors is the score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Shelf, bucket, frugal, table, texts
from quarry.llm.quality import sample

#: Labelled rows of each class, and rows without a label, that a model is fitted on at most; see quality.sample on their bytes.
PER_CLASS, UNLABELLED = 2500, 4000
#: Letters of the beginnings of words that may become entries; rows of label 1 that must have one, at least and as a part of all; how
#: much oftener than others they must have it; the rows times the logarithm of that, at least; how often in one text is looked at.
LETTERS, SUPPORT, SHARE, LIFT, GAIN, TIMES = range(3, 11), 4, 0.015, 8.0, 16.0, 3
#: Least difference of the log odds with which a voter fires in its own class and in the other.
EDGE = 2.0
#: Words whose entries a task remembers.
REMEMBERED = 150_000
# Common insults of four languages, as beginnings of words.
INSULTS = [
    "abschaum", "asshole", "bastard", "clown", "connard", "crétin", "débile", "dépotoir", "disgusting", "dreckskerl", "escoria", "estúpid", "filth", "idiot", "imbécil", "imbecile", "inútil", "loser", "moron",
    "ordure", "pathetic", "raclure", "scum", "stupid", "stupide", "trash", "trottel", "vollidiot", "worthless",
]
#: Pattern voters that vote for label 1, then those that vote for 0; the rest of the voters are entries, for label 1.
PATTERNS = ["two entries", "three hits", "a hit in each hundred words", "no hit", "no hit in a hundred words", "a single hit in two hundred words"]
CLEAN = 3


def words_in(text: str) -> Counter:
    import regex

    return Counter(regex.findall(r"\p{L}+", text.lower()))


class Entries(dict):
    """The entries that each word begins with; remembers a bounded number of words."""

    def __init__(self, entries: dict[str, int]) -> None:
        self.place = {e: k for k, e in enumerate(entries)}
        self.least = [*entries.values()]
        self.sizes = sorted({len(e) for e in entries})

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(k for n in self.sizes if n <= len(word) and (k := self.place.get(word[:n])) is not None)
        self[word] = found
        return found

    def seen(self, text: str) -> tuple[dict[int, int], int]:
        """How often each entry occurs, counted from the time on from which it counts, and all words."""
        hits, total = defaultdict(int), 0
        for word, n in words_in(text).items():
            total += n
            if found := self[word]:
                for k in found:
                    hits[k] += n
        return {k: n - self.least[k] + 1 for k, n in hits.items() if n >= self.least[k]}, total


def patterns(kinds: int, hits: int, total: int) -> list[bool]:
    return [kinds >= 2, hits >= 3, hits >= 1 and 100 * hits >= total, hits == 0, hits == 0 and total >= 100, hits == 1 and total >= 200]


def lexicon(rows: list[tuple[dict[str, int], int]]) -> dict[str, int]:
    """Entries, and how often one must occur in a text to count: the declared insults, and beginnings of words that rows of label 1 have LIFT times as often as others, once or some times in a
    text. Those that tell most come first, and of two entries that begin alike one is taken, so a family of words is one entry.
    rows: how often each word occurs, and the label."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    size = [0, 0]
    for words, y in rows:
        size[y] += 1
        sums: Counter = Counter()
        for w, times in words.items():
            for n in LETTERS:
                if n <= len(w):
                    sums[w[:n]] += times
        count[y].update((e, m) for e, times in sums.items() for m in range(1, min(times, TIMES) + 1))
    found = dict.fromkeys(INSULTS, 1)
    if min(size):
        gain: dict[str, tuple[float, int]] = {}
        for (e, m), n in count[1].items():
            lift = (n / size[1]) / ((count[0][e, m] + 0.5) / size[0])
            if n >= max(SUPPORT, SHARE * size[1]) and lift >= LIFT:
                gain[e] = max(gain.get(e, (0.0, 0)), (n * float(np.log(lift)), -m))
        for e in sorted((e for e in gain if gain[e][0] >= GAIN), key=lambda e: (-gain[e][0], len(e), e)):
            if not any(x.startswith(e) or e.startswith(x) for x in found):
                found[e] = -gain[e][1]
    return dict(sorted(found.items()))


def ballot(hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which voters fire on each row, without those that never do, and which vote for label 0. An entry votes as one that occurs, and as
    one that does so 2 to TIMES times."""
    looks = np.array([patterns(int(a), int(b), int(c)) for a, b, c in zip((hits > 0).sum(1), hits.sum(1), total, strict=True)], float)
    votes = np.column_stack([looks, *(hits >= m for m in range(1, TIMES + 1))])
    place, used = np.arange(votes.shape[1]), votes.any(0)
    return votes[:, used].astype(float), ((place >= CLEAN) & (place < len(PATTERNS)))[used]


def _log_fires(votes: np.ndarray, bias: np.ndarray, couple: np.ndarray) -> np.ndarray:
    """For each row and class the logarithm of the voters' probability, each given the others."""
    with_others = votes @ couple
    out = []
    for b in bias:
        z = b + with_others
        out.append((votes * z - np.logaddexp(0, z)).sum(1))
    return np.stack(out, 1)


def label_model(votes: np.ndarray, clean: np.ndarray, rounds: int = 25, steps: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 of each row, the log odds that a voter fires in class 0 and 1, and the couplings of voters.

    votes: 1 where a voter fires, else it abstains; clean: voters for label 0. EM from the majority vote; a voter's chance to fire is
    logistic in the class and in the other voters that fire, so couplings (symmetric, none with itself) take up what two
    voters have in common beyond the class. Voters for different labels have none: that they exclude each other is what the classes
    are to explain, and with it explained otherwise EM parts texts of many entries from those of few. No label is used."""
    votes, of, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)  # rows that vote alike are one
    n, m = int(times.sum()), votes.shape[1]
    side = np.where(clean, -1.0, 1.0)
    balance = votes @ side
    post = np.clip(0.5 + 0.2 * balance, 0.02, 0.98)
    share = np.clip(times[balance > 0].sum() / n, 0.01, 0.5)  # the classes' balance is that of the majority vote
    bias, couple = np.zeros((2, m)), np.zeros((m, m))
    for _ in range(rounds):
        for _ in range(steps):
            with_others = votes @ couple
            step = np.zeros((m, m))
            for y, weight in enumerate((times * (1 - post), times * post)):
                p = 1 / (1 + np.exp(-np.clip(bias[y] + with_others, -30, 30)))
                left = weight[:, None] * (votes - p)
                spread = (weight[:, None] * p * (1 - p)).sum(0) + 1.0
                prior = np.where((side > 0) == (y == 1), -1.0, -4.0)  # a voter seldom fires in the other class
                bias[y] += np.clip((left.sum(0) - (bias[y] - prior)) / spread, -1, 1)
                step += left.T @ votes
            # every voter is taken to be right more often than wrong: its log odds in its own class are EDGE higher
            middle, gap = bias.mean(0), np.maximum(side * (bias[1] - bias[0]), EDGE) / 2
            bias = np.stack([middle - side * gap, middle + side * gap])
            step = (step + step.T) / 2 - 5.0 * couple
            step[(side[:, None] != side) | np.eye(m, dtype=bool)] = 0
            couple = np.clip(couple + step / (0.25 * n + 5.0), -4, 4)
        each = _log_fires(votes, bias, couple)
        post = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + each[:, 1] - each[:, 0], -30, 30)))
    return post[of.reshape(-1)], bias, couple


def inputs(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What the classifier sees: how often each entry occurs, how many do, and how dense they are."""
    of = hits.sum(1)
    return np.column_stack([np.log1p(hits), np.log1p((hits > 0).sum(1)), np.log1p(of), np.log1p(100 * of / np.maximum(total, 1))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and a bias last, by Newton steps; y: posteriors."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - keep * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(keep + 1e-6)
        w = w + np.clip(np.linalg.solve(curve, slope), -3, 3)
    return w


def fit(labelled: DataFrame, others: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Entries, and the classifier's weights with a bias last. labelled: doc_id, text, y; others: doc_id, text, without labels. Both
    bounded. Without texts nothing but a bias that scores all 0."""

    @frugal
    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [words_in(t) for t in f["text"]]
            yield pd.DataFrame({"y": f["y"], "words": [[*w] for w in each], "times": [[*w.values()] for w in each]})

    rows = labelled.mapInPandas(words, "y int, words array<string>, times array<int>").toLocalIterator()
    entries = lexicon([(dict(zip(r.words, r.times, strict=True)), r.y) for r in rows])

    @frugal
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Entries(entries)
        for f in frames:
            got = [known.seen(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "k": [[*h] for h, _ in got], "n": [[*h.values()] for h, _ in got], "total": [x[1] for x in got]})

    every = labelled.select("doc_id", "text").unionByName(others.select("doc_id", "text"))
    got = sorted(every.mapInPandas(counted, "doc_id long, k array<int>, n array<int>, total long").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.total, r.k))
    if not got:
        return entries, np.append(np.zeros(len(entries) + 3), -20.0)
    hits = np.zeros((len(got), len(entries)))
    for i, r in enumerate(got):
        hits[i, r.k] = r.n
    total = np.array([r.total for r in got])
    votes, clean = ballot(hits, total)
    post, _, _ = label_model(votes, clean)
    return entries, logistic(inputs(hits, total), post)


def score(docs: DataFrame, model: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """doc_id, score for every row; null and empty texts, and those without words, have the bias alone."""
    shared = Shelf(docs.sparkSession).share(model)  # entries are bounded by the labelled rows

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, w = shared.value
        known = Entries(entries)
        for f in frames:
            out = []
            for t in f["text"]:
                hits, total = known.seen(t)
                of = sum(hits.values())
                z = w[-1] + w[-4] * np.log1p(len(hits)) + w[-3] * np.log1p(of) + w[-2] * np.log1p(100 * of / max(total, 1))
                z += sum(w[k] * np.log1p(n) for k, n in hits.items())
                out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": out})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of held-out rows are not read.

    Null and empty texts score the bias; repeated rows score alike; a null doc_id counts as held out; without labels the declared insults
    alone are entries; an empty table gives none; other columns are ignored."""
    known = labels.where("toxic in (0, 1)").where(bucket(4) != 2)
    some = docs.where(bucket(4) != 2).select("doc_id").distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    pick = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED).withColumn("toxic", F.lit(0))
    s = score(docs, fit(sample(docs, known, "toxic", PER_CLASS), sample(docs, pick, "toxic", UNLABELLED)))
    out = F.coalesce(bucket(4) == 2, F.lit(True))
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

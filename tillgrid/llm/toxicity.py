"""Toxicity grades by cumulative-link (ordinal logistic) regression over sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) for k = 0, 1, 2: one weight vector for all
thresholds, which are kept in order. The expected severity is the sum of these
probabilities. Features are words and the first four letters of words that
occur clearly more often in documents labelled toxic, and before many different words: words
of passages that were merely copied keep their neighbours. A feature's value is its
share of the text's words per thousand, at most 50; one more feature is 1 where any occurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import settle

#: Labelled documents learned from, at most, half of them for each class, drawn by a hash; features kept at most.
SAMPLE_DOCS = 10_000
FEATURES = 20_000
#: What a feature needs: toxic documents with it, different words after it in
#: toxic documents (told apart by 64 hash values), G2 statistic.
LEAST_DOCS = 4
LEAST_NEXT = 8
LEAST_G2 = 15.0
MOST_VALUE = 50.0
#: Grades of toxic documents: thirds of the share of their words that are telling features.
GRADES = 4
STEPS = 1000
RATE = 0.1
RIDGE = 1e-5

WORD = re.compile(r"[^\W\d_]+")
PREFIX = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> tuple[str, ...]:
    """The word, and its beginning as a feature of its own."""
    return (word, word[:PREFIX] + "*") if len(word) > PREFIX else (word,)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[bool, int]]:
    """text, toxic (0 or 1) of at most ``size`` labelled documents, half of it for each class, and how many there are of each class.

    A document with several labels has the highest; labels of documents that aren't there don't count; of
    rows that share a labelled id the one whose text has the smallest hash is taken.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = settle(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {r["t"]: r["count"] for r in there.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    # Top reports over short rows, one a class: each task keeps that many, and they are few enough to broadcast.
    some = [there.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, size // 2)) for c in ("toxic > 0", "toxic <= 0")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return one.select("text", "toxic"), counts


def _document_counts(sample: DataFrame) -> DataFrame:
    """feature, n1, n0 (labelled documents, toxic and other, that hold it), after (distinct hash values of the word after it in toxic ones)."""
    def count(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        after: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                seen[toxic > 0].update({f for w in set(words) for f in features_of(w)})
                if toxic > 0:
                    for w, following in zip(words, [*words[1:], ""], strict=True):
                        bit = 1 << (zlib.crc32(following.encode("utf-8", "surrogatepass")) & 63)
                        for f in features_of(w):
                            after[f] |= bit
        names = list(seen[0].keys() | seen[1].keys())
        masks = np.array([after[f] for f in names], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0)],
                                          pa.array(masks)], ["feature", "n1", "n0", "after"])

    rows = sample.mapInArrow(count, "feature string, n1 long, n0 long, after long")
    return rows.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.bit_count(F.bit_or("after")).alias("after"))


def _telling(counts: DataFrame, toxic: int, other: int, most: int) -> list[str]:
    """Features that toxic documents hold more often, by the G2 statistic, at most ``most``."""
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    share = (toxic + 0.5) / (toxic + other + 1.0)
    g2 = 2 * (a * F.log(a / ((a + b) * share)) + b * F.log(b / ((a + b) * (1 - share))))
    rows = (counts.filter((F.col("n1") >= LEAST_DOCS) & (F.col("after") >= LEAST_NEXT) & (a / (a + b) > (1 + share) / 2)).withColumn("g2", g2)
                  .filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(most).select("feature").collect())
    return [r["feature"] for r in rows]


def _share_of(text: str, names: frozenset[str]) -> float:
    """The share of a text's words that hold one of the features ``names``."""
    words = words_of(text)
    return sum(n for w, n in Counter(words).items() if any(f in names for f in features_of(w))) / max(1, len(words))


def _rows_of(text: str, index: dict[str, int], memo: dict[str, tuple[int, ...]]) -> dict[int, float]:
    """Feature values of a text."""
    words = words_of(text)
    found: Counter = Counter()
    for w, n in Counter(words).items():
        at = memo.get(w)
        if at is None:
            if len(memo) > 500_000:
                memo.clear()
            at = memo[w] = tuple(index[f] for f in features_of(w) if f in index)
        for i in at:
            found[i] += n
    total = max(1, len(words))
    values = {i: min(MOST_VALUE, 1000 * n / total) for i, n in found.items()}
    if values:
        values[len(index)] = 1.0
    return values


@dataclass
class Model:
    """Features and their weights, and the ordered thresholds."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeding(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, row by row."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None], -500, 500)))


def fit(rows: list[dict[int, float]], grades: np.ndarray, size: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the mean log-loss, weights of 0 or more with a ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    val = np.array([x for r in rows for x in r.values()])
    k = GRADES - 1
    param = np.concatenate((np.zeros(size), [2.0], np.zeros(k - 1)))  # first threshold, then logs of the steps between them
    m, v = np.zeros_like(param), np.zeros_like(param)
    n = max(1, len(rows))
    for t in range(1, steps + 1):
        w, gaps = param[:size], np.exp(param[size + 1:])
        theta = param[size] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(at, val * w[col], minlength=len(rows)) if len(col) else np.zeros(len(rows))
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None], -500, 500)))
        bounds = np.concatenate((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))), 1)
        i = np.arange(len(rows))
        p = np.maximum(bounds[i, grades] - bounds[i, grades + 1], 1e-12)
        slope = np.concatenate((np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))), 1)
        dz = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        dtheta = np.zeros(k + 2)
        np.add.at(dtheta, grades, slope[i, grades] / p / n)
        np.add.at(dtheta, grades + 1, -slope[i, grades + 1] / p / n)
        dtheta = dtheta[1:-1]
        dw = (np.bincount(col, val * dz[at], minlength=size) if len(col) else np.zeros(size)) + RIDGE * w
        tails = np.cumsum(dtheta[::-1])[::-1]
        grad = np.concatenate((dw, [tails[0]], tails[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        param = param - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        np.maximum(param[:size], 0, out=param[:size])  # features were chosen for raising the grade
    return param[:size], param[size] + np.concatenate(([0.0], np.cumsum(np.exp(param[size + 1:]))))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, features: int = FEATURES) -> Model:
    """Model of a bounded labelled sample; without labelled documents nothing is toxic.

    What reaches the driver are the features chosen and the sample's rows over them. Labels say toxic or not; grades 1 to 3 are the
    thirds of the share of a toxic document's words that are features (grading each half of the sample by the other half's features found
    fewer toxic documents: 206 of 231 held out, against 212). Where the classes' shares in the sample are not those among
    the labels, the thresholds are moved by the difference of the log-odds.
    """
    sample, there = labelled_sample(docs, labels, size)
    sample = settle(sample, "labelled")
    n = {True: 0, False: 0} | {r["t"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    names = sorted(_telling(_document_counts(sample), n[True], n[False], features))
    index = {f: i for i, f in enumerate(names)}
    telling = frozenset(names)

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            got = [_rows_of(t, index, memo) for t in texts]
            share = [_share_of(t, telling) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array(share, pa.float64()), pa.array([list(r) for r in got], pa.list_(pa.int64())),
                pa.array([list(r.values()) for r in got], pa.list_(pa.float64()))], ["toxic", "share", "at", "value"])

    got = sample.mapInArrow(vectors, "toxic int, share double, at array<long>, value array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["share"], list(r["at"])))  # the fit doesn't depend on the order of partitions
    toxic = np.array([r["toxic"] > 0 for r in got], bool)
    share = np.array([r["share"] for r in got])
    cuts = np.quantile(share[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)) if toxic.any() else np.zeros(GRADES - 2)
    grades = np.where(toxic, 1 + (share[:, None] > cuts[None]).sum(1), 0).astype(np.int64)
    weights, thresholds = fit([dict(zip(r["at"], r["value"], strict=True)) for r in got], grades, len(names) + 1)
    if n[True] and n[False]:
        thresholds = thresholds + np.log(n[True] / n[False]) - np.log(there[True] / there[False])
    return Model(index, weights, thresholds)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (most probable), toxic (P(grade > 0) of a half or more), p_toxic.

    Reads whole texts of every row; a null or empty text has no features. Repeated rows stay, an empty table gives no rows, of equally
    probable grades the lower one is taken, further columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES words and weights

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        m: Model = sent.value
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [_rows_of(t, m.index, memo) for t in part.column(1).to_pylist()]
                linear = np.array([sum(m.weights[i] * x for i, x in r.items()) for r in rows], float)
                above = m.exceeding(linear)
                sure = -np.diff(np.concatenate((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))), 1), axis=1)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(above.sum(1)), pa.array(sure.argmax(1).astype(np.int32)),
                    pa.array(above[:, 0] >= 0.5), pa.array(above[:, 0])], ["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, severity double, grade int, toxic boolean, p_toxic double")

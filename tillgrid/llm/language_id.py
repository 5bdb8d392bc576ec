"""Language of a text by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of 0 to 4 bytes with the counts of
the byte after each. A byte seen after a context costs -log2(c / (T + D)) bits
(c its count there, T all counts, D distinct bytes); a byte not seen there
costs an escape, -log2(D / (T + D)), and is then coded after the context
shortened by its first byte; an unseen context costs nothing; below the empty
context every byte costs 8 bits. Counts are frozen after training. The
language with the shortest code of the whole text is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
#: Training sample of each language, in the order of a hash: whole texts, this
#: many at most, ending with the one that reaches so many bytes.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 2 << 20
#: Sample of all languages together, which many languages share evenly; languages learned at most, the most frequent ones.
TOTAL_BYTES = 64 << 20
MOST_LANGS = 1000
#: Bytes scored at once by a task; longer texts are scored in pieces that carry
#: their context over.
CHUNK = 1 << 20
UNKNOWN = "und"

_PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile("[A-Za-z]")


def folded(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from position ORDER on: its ``order`` bytes of context and itself, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - back:ORDER - back + n].astype(np.uint64)
    return out


def training_sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text of a bounded sample of each language of ``labelled`` (doc_id, lang, text).

    A hash threshold thins each language to about twice the sample first, and rows repeated exactly count once,
    so no language's rows gather in one task. Of more than ``MOST_LANGS`` values of lang the most frequent are learned (ties: by name).
    """
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    size = min(size, TOTAL_BYTES // max(1, len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, (2.0 * docs + 64) / n)]) if counts else None
    thin = labelled.withColumn("_h", spread)
    if counts:
        thin = thin.filter(F.col("_h") < F.try_element_at(share, F.col("lang")))  # languages that aren't learned have no share
    thin = thin.groupBy("lang", "_h").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (thin.withColumn("_k", F.row_number().over(order))
                .withColumn("_b", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
                .filter((F.col("_k") <= docs) & (F.col("_b") < size)).select("lang", "text"))


def count_contexts(sample: DataFrame) -> DataFrame:
    """lang, k (context length), key, n: how often each byte follows each context."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(_PAD + folded(text), np.uint8)
                for k in range(ORDER + 1):
                    key, n = np.unique(keys(data, k), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), k, np.int32)),
                         pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "key", "n"])

    rows = sample.mapInArrow(count, "lang string, k int, key long, n long")
    return rows.groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))


class Index:
    """Numbers of stored keys: open addressing over a table a quarter full, probed for many keys at once."""

    def __init__(self, stored: np.ndarray):
        self.bits = max(4, int(len(stored) * 4 - 1).bit_length()) if len(stored) else 4
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int32)
        self.stored = stored
        self.probes, left, at = 0, np.arange(len(stored)), self._hash(stored)
        while len(left):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at, self.probes = left[rest], (at[rest] + 1) & (size - 1), self.probes + 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't stored."""
        out = np.full(len(key), -1, np.int32)
        if not len(self.stored):
            return out
        todo, at = None, self._hash(key)
        for _ in range(self.probes):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.stored[slot] == (key if todo is None else key[todo]))
            more = (slot >= 0) & ~hit
            if todo is None:
                out[hit] = slot[hit]
                todo = np.flatnonzero(more)
            else:
                out[todo[hit]] = slot[hit]
                todo = todo[more]
            if not len(todo):
                break
            at = (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Model:
    """Code lengths of every stored (context, byte), and escape costs of every stored context, by language."""

    def __init__(self, rows):
        """``rows``: arrays lang, k, key, n of ``count_contexts``."""
        lang, order, key, n = rows
        self.langs = sorted(set(lang))
        code = {x: i for i, x in enumerate(self.langs)}
        which = np.array([code[x] for x in lang], np.int64)
        self.bytes: list[tuple[Index, np.ndarray]] = []
        self.contexts: list[tuple[Index, np.ndarray]] = []
        size = len(self.langs)
        for k in range(ORDER + 1):
            of = order == k
            stored, at = np.unique(key[of].astype(np.uint64), return_inverse=True)
            c = np.zeros((len(stored), size))
            c[at, which[of]] = n[of]
            ctx, of_ctx = np.unique(stored >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
            np.add.at(total, of_ctx, c)
            np.add.at(distinct, of_ctx, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                shorter = (np.full((len(stored), size), 8.0) if k == 0 else
                           self._shorter(stored & np.uint64((1 << (8 * k)) - 1)))
                seen = -np.log2(c / (total + distinct)[of_ctx])
            cost = np.where(c > 0, seen, escape[of_ctx] + shorter)
            self.bytes.append((Index(stored), cost.astype(np.float32)))
            self.contexts.append((Index(ctx), escape.astype(np.float32)))

    def _shorter(self, key: np.ndarray) -> np.ndarray:
        index, cost = self.bytes[-1]
        return cost[index.find(key)].astype(float)

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits by language of each byte of ``data`` after the first ORDER ones, which are context."""
        key = keys(data, ORDER)
        at = self.bytes[ORDER][0].find(key)
        out = self.bytes[ORDER][1][at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            left = np.zeros((len(todo), len(self.langs)), np.float32)
            rest = key[todo]
            done = np.zeros(len(todo), bool)
            for k in range(ORDER, -1, -1):
                live = np.flatnonzero(~done)
                if not len(live):
                    break
                if k < ORDER:
                    found = self.bytes[k][0].find(rest[live])
                    hit = found >= 0
                    left[live[hit]] += self.bytes[k][1][found[hit]]
                    done[live[hit]] = True
                    live = live[~hit]
                ctx = self.contexts[k][0].find(rest[live] >> np.uint64(8))
                left[live[ctx >= 0]] += self.contexts[k][1][ctx[ctx >= 0]]
                rest = rest & np.uint64((1 << (8 * k)) - 1) if k else rest
            left[~done] += 8.0
            out[todo] = left
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text by language."""
        out = np.zeros((len(texts), len(self.langs)))
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > CHUNK:
                for a in range(0, len(t), CHUNK):
                    piece = (_PAD + t[:CHUNK]) if a == 0 else t[a - ORDER:a + CHUNK]
                    out[i] += self.costs(np.frombuffer(piece, np.uint8)).sum(0, dtype=np.float64)
                continue
            batch.append(i)
            size += len(t)
            if size >= CHUNK:
                self._batch(texts, batch, out)
                batch, size = [], 0
        self._batch(texts, batch, out)
        return out

    def _batch(self, texts: list[bytes], batch: list[int], out: np.ndarray) -> None:
        if not batch:
            return
        data = np.frombuffer(b"".join(_PAD + texts[i] for i in batch), np.uint8)
        n = np.array([len(texts[i]) for i in batch])
        ends = np.cumsum(n + ORDER) - ORDER
        starts = ends - n
        sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.costs(data), 0, dtype=np.float64)))
        out[batch] = sums[ends] - sums[starts]


def train(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> Model:
    """Model of ``labelled`` (doc_id, lang, text); rows without lang or text teach nothing.

    The counts brought to the driver are those of the bounded sample."""
    rows = count_contexts(training_sample(labelled.dropna(subset=["lang", "text"]), docs, size)).toPandas()
    return Model((rows["lang"].tolist(), rows["k"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text), from the whole text alone.

    ``score`` is the language's share when every language is weighed by
    2^-(its code length). A null text, one without a letter, or a model without
    languages: ``und`` and 0. Equal code lengths: the first language by name. Repeated rows stay, an empty table gives no rows,
    further columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                known = [i for i, t in enumerate(texts) if m.langs and t and has_letter(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    bits = m.code_lengths([folded(texts[i]) for i in known])
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                        langs[i], scores[i] = m.langs[b], s
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for documents that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    model = train(docs.filter(~held_out()).select("doc_id", "lang", "text"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

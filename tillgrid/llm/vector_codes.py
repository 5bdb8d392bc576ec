"""Product codes of embedding vectors, nearest entries found by slices and intersected bitmasks.

Components become integers; a vector is cut into equal parts and each part is
replaced by the index of the nearest of 256 codebook entries. Codebooks start as
parts of the first vectors and are refined in rounds of assignment and averaging.

A part's nearest entry is found from the codebook's sorted coordinates: in each
dimension the entries within a radius of the part form one slice of the sorted order,
whose entry set is the difference of two prefix masks (bits in uint64 words). The AND over
the dimensions leaves the entries within the radius in every dimension, which include all entries
within it by Euclidean distance; those are compared exactly. A part whose best distance exceeds its radius asks again with
a larger one, so results never depend on the first radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components are held within this (a vector component of 131,072), so that no distance overflows a long.
MOST = 1 << 27
#: Parts compared at a time in a task.
CHUNK = 2048
DENSE_ROWS = 256
#: Rows of label totals up to which they are broadcast (under 10 MB); beyond, the join shuffles.
BROADCAST_LABELS = 200_000


def usable(vector: str = "embedding") -> Column:
    """Neither null nor empty, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & fine


def integers(values) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    return np.clip(np.floor(np.asarray(values, np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def part_bounds(size: int, parts: int = PARTS) -> list[int]:
    return [p * size // parts for p in range(parts + 1)]


def _sparse(cols: np.ndarray, entry_cols: np.ndarray, bits: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a candidate within their limit, the nearest one (ties: the lowest) and its squared distance; pair by pair."""
    row, entry = np.nonzero(bits)
    d2 = np.zeros(len(row), cols.dtype)
    for d in range(len(cols)):
        step = cols[d][row] - entry_cols[d][entry]
        d2 += step * step
    near = d2 <= limit[row]
    row, entry, d2 = row[near], entry[near], d2[near]
    if not len(row):
        return row, entry, d2
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(d2, starts)
    hit = np.flatnonzero(d2 == np.repeat(least, np.diff(np.append(starts, len(row)))))
    hit = hit[np.diff(row[hit], prepend=-1) > 0]  # entries ascend within a row: the first is the lowest
    return row[hit], entry[hit], d2[hit]


def _dense(cols: np.ndarray, entry_cols: np.ndarray, bits: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where candidates are many: blocks of rows against the entries, without listing pairs."""
    at, entry, d2 = [], [], []
    for lo in range(0, bits.shape[0], DENSE_ROWS):
        block = cols[:, lo:lo + DENSE_ROWS]
        far = np.zeros((block.shape[1], entry_cols.shape[1]), cols.dtype)
        for d in range(len(cols)):
            step = block[d][:, None] - entry_cols[d][None]
            step *= step
            far += step
        far[~bits[lo:lo + DENSE_ROWS]] = np.iinfo(cols.dtype).max
        first = far.argmin(1)
        least = far[np.arange(len(first)), first]
        ok = np.flatnonzero((least <= limit[lo:lo + DENSE_ROWS]) & bits[lo + np.arange(len(first)), first])
        at.append(ok + lo)
        entry.append(first[ok])
        d2.append(least[ok])
    return np.concatenate(at), np.concatenate(entry), np.concatenate(d2)


class Slices:
    """One codebook (entries x positions) under sorted coordinates with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, size = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        words = -(-k // 64)
        bits = np.zeros((k, words), np.uint64)
        bits[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        # prefix[d, i]: the entries of the i smallest coordinates in dimension d (sums of distinct bits).
        self.prefix = np.zeros((size, k + 1, words), np.uint64)
        for d in range(size):
            self.prefix[d, 1:] = np.cumsum(bits[order[:, d]], axis=0, dtype=np.uint64)
        self.radius = self._usual_radius()

    def _usual_radius(self) -> int:
        """First radius: three quarters of the median distance between an entry and its nearest other one."""
        k = len(self.entries)
        if k < 2:
            return 0
        e = self.entries.astype(np.float64)
        d2 = (e ** 2).sum(1)[:, None] + (e ** 2).sum(1)[None] - 2 * e @ e.T
        np.fill_diagonal(d2, np.inf)
        return int(0.75 * np.sqrt(max(0.0, float(np.median(d2.min(1))))))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries within each row's radius in every dimension."""
        masks = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for d in range(x.shape[1]):
            first = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            end = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.prefix[d][end] ^ self.prefix[d][first]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and the squared distance, row by row."""
        n, size = x.shape
        best, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not size:
            return best, error
        widest = int(max(np.abs(x).max(initial=0), np.abs(self.entries).max()))
        kind = np.int32 if widest < 1 << 12 and size <= 64 else np.int64  # both hold size * (2 * widest)^2
        cols, entry_cols = np.ascontiguousarray(x.T.astype(kind)), np.ascontiguousarray(self.entries.T.astype(kind))
        todo, radius, tries = np.arange(n), np.full(n, self.radius, np.int64), 0
        while len(todo):
            r = radius[todo]
            masks = self.candidates(x[todo], r)
            bits = np.unpackbits(masks.view(np.uint8).reshape(len(todo), -1), axis=1, bitorder="little", count=len(self.entries)).view(bool)
            limit = np.minimum(r * r, np.iinfo(kind).max).astype(kind)
            some = _dense if 8 * np.count_nonzero(bits) > bits.size else _sparse
            at, entry, d2 = some(cols[:, todo], entry_cols, bits, limit)
            best[todo[at]], error[todo[at]] = entry, d2
            left = np.ones(len(todo), bool)
            left[at] = False
            todo, tries = todo[left], tries + 1
            radius[todo] = radius[todo] * 8 // 5 + 1 if tries < 8 else 2 * widest * (int(size ** 0.5) + 1) + 1
        return best, error


def _books(vectors: DataFrame, parts: int, entries: int) -> tuple[int, list[np.ndarray]]:
    """Vector size and the first codebooks: parts of the ``entries`` smallest ids' vectors."""
    def first(rows: DataFrame) -> list:
        return rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # at most 256 rows
    got = first(vectors)
    size = len(got[0]["embedding"]) if got else 0
    if any(len(r["embedding"]) != size for r in got):
        got = first(vectors.filter(F.size("embedding") == size))
    x = integers([r["embedding"] for r in got]).reshape(len(got), size)
    at = part_bounds(size, parts)
    return size, [x[:, at[p]:at[p + 1]] for p in range(parts)]


def _matrix(column, size: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)


def _round(vectors: DataFrame, size: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one assignment of all vectors: each entry the mean of its parts, rounded down."""
    at = part_bounds(size, len(books))

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa
        slices = [Slices(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                x = _matrix(batch.column(0).slice(lo, CHUNK), size)
                for p, s in enumerate(slices):
                    part = x[:, at[p]:at[p + 1]]
                    code, _ = s.nearest(part)
                    count[p] += np.bincount(code, minlength=len(count[p]))
                    np.add.at(total[p], code, part)
        for p in range(len(books)):
            used, width = np.flatnonzero(count[p]), total[p].shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * width, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(total[p][used].ravel()),
                 pa.array(np.repeat(count[p][used], width))], ["part", "entry", "position", "total", "n"])

    rows = vectors.select("embedding").mapInArrow(sums, "part int, entry int, position int, total long, n long")
    # One row per codebook number reaches the driver: entries x vector size, whatever the table holds.
    means = rows.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = [b.copy() for b in books]
    for r in means:
        out[r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]
    return out


def _codes(vectors: DataFrame, size: int, books: list[np.ndarray]) -> DataFrame:
    at = part_bounds(size, len(books))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        slices = [Slices(b) for b in books]
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                x = _matrix(part.column(2), size)
                found = [s.nearest(x[:, at[p]:at[p + 1]]) for p, s in enumerate(slices)]
                code = np.stack([c for c, _ in found], 1).astype(np.uint8)
                text = [row.tobytes().hex() for row in code]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()),
                                                  pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(encode, "vec_id long, label long, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of every usable vector (written once), and the final codebooks.

    ``table`` has ``vec_id, embedding, label``; further columns are not read. Rows whose vector is null, empty or
    holds a null or non-finite component are dropped, as are vectors of another
    length than the smallest id's. Lengths that ``parts`` doesn't divide give parts of nearly equal
    length. Null ids come last in the choice of first entries; repeated ids are ordered by their vectors, and
    every row is coded. Ties go to the lower entry. An empty table gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code digit pair holds 1 to 256 entries")
    vectors = table.filter(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    size, books = _books(vectors, parts, entries)
    if not size:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    vectors = vectors.filter(F.size("embedding") == size)
    for _ in range(rounds):
        books = _round(vectors, size, books)
    return settle(_codes(vectors, size, books), "codes"), books


def report(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error over equal labels, nulls together), codebooks_sha256 of every usable vector."""
    codes, books = compress(table)
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    totals = settle(totals, "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return (codes.join(totals, F.col("label").eqNullSafe(F.col("_label")))
                 .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b[i]) * (x[i] - b[i])))"
    near = f"SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min({{'d': coalesce({square}, 0), 'e': e}}) AS m FROM piece JOIN BOOK USING (p) GROUP BY vec_id, p"
    out = r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, e, x AS b FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM piece) WHERE e < 256)"""
    for k in range(ROUNDS):
        out += f""",
near{k} AS MATERIALIZED ({near.replace('BOOK', f'book{k}')}),
mean{k} AS (
  SELECT p, e, list(s ORDER BY i) AS b FROM (
    SELECT p, m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS s FROM near{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, m.e, i)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.b, book{k}.b) AS b FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
    return out + f""",
last AS MATERIALIZED ({near.replace('BOOK', f'book{ROUNDS}')}),
code AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM last GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM code"""


SQL = _sql()

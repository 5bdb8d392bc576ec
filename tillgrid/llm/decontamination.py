"""Benchmark passages in documents, by Wu-Manber search over words.

Texts become words (A-Z lower-cased, runs of digits, a-z and characters beyond
ASCII). Every 13 consecutive words of a benchmark item are a pattern; an item
with fewer words is one shorter pattern. Patterns of one length m are searched
together. A block is two words: the shift table holds, for each block
occurring in a pattern, how far the search may move when it sees that block at
the window's end, and any other block moves it by m - 1 words. Blocks with shift 0
lead to a bucket of the patterns ending in them, those are narrowed by their
first block, and the rest are compared word by word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.llm.common import boxed, parts_for, unboxed

WINDOW = 13
#: Benchmark characters searched for in one pass; a larger benchmark takes several
#: passes over the documents, so a worker's tables stay within about 200 MB.
PASS_CHARS = 2 << 20

#: Of lower-cased UTF-8: the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Tables:
    """Shift and bucket tables of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], set[int]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = b" ".join(words[end - self.block:end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            last, first = b" ".join(words[-self.block:]), b" ".join(words[:self.block])
            self.buckets.setdefault(last, {}).setdefault(first, []).append((list(words), items))

    def find(self, words: list[bytes], spans: list[list[int]], items: set[int]) -> None:
        """Add the spans (first word, word after the last) and items of all occurrences."""
        m, b, far, shift, at, n = self.length, self.block, self.far, self.shift.get, self.length, len(words)
        while at <= n:
            block = words[at - 1] if b == 1 else words[at - 2] + b" " + words[at - 1]
            step = shift(block, far)
            if step:
                at += step
                continue
            start = at - m
            for pattern, found in self.buckets[block].get(b" ".join(words[start:start + b]), ()):
                if words[start:at] == pattern:
                    spans.append([start, at])
                    items |= found
            at += 1


def build(benchmark: Iterable[tuple[int, str]], window: int = WINDOW) -> list[Tables]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in benchmark:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(item)
    return [Tables(m, patterns) for m, patterns in sorted(by_length.items())]


def joined(spans: Iterable[list[int]]) -> list[list[int]]:
    """Sorted spans with touching and overlapping ones made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_tables: dict[str, list[Tables]] = {}


def _tables_of(key: str, sent) -> list[Tables]:
    """The tables of one pass, built once per Python worker."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = build(*sent.value)
    return _tables[key]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "hits",
           pass_chars: int = PASS_CHARS) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans of hit words, item ids found.

    Reads ``text`` of ``docs`` and ``item_id, text`` of ``benchmark``; a column
    already called ``out`` is replaced, all others pass through. A null text has
    no words, benchmark rows without text or id are no patterns, repeated rows
    change nothing, an empty benchmark hits nothing. No shuffle: each pass sends one block of
    the benchmark, of a checked size, to every task.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    passes = parts_for(items.agg(F.sum(F.length("text"))).first()[0] or 0, pass_chars)
    docs = docs.drop(out)
    text_at = docs.columns.index("text")
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField(out, HITS)])
    for k in range(passes):
        block = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(([tuple(r) for r in block.collect()], window))
        docs = docs.mapInArrow(_searcher(sent, uuid.uuid4().hex, text_at, out, k > 0), schema)
    return docs


def _searcher(sent, key: str, text_at: int, out: str, more: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
        tables = _tables_of(key, sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                before = part.columns[-1].to_pylist() if more else [{"spans": (), "items": ()}] * part.num_rows
                found = []
                for text, old in zip(part.column(text_at).to_pylist(), before, strict=True):
                    words, spans, items = words_of(text), list(old["spans"]), set(old["items"])
                    for t in tables:
                        t.find(words, spans, items)
                    found.append({"n_words": len(words), "spans": joined(spans), "items": sorted(items)})
                columns = (part.columns[:-1] if more else part.columns) + [pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, [*(part.schema.names[:-1] if more else part.schema.names), out])
    return run


def verdicts(hits: str = "hits") -> dict:
    """Columns of the contamination report from the struct column of ``search``."""
    n_hit = F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    names = F.sort_array(F.transform(f"{hits}.items", lambda i: i.cast("string")))
    return {
        "n_words": F.col(f"{hits}.n_words"), "n_hit": n_hit, "n_items": F.size(f"{hits}.items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", names), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= F.col(f"{hits}.n_words")),
    }


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    found = search(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", *[c.alias(n) for n, c in verdicts().items()])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = search(docs.select(boxed(docs).alias("row"), "text"), benchmark)
    return found.filter(~verdicts()["contaminated"]).select(*unboxed(docs, "row"))


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, w[i:i + least(13, len(w)) - 1] AS ws
  FROM item, unnest(range(1, greatest(len(w) - least(13, len(w)) + 2, 1))) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
place AS (
  SELECT k, i, m, w[i:i + m - 1] AS ws
  FROM doc, (SELECT DISTINCT m FROM pattern) AS l, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(i)),
hit AS (SELECT k, i, m, item_id FROM place JOIN pattern USING (m, ws)),
word AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT k, i, m FROM hit), unnest(range(m)) AS t(j) GROUP BY k),
found AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (k) LEFT JOIN found USING (k)
"""

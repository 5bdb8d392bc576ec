"""Token-id files: Parquet lists of ids in ascending document order.

Layout of a token table: one row per document with ``doc_id``, ``n_tokens``,
``file_no``, ``start_in_file`` (ids before it in its file) and ``tokens``
(list of 32-bit ids). The ids are dictionary-encoded (a vocabulary has far
fewer entries than a row group has ids), the numbers are delta-encoded; row
groups and pages have stated sizes and the column indexes Parquet writes with
them let a reader take the metadata alone, or only the pages of some documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillgrid.llm.common import parts_for, whole_text
from tillgrid.llm.tokens import BATCH, PartEncoder

#: Text bytes per file, row group and page sizes.
FILE_TEXT_BYTES = 32 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

ENCODED = "doc_id long, file_no int, start_in_file long, n_tokens long, tokens array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, form: str = "spaced",
                     file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Rows of a token table in ascending ``doc_id`` order, one partition per file.

    Reads ``doc_id`` and ``text`` only. A null text is empty: its document is the
    end id alone. Equal ``doc_id`` are ordered by a hash of their text, repeated rows stay and may lie in several files; null
    ids come first. An empty table gives an empty token table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "tie", "row"]  # the row's own number lets many equal rows spread over files
    ordered = (docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
                   .repartitionByRange(parts_for(total, file_text_bytes), *order)
                   .sortWithinPartitions(*order).select("doc_id", "text"))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        enc, file_no, start = PartEncoder.load(tokenizer, form), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids, n = enc.encode(part.column(1).to_pylist(), end_id)
                offsets = np.concatenate(([0], np.cumsum(n)))
                values = pa.array(ids.view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), file_no, np.int32)), pa.array(start + offsets[:-1]),
                     pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                    ["doc_id", "file_no", "start_in_file", "n_tokens", "tokens"])
                start += int(offsets[-1])

    return ordered.mapInArrow(encode, ENCODED)


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES,
                 page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write a token table: dictionary for the ids, delta for the numbers, page indexes."""
    (tokens.write
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start_in_file", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, without reading any id."""
    meta = spark.read.schema(ENCODED).parquet(path).select("doc_id", "file_no", "start_in_file", "n_tokens")
    return _with_start(meta)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The token table, or its documents with ``first <= doc_id <= last``: the
    bounds reach the scan, which skips row groups and pages by their indexes."""
    rows = spark.read.schema(ENCODED).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, file_no, start_in_file, n_tokens, ids_crc32 of token-table rows."""
    def digest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            ids = b.column(3)
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))
            crc = [zlib.crc32(values[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
            sizes = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sizes, pa.array(crc, pa.int64())],
                                             ["doc_id", "file_no", "start_in_file", "n_tokens", "ids_crc32"])

    return (tokens.select("doc_id", "file_no", "start_in_file", "tokens")
                  .mapInArrow(digest, "doc_id long, file_no int, start_in_file long, n_tokens long, ids_crc32 long"))


def _with_start(rows: DataFrame) -> DataFrame:
    # One row per file: a prefix sum over file totals, then one small join.
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return (rows.join(firsts, "file_no")
                .withColumn("start", F.col("_first") + F.col("start_in_file")).drop("_first", "start_in_file"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    File totals come from the metadata columns alone, so the ids are read once."""
    meta = spark.read.schema(ENCODED).parquet(path).select("file_no", "n_tokens")
    totals = meta.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return (digests(read_tokens(spark, path)).join(firsts, "file_no")
            .select("doc_id", (F.col("_first") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))

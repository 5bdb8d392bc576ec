"""Sum-of-squares best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import parts_for, settle, whole_text
from tillgrid.llm.tokens import BATCH, PartEncoder

CAPACITY = 2048
#: Pieces packed together by one task. A task leaves a few sequences part empty,
#: so the loss is a few sequences in about a hundred thousand.
PIECES_PER_TASK = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
                    form: str = "words") -> DataFrame:
    """doc_id, piece, start, length, ids: whole texts as ids plus the end id, cut at ``capacity``.

    Only documents longer than ``capacity`` are cut. ``ids`` are little-endian
    unsigned 32-bit. A null text is empty: one piece holding the end id. Repeated
    rows stay rows of their own; further columns are not read.
    """
    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        enc = PartEncoder.load(tokenizer, form)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows: list[tuple] = []
                ids, counts = enc.encode(part.column(1).to_pylist(), end_id)
                ends = np.cumsum(counts).tolist()
                for doc, end, n in zip(part.column(0).to_pylist(), ends, counts.tolist(), strict=True):
                    first = end - n
                    rows += [(doc, k, i, min(n - i, capacity), ids[first + i:first + min(n, i + capacity)].tobytes())
                             for k, i in enumerate(range(0, n, capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()),
                                                    strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return docs.mapInArrow(encode, PIECES)


def sum_of_squares(lengths, capacity: int):
    """Bin number and offset of each length, placed one after the other.

    Each goes where the sum over gaps of (open bins with that gap) squared
    becomes smallest: into a bin of gap ``g`` (one fewer of gap ``g``, one more
    of gap ``g - length``) or into a new bin. Equal sums: the smallest gap, and
    an open bin before a new one. Full bins count for nothing.
    """
    import numpy as np
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    none, made = np.int64(1) << 60, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            here = count[s:capacity]
            change = np.where(here > 0, 2 * (count[:capacity - s] - here) + 2, none)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            i = int(change.argmin())
            if change[i] <= best:
                gap = s + i
        if gap == capacity:
            bin_no, made = made, made + 1
        else:
            bin_no = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = bin_no, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(bin_no)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK,
         n_pieces: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added; any further columns pass through.

    Needs ``doc_id, piece, length`` with 1 <= length <= capacity, and a written table: every row gets a number of its own and is dealt
    out by it, so neither a long document, a hot source nor rows that share an id gather in one task;
    each task packs its pieces, about ``pieces_per_task``, from long to short. Offsets within a sequence are gapless from 0.
    """
    if n_pieces is None:
        n_pieces = pieces.count()
    parts = parts_for(n_pieces, pieces_per_task)
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    n_at = names.index("length")

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 36
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        bins, offsets = sum_of_squares(table.column(n_at).to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=50_000)

    row = "row" + "_" * max(map(len, names))  # no column of the table is called so
    dealt = pieces.withColumn(row, F.monotonically_increasing_id()).repartition(parts, F.xxhash64(row))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", row).select(*[F.col(f"`{c}`") for c in names]).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Texts are encoded once; what is dealt out for packing is one short row per
    piece. An empty table gives no rows.
    """
    pieces = tokenize_pieces(docs, tokenizer, end_id, capacity)
    plan = settle(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(plan, capacity)

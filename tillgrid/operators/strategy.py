"""Running totals and "last value so far" that hold up under skew.

A key, an hour or the whole table may hold a third of all rows, so no window
here is partitioned by a key alone. The input is evaluated once into a written
table, dealt by range over the full order into even slices, and each (key,
slice) is one window partition. What earlier slices carry into a slice comes
from their totals: at most one row per key and slice, and one key has no more of
them than there are slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillgrid.session import written


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], cheap: bool = False) -> DataFrame:
    """``df`` with ``_slice``: even ranges of (keys, order), numbered in that order.

    ``cheap``: ``df`` is little more than a scan of a written table, so it may be evaluated twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range exchange samples its input first; it samples the written table, not the plan behind it.
    dealt = (df if cheap else written(df, "rows")).repartitionByRange(parts, *keys, *order)
    return written(dealt.withColumn("_slice", F.spark_partition_id()), "slices")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, cheap: bool = False) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same key up to and including this one.

    ``order`` must be a total order within a key; ``cheap`` as for ``sliced``.
    """
    keys = list(keys)
    d = sliced(df, keys, order, cheap)
    w_in = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    w_prev = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
                            F.coalesce(F.sum("_total").over(w_prev), F.lit(0)).alias("_offset"))
    return (d.withColumn("_inner", F.sum(value).over(w_in)).join(offsets, _same(keys), "inner")
             .withColumn(out, F.col("_offset") + F.col("_inner")).select(*df.columns, out))


def running_max_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out`` = the largest non-NULL ``value`` among earlier rows of the same key."""
    return look_back(df, keys, order, tops={out: value})


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out`` = the last non-NULL ``value`` among earlier rows of the same key."""
    return look_back(df, keys, order, lasts={out: value})


def look_back(df: DataFrame, keys: Sequence[str], order: Sequence[str], lasts: dict[str, str] | None = None, tops: dict[str, str] | None = None,
              cheap: bool = False) -> DataFrame:
    """Columns over the earlier rows of the same key: the last non-NULL value of each of ``lasts`` and the largest of each of ``tops``
    (new column -> value column), from one dealing of the rows; ``cheap`` as for ``sliced``."""
    keys, order, lasts, tops = list(keys), list(order), lasts or {}, tops or {}
    d = sliced(df, keys, order, cheap)
    w_in = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    w_prev = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Last non-NULL value of each slice, then the latest of those before each slice.
    # max_by skips rows whose ordering is NULL, i.e. rows without a value.
    at = lambda value: F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order]))
    finals = d.groupBy(*keys, "_slice").agg(*[F.max_by(F.col(v), at(v)).alias(f"_f_{o}") for o, v in lasts.items()],
                                            *[F.max(v).alias(f"_f_{o}") for o, v in tops.items()])
    before = finals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
                           *[F.last(f"_f_{o}", ignorenulls=True).over(w_prev).alias(f"_b_{o}") for o in lasts],
                           *[F.max(f"_f_{o}").over(w_prev).alias(f"_b_{o}") for o in tops])
    inner = d.select("*", *[F.last(v, ignorenulls=True).over(w_in).alias(f"_i_{o}") for o, v in lasts.items()],
                     *[F.max(v).over(w_in).alias(f"_i_{o}") for o, v in tops.items()])
    return inner.join(before, _same(keys), "inner").select(
        *df.columns, *[F.coalesce(f"_i_{o}", f"_b_{o}").alias(o) for o in lasts], *[F.greatest(f"_i_{o}", f"_b_{o}").alias(o) for o in tops])


def _same(keys: Sequence[str]):
    """Join condition on the slice and the keys; NULL is a key like any other."""
    cond = F.col("_slice") == F.col("_s")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond

"""Helpers shared by the operators: table access, shared scratch tables, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrid.session import shared_dir

#: ASCII white space as the word contracts define it: blank and 0x09-0x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table every executor can read again, so a lost
    executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda may be inlined by the optimiser and then be
    computed for every element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boxed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, under names that don't depend on theirs."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])


def unboxed(docs: DataFrame, box: str, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from the struct column ``box``; ``changed`` ones from their new values."""
    return [changed.get(c, F.col(f"{box}.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def parts_for(total: int, per_part: int) -> int:
    return max(1, -(-int(total) // per_part))

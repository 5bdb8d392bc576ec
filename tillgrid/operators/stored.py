"""Catalogue tables stored in folders by a hash of the id, changed in place.

A batch reads and rewrites only the folders that its ids fall into; the others keep their
files. The number of folders stands in the partition column's name, so that a table
can't be read or changed under another. Every change is the same when it is run again, so a
batch that lost its driver half way is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.operators.ledger import accepted
from tillgrid.session import written

#: Folders of a table; more of them for a larger catalogue, so that one holds some 100 MB at most.
FOLDERS = 64


def _folder(folders: int) -> tuple[str, Column]:
    return f"part{folders}", F.pmod(F.xxhash64("id"), F.lit(folders)).cast("int")


def write_keyed(table: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """``table`` (with a column id) written anew to ``path``, in folders by a hash of the id; null ids share one."""
    name, place = _folder(folders)
    table.withColumn(name, place).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, folders: int = FOLDERS) -> DataFrame:
    """The table written by ``write_keyed``, with its folder in ``part<folders>``."""
    name, _ = _folder(folders)
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(path)
    other = [c for c in spark.read.parquet(path).columns if c.startswith("part") and c[4:].isdigit() and c != name]
    if other:
        raise ValueError(f"{path} is laid out by {other[0]}, not {name}")
    return df


def change_stored(spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame | None = None, gone: DataFrame | None = None, folders: int = FOLDERS) -> None:
    """Rows of ``rows`` replace those with the same id or are added; ids of ``gone`` are deleted.

    ``rows`` has at most one row an id; an id in both is deleted. Only the folders of these ids are read and
    rewritten. Ids in ``gone`` that the table lacks change nothing; null ids are not matched.
    """
    name, place = _folder(folders)
    new = None if rows is None else written(rows.filter("id IS NOT NULL").select(*schema.fieldNames()).withColumn(name, place), "rows")
    out = None if gone is None else written(gone.filter("id IS NOT NULL").select("id").distinct().withColumn(name, place), "gone")
    parts = [d.select("id", name) for d in (new, out) if d is not None]
    if not parts:
        return
    ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    touched = sorted(r[0] for r in ids.select(name).distinct().collect())  # at most ``folders`` numbers
    if not touched:
        return
    stored = read_keyed(spark, path, schema, folders).filter(F.col(name).isin(touched))
    after = stored.join(ids.select("id"), "id", "left_anti").select(*schema.fieldNames(), name)
    if new is not None:
        after = after.unionByName(new if out is None else new.join(out.select("id"), "id", "left_anti").select(*new.columns))
    after = written(after, "after")  # the folders are overwritten only when all their rows stand elsewhere
    filled = {r[0] for r in after.select(name).distinct().collect()}
    after.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    # Dynamic overwrite leaves a folder alone when no row goes there; one that lost its last row is removed.
    for k in (k for k in touched if k not in filled):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}={k}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def soft_delete_stored(ids: DataFrame, path: str, schema: T.StructType, folders: int = FOLDERS) -> None:
    """W10 in place: ``actif = 0`` for the given ids; unknown ids touch no row and no folder without a hit is rewritten."""
    spark, (name, place) = ids.sparkSession, _folder(folders)
    asked = ids.filter("id IS NOT NULL").select("id").distinct().withColumn(name, place)
    hit = read_keyed(spark, path, schema, folders).join(asked, ["id", name], "left_semi")
    change_stored(spark, path, schema, hit.withColumn("actif", F.lit(0).cast(schema["actif"].dataType)), folders=folders)


def delete_stored(ids: DataFrame, path: str, schema: T.StructType, folders: int = FOLDERS) -> None:
    """W12 in place: the rows of the given ids are deleted."""
    change_stored(ids.sparkSession, path, schema, gone=ids, folders=folders)


def apply_stored(decided: DataFrame, path: str, schema: T.StructType, folders: int = FOLDERS) -> None:
    """W9 and W13 in place: the last accepted change of an id replaces its row, inserts are added.

    ``decided`` as from ``upsert_products``, ``upsert_products_in_order`` or ``upsert_suppliers``.
    """
    change_stored(decided.sparkSession, path, schema, accepted(decided, schema.fieldNames()), folders=folders)

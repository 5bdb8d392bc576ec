"""Exports: sales CSV (S5), purchases CSV (S6), rows as JSON lines.

The CSV files follow Python's ``csv`` module defaults used by the source:
CRLF line ends, quotes doubled inside quoted fields, NULL written as an empty
field. The source exports the newest 2,000 rows (TakeOrderedAndProject, no global
sort, one file); ``n=None`` exports the whole table from many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.functions.scalars import ntz_text
from tillgrid.operators.filters import newest

EXPORT_ROWS = 2000  # Fixed value: rows per export.
NO_SUPPLIER = "-"

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
               "lineSep": "\r\n", "quoteAll": "false"}


def sales_export(sales: DataFrame, n: int | None = EXPORT_ROWS) -> DataFrame:
    """S5 as a DataFrame: newest ``n`` sales (None: all), NULL operator/reference -> empty text."""
    return newest(sales, "date_vente", n).select(
        "id", ntz_text("date_vente").alias("date_vente"), "statut", "paiement",
        F.coalesce(F.col("mobile_operateur"), F.lit("")).alias("operateur"),
        F.coalesce(F.col("mobile_reference"), F.lit("")).alias("reference"), "total", "monnaie")


def purchases_export(purchases: DataFrame, suppliers: DataFrame, n: int | None = EXPORT_ROWS) -> DataFrame:
    """S6 as a DataFrame: newest ``n`` purchases (None: all) with supplier name (``-`` when none)."""
    top = newest(purchases, "date_achat", n)
    f = suppliers.select(F.col("id").alias("_fid"), F.col("nom").alias("_fnom"))
    j = top.join(f, top.fournisseur_id == f._fid, "left")
    return j.select("id", ntz_text("date_achat").alias("date_achat"),
                    F.coalesce(F.col("_fnom"), F.lit(NO_SUPPLIER)).alias("fournisseur"),
                    F.coalesce(F.col("reference"), F.lit("")).alias("reference"), "total")


def number_text(c: Column) -> Column:
    """A decimal amount the way the source prints a float: ``12.0``, ``12345678.5``, never with an exponent."""
    return F.regexp_replace(c.cast("string"), "(\\.[0-9])0$", "$1")


def _printed(df: DataFrame) -> DataFrame:
    return df.select(*[(number_text(F.col(f.name)) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)).alias(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, order: list, n: int | None = EXPORT_ROWS) -> str:
    """Write ``df`` with the source's CSV conventions: one file for a bounded export, one
    file per task, in the order of their names, for a whole table."""
    out = df.orderBy(*order) if n is None else df.coalesce(1).sortWithinPartitions(*order)
    _printed(out).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def export_sales(sales: DataFrame, path: str | None = None, n: int | None = EXPORT_ROWS) -> DataFrame:
    df = sales_export(sales, n)
    if path:
        write_csv(df, path, [F.desc("date_vente"), F.desc("id")], n)
    return df


def export_purchases(purchases: DataFrame, suppliers: DataFrame, path: str | None = None,
                     n: int | None = EXPORT_ROWS) -> DataFrame:
    df = purchases_export(purchases, suppliers, n)
    if path:
        write_csv(df, path, [F.desc("date_achat"), F.desc("id")], n)
    return df


def rows_to_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Each row as one JSON object like the source's API gives it: NULL fields
    kept as ``null``, amounts as plain numbers, times as ``yyyy-MM-dd HH:mm:ss``."""
    def value(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return F.coalesce(number_text(c), F.lit("null"))
        if isinstance(f.dataType, T.TimestampNTZType):
            c = ntz_text(c)
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
        return F.substr(text, F.lit(6), F.length(text) - 6)

    fields = [F.concat(F.lit(f'"{f.name}":'), value(f)) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias(col))

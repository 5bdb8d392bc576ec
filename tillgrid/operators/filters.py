"""Projections, filters and predicates.

Date predicates are written on ``to_date(ts)``; on a TIMESTAMP_NTZ Parquet column
Catalyst turns them into a half-open range that reaches ``PushedFilters``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Dateish = dt.date | str


def _d(x: Dateish) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x).strip())


def active(df: DataFrame) -> DataFrame:
    """Rows with ``actif = 1``."""
    return df.filter(F.col("actif") == 1)


def categories(df: DataFrame) -> DataFrame:
    """All categories, all columns."""
    return df.select("id", "nom", "couleur")


def suppliers(df: DataFrame) -> DataFrame:
    """Active suppliers, by name (id breaks ties)."""
    return active(df).orderBy("nom", "id")


def valid_sales(df: DataFrame) -> DataFrame:
    """Sales with ``statut = 'validee'``."""
    return df.filter(F.col("statut") == "validee")


def _partition_range(df: DataFrame, ts: str, a: dt.date, b: dt.date):
    """Pruning predicate on the day/month partition column of a table written
    by ``write_shop`` (None when the table has none for this timestamp)."""
    from tillgrid.sources.schemas import DAY_PARTITIONED
    if ts not in DAY_PARTITIONED.values():
        return None
    if "jour" in df.columns:
        return F.col("jour").between(F.lit(a), F.lit(b))
    if "mois" in df.columns:
        return F.col("mois").between(F.lit(a.replace(day=1)), F.lit(b.replace(day=1)))
    return None


def on_day(df: DataFrame, ts: str, d: Dateish) -> DataFrame:
    """P5: rows whose timestamp falls on calendar day ``d``.

    On day/month-partitioned tables the same test on the partition column
    prunes folders.
    """
    return between_days(df, ts, d, d)


def between_days(df: DataFrame, ts: str, a: Dateish, b: Dateish) -> DataFrame:
    """Rows whose day is in [a, b], both ends included (an inverted range is empty)."""
    a, b = _d(a), _d(b)
    cond = F.to_date(F.col(ts)).between(F.lit(a), F.lit(b)) if a != b else (F.to_date(F.col(ts)) == F.lit(a))
    part = _partition_range(df, ts, a, b)
    if part is not None:
        cond = cond & part
    return df.filter(cond)


def optional_period(df: DataFrame, ts: str, a: Dateish | None = None, b: Dateish | None = None) -> DataFrame:
    """Filter by period only when both bounds are given; one bound alone is ignored."""
    if a and b and str(a).strip() and str(b).strip():
        return between_days(df, ts, a, b)
    return df


def resolve_period(kind: str, a: Dateish | None = None, b: Dateish | None = None,
                   as_of: Dateish | None = None) -> tuple[dt.date, dt.date]:
    """Default periods of the three reports (driver-side, no data touched).

    * ``journal``: start = as_of, end = start
    * ``owner``: end = as_of, start = as_of - 30 days (not end - 30)
    * ``daily``: the single day ``as_of``
    """
    today = _d(as_of) if as_of else dt.date.today()
    a = _d(a) if a and str(a).strip() else None
    b = _d(b) if b and str(b).strip() else None
    if kind == "journal":
        start = a or today
        return start, b or start
    if kind == "owner":
        return a or (today - dt.timedelta(days=30)), b or today
    if kind == "daily":
        d = a or today
        return d, d
    raise ValueError(f"unknown period kind {kind!r}")


def search(df: DataFrame, text: str | None, category: int | None = None, trim: bool = False) -> DataFrame:
    """Case-insensitive substring match on name or barcode (NULL barcode = '').

    Empty text matches everything. ``trim=True`` is the checkout variant that
    trims the typed text first.
    """
    t = (text or "")
    if trim:
        t = t.strip()
    t = t.lower()
    hit = (F.lower(F.col("nom")).contains(F.lit(t))
           | F.lower(F.coalesce(F.col("code_barres"), F.lit(""))).contains(F.lit(t)))
    if category not in (None, ""):
        hit = hit & (F.col("categorie_id") == F.lit(int(category)))
    return df.filter(hit)


def lookup(scans: DataFrame, products: DataFrame, code_col: str = "code") -> DataFrame:
    """P10: barcode scans -> product with outcome ``unknown`` / ``out_of_stock`` / ``ok``.

    Blank scans are dropped (nothing is looked up). The catalogue side is
    broadcast only when proven small, otherwise it is a shuffle join on the
    barcode.
    """
    s = (scans.withColumn("_code", F.regexp_replace(F.col(code_col), r"(?U)^\s+|\s+$", ""))
              .filter(F.col("_code") != ""))
    p = products.filter(F.col("code_barres").isNotNull()).select(
        F.col("code_barres").alias("_code"), F.col("id").alias("produit_id"),
        F.col("nom").alias("produit_nom"), F.col("stock").alias("produit_stock"))
    j = s.join(p, "_code", "left")
    outcome = (F.when(F.col("produit_id").isNull(), "unknown")
                .when(F.col("produit_stock") <= 0, "out_of_stock").otherwise("ok"))
    return j.withColumn("outcome", outcome).drop("_code")


def out_of_stock(df: DataFrame) -> DataFrame:
    """Active products with stock <= 0, by name."""
    return (active(df).filter(F.col("stock") <= 0)
            .select("id", "nom", "stock", "stock_alerte").orderBy("nom", "id"))


def low_stock(df: DataFrame) -> DataFrame:
    """Active products with 0 < stock <= stock_alerte, lowest stock first."""
    return (active(df).filter((F.col("stock") > 0) & (F.col("stock") <= F.col("stock_alerte")))
            .select("id", "nom", "stock", "stock_alerte").orderBy("stock", "id"))


def newest(df: DataFrame, ts: str, n: int | None) -> DataFrame:
    """Rows from the newest to the oldest; the first ``n``, or all of them when ``n`` is None."""
    ordered = df.orderBy(F.desc(ts), F.desc("id"))
    return ordered if n is None else ordered.limit(n)

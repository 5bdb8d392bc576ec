"""Reports: aggregations (A1-A22), top products per day (N1), recent sales (K1).

Every report works for all days/shops at once when its date argument is None.
Aggregates use partial (map-side) aggregation, so a hot group (one payment
type, one cashier) never ships its raw rows through the shuffle. Top-k reports
end in ``orderBy(...).limit(k)`` (TakeOrderedAndProject, no global sort) and
always carry a tie-break key as their last sort column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillgrid.functions.scalars import hour_text, stock_status
from tillgrid.operators.filters import Dateish, _d, active, between_days, newest, on_day, valid_sales
from tillgrid.operators.joins import sale_lines, with_cost

COVER_DAYS = 10  # Fixed value: days of sales a reorder should cover.
MOVER_DAYS = 7   # Fixed value: the fast-mover window and divisor.


def _midnight(d: dt.date):
    """Midnight of ``d`` as a TIMESTAMP_NTZ literal (built from text: no time zone involved)."""
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def _sum0(c: str, alias: str):
    return F.coalesce(F.sum(c), F.lit(0)).alias(alias)


def day_kpis(sales: DataFrame, d: Dateish) -> DataFrame:
    """A1: one row for day ``d``: number of valid sales and their total (0 when none)."""
    v = on_day(valid_sales(sales), "date_vente", d)
    return v.agg(F.count(F.lit(1)).alias("nb_ventes"), _sum0("total", "total_jour"))


def active_count(products: DataFrame) -> DataFrame:
    """A2: number of active products."""
    return active(products).agg(F.count(F.lit(1)).alias("nb_produits"))


def alert_count(products: DataFrame) -> DataFrame:
    """A3: active products at or below their alert level (stock-outs included)."""
    return (active(products).filter(F.col("stock") <= F.col("stock_alerte"))
            .agg(F.count(F.lit(1)).alias("alertes_stock")))


def daily_sales(sales: DataFrame, as_of: Dateish, days: int = MOVER_DAYS) -> DataFrame:
    """A4: valid sales per day since midnight of ``as_of - days``.

    As in the source: no upper bound, so up to ``days + 1`` calendar days
    (more if later-dated rows exist); days without sales are absent.
    """
    v = valid_sales(sales).filter(F.col("date_vente") >= _midnight(_d(as_of) - dt.timedelta(days=days)))
    return v.groupBy(F.to_date("date_vente").alias("jour")).agg(F.sum("total").alias("total")).orderBy("jour")


def daily_stats(sales: DataFrame, d: Dateish | None = None) -> DataFrame:
    """A5: per day: count, total, mobile total and cash total of valid sales.

    Other payment types count in the total but in neither split. ``d=None``
    gives every day in one pass; with a day it is always one row.
    """
    v = valid_sales(sales)
    aggs = [F.count(F.lit(1)).alias("nb_ventes"), _sum0("total", "total_jour"),
            F.coalesce(F.sum(F.when(F.col("paiement") == "mobile", F.col("total")).otherwise(F.lit(0))),
                       F.lit(0)).alias("total_mobile"),
            F.coalesce(F.sum(F.when(F.col("paiement") == "especes", F.col("total")).otherwise(F.lit(0))),
                       F.lit(0)).alias("total_especes")]
    if d is not None:
        return on_day(v, "date_vente", d).agg(*aggs).select(F.lit(_d(d)).alias("jour"), "*")
    return v.groupBy(F.to_date("date_vente").alias("jour")).agg(*aggs)


def operator_split(sales: DataFrame, d: Dateish | None = None) -> DataFrame:
    """Valid mobile sales by operator (missing operator -> ``inconnu``)."""
    v = valid_sales(sales).filter(F.col("paiement") == "mobile")
    op = F.coalesce(F.col("mobile_operateur"), F.lit("inconnu")).alias("operateur")
    aggs = [F.count(F.lit(1)).alias("nb"), _sum0("total", "total")]
    if d is not None:
        return on_day(v, "date_vente", d).groupBy(op).agg(*aggs)
    return v.groupBy(F.to_date("date_vente").alias("jour"), op).agg(*aggs)


def sales_detail(sales: DataFrame, items: DataFrame, d: Dateish | None = None) -> DataFrame:
    """Valid sales with their number of units (0 for a sale without lines), newest first.

    Lines are summed per sale before the join (one row per sale crosses the shuffle).
    """
    v = valid_sales(sales)
    if d is not None:
        v = on_day(v, "date_vente", d)
    units = items.groupBy("vente_id").agg(F.sum("quantite").alias("_units"))
    j = v.join(units, v.id == units.vente_id, "left")
    out = j.select("id", "total", "paiement", "mobile_operateur", "mobile_reference", "monnaie", "date_vente",
                   F.coalesce(F.col("_units"), F.lit(0)).cast("long").alias("total_articles"))
    return out.orderBy(F.desc("date_vente"), F.desc("id"))


def _product_totals(lines: DataFrame, *keys) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum("quantite").cast("long").alias("quantite"),
                                    F.sum("sous_total").alias("montant"))


def top_products(items: DataFrame, sales: DataFrame, d: Dateish, n: int = 5) -> DataFrame:
    """The day's products by units sold (grouped by the name on the line), top ``n``."""
    lines = on_day(sale_lines(items, sales), "date_vente", d)
    return (_product_totals(lines, "nom_produit")
            .orderBy(F.desc("quantite"), F.asc("nom_produit")).limit(n))


def top_products_per_day(items: DataFrame, sales: DataFrame, n: int = 5) -> DataFrame:
    """A8 for every day in one job, with ``rang`` 1..n per day."""
    lines = sale_lines(items, sales).withColumn("jour", F.to_date("date_vente"))
    totals = _product_totals(lines, "jour", "nom_produit")
    # The engine ranks inside every task first and shuffles at most n rows of a day from each.
    rank = F.row_number().over(Window.partitionBy("jour").orderBy(F.desc("quantite"), F.asc("nom_produit")))
    return totals.withColumn("rang", rank).filter(F.col("rang") <= n)


def revenue(sales: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """Total of valid sales in [a, b]."""
    return between_days(valid_sales(sales), "date_vente", a, b).agg(_sum0("total", "ca"))


def expenses_total(expenses: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """A10: total expenses in [a, b]."""
    return between_days(expenses, "date_depense", a, b).agg(_sum0("montant", "depenses"))


def purchases_total(purchases: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """Total purchases in [a, b]."""
    return between_days(purchases, "date_achat", a, b).agg(_sum0("total", "achats"))


def payment_mix(sales: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """Valid sales of [a, b] by payment type (third types included)."""
    v = between_days(valid_sales(sales), "date_vente", a, b)
    return v.groupBy("paiement").agg(F.count(F.lit(1)).alias("nb"), _sum0("total", "total"))


def by_cashier(events: DataFrame, users: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """Journal sale rows of [a, b] by user id: count and amount, largest first.

    Later-cancelled sales still count (the journal keeps their sale row); a NULL
    user is one group and two users with one name stay separate. Aggregated
    first, then the (small, checked) users dimension is joined to the groups.
    """
    e = between_days(events.filter(F.col("evenement") == "vente"), "created_at", a, b)
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("nb"), _sum0("montant", "total"))
    u = users.select(F.col("id").alias("_uid"), F.col("nom").alias("caissier"))
    out = g.join(u, g.user_id == u._uid, "left").select("user_id", "caissier", "nb", "total")
    return out.orderBy(F.desc("total"), F.asc_nulls_first("user_id"))


def peak_hours(sales: DataFrame, a: Dateish, b: Dateish, n: int = 5) -> DataFrame:
    """Valid sales of [a, b] by two-digit hour; the ``n`` busiest hours."""
    v = between_days(valid_sales(sales), "date_vente", a, b)
    g = v.groupBy(hour_text("date_vente").alias("heure")).agg(F.count(F.lit(1)).alias("nb"))
    return g.orderBy(F.desc("nb"), F.asc("heure")).limit(n)


def top_profitable(items: DataFrame, sales: DataFrame, purchase_items: DataFrame, a: Dateish, b: Dateish,
                   n: int = 8) -> DataFrame:
    """Products of [a, b] by estimated margin, top ``n``.

    margin = round(sum(sous_total - unit_cost * quantite), 2) with unit_cost the
    all-time mean purchase price of the product (A15) or 0.7 x the sale price.
    All arithmetic is decimal, so the result does not depend on summation order.
    """
    lines = between_days(sale_lines(items, sales), "date_vente", a, b)
    costed = with_cost(lines, purchase_items)
    margin = F.col("sous_total") - F.col("cout_unitaire") * F.col("quantite")
    g = costed.groupBy("nom_produit").agg(
        F.sum("quantite").cast("long").alias("quantite"),
        F.sum("sous_total").alias("chiffre"),
        F.round(F.sum(margin), 2).alias("marge_estimee"))
    return g.orderBy(F.desc("marge_estimee"), F.asc("nom_produit")).limit(n)


def owner_kpis(sales: DataFrame, expenses: DataFrame, purchases: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """One row: revenue, expenses, purchases and net = revenue - expenses - purchases.

    The three sources are stacked as (kind, amount) rows and folded by one
    global aggregate - no join between one-row results.
    """
    parts = (between_days(valid_sales(sales), "date_vente", a, b).select(F.lit("ca").alias("k"), F.col("total").alias("m"))
             .unionByName(between_days(expenses, "date_depense", a, b)
                          .select(F.lit("depenses").alias("k"), F.col("montant").alias("m")))
             .unionByName(between_days(purchases, "date_achat", a, b)
                          .select(F.lit("achats").alias("k"), F.col("total").alias("m"))))

    def part(k):
        return F.coalesce(F.sum(F.when(F.col("k") == k, F.col("m"))), F.lit(0))

    return parts.agg(part("ca").alias("ca"), part("depenses").alias("depenses"), part("achats").alias("achats"),
                     (part("ca") - part("depenses") - part("achats")).alias("benefice_net"))


def _movers(products: DataFrame, units: DataFrame, n: int) -> DataFrame:
    p = active(products).select("id", "nom", "stock", "stock_alerte")
    j = p.join(units, p.id == units.produit_id, "inner")
    out = j.select("id", "nom", "stock", "stock_alerte", F.col("_units").cast("long").alias("qte_7j"),
                   F.round(F.col("_units").cast("decimal(20,0)") / F.lit(MOVER_DAYS), 2).alias("moyenne_jour"))
    return out.filter(F.col("qte_7j") > 0).orderBy(F.desc("qte_7j"), F.asc("id")).limit(n)


def fast_movers(products: DataFrame, items: DataFrame, sales: DataFrame, as_of: Dateish,
                mode: str = "as_written", n: int = 12) -> DataFrame:
    """Active products ranked by units sold, top ``n``.

    ``as_written`` (A18) reproduces the source query, whose sale-status and
    7-day tests sit in the ON clause of the last left join while the sum runs
    over the lines: every line ever recorded counts, cancelled or not.
    ``strict`` (A19) counts only valid sales since midnight of ``as_of - 7``.
    Lines are summed per product before meeting the catalogue.
    """
    if mode == "as_written":
        lines = items
    elif mode == "strict":
        since = _midnight(_d(as_of) - dt.timedelta(days=MOVER_DAYS))
        lines = sale_lines(items, sales).filter(F.col("date_vente") >= since)
    else:
        raise ValueError(mode)
    units = lines.groupBy("produit_id").agg(F.sum("quantite").alias("_units"))
    return _movers(products, units, n)


def suggest(fast: DataFrame, cover_days: int = COVER_DAYS) -> DataFrame:
    """Reorder suggestions over the fast movers.

    target = round-half-even(moyenne_jour x cover_days) on the double value,
    order = max(0, target - stock); only positive orders are kept.
    """
    target = F.rint(F.col("moyenne_jour").cast("double") * F.lit(float(cover_days))).cast("long")
    return (fast.withColumn("stock_cible", target)
                .withColumn("a_commander", F.greatest(F.lit(0).cast("long"), F.col("stock_cible") - F.col("stock")))
                .filter(F.col("a_commander") > 0)
                .select("id", "nom", "stock", "moyenne_jour", "stock_cible", "a_commander"))


def status_counts(products: DataFrame) -> DataFrame:
    """Active products per stock status (Rupture / Stock bas / Stock OK)."""
    return (active(products).groupBy(stock_status("stock", "stock_alerte").alias("statut"))
            .agg(F.count(F.lit(1)).alias("nb")))


def counts(cats: DataFrame, products: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: number of categories, active products and sales (all statuses).

    Stacked and folded by one global aggregate, like A17.
    """
    parts = (cats.select(F.lit(1).alias("k"))
             .unionByName(active(products).select(F.lit(2).alias("k")))
             .unionByName(sales.select(F.lit(3).alias("k"))))

    def n(k):
        return F.count(F.when(F.col("k") == k, F.lit(1)))

    return parts.agg(n(1).alias("categories"), n(2).alias("produits"), n(3).alias("ventes"))


def recent_sales(sales: DataFrame, n: int | None = 100) -> DataFrame:
    """K1: the ``n`` newest sales of any status (None: all)."""
    return newest(sales, "date_vente", n)

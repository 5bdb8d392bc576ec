"""Joins (J1-J8).

Foreign keys are not enforced in the source system, so lookups are left joins
and dangling ids simply give NULL names. Small dimensions (users, categories)
are broadcast after a size check; child rows are aggregated by parent id before
they meet the parent (the parent id is unique, so the result is the same and
the shuffle carries one row per parent instead of one per line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.operators.filters import Dateish, active, between_days, newest, optional_period, valid_sales

COST_FALLBACK = 0.7  # Fixed value: share of the sale price assumed as cost when no purchase is known.


def catalog(products: DataFrame, cats: DataFrame) -> DataFrame:
    """Active products with their category name (NULL when missing or dangling)."""
    c = cats.select(F.col("id").alias("_cid"), F.col("nom").alias("categorie_nom"))
    p = active(products)
    return p.join(c, p.categorie_id == c._cid, "left").drop("_cid")


def journal(events: DataFrame, users: DataFrame, a: Dateish, b: Dateish) -> DataFrame:
    """Cash journal rows of [a, b] with the user's name, newest first."""
    u = users.select(F.col("id").alias("_uid"), F.col("nom").alias("utilisateur"))
    e = between_days(events, "created_at", a, b)
    out = e.join(u, e.user_id == u._uid, "left").select(
        "id", "type", "evenement", "vente_id", "montant", "paiement", "operateur", "reference",
        "details", "created_at", "utilisateur")
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def receipts(sales: DataFrame, items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Receipt rows: the sale header (7 columns) repeated on each of its lines.

    Flat form: one row per line, ``ligne_id`` orders the lines; a sale without
    lines gives one row with NULL line columns. Cancelled sales are included.
    ``ids`` (a DataFrame with column ``id``) restricts to some sales via a semi join.
    """
    h = sales.select("id", "total", "paiement", "mobile_operateur", "mobile_reference", "monnaie", "date_vente")
    if ids is not None:
        h = h.join(ids.select("id").distinct(), "id", "left_semi")
    li = items.select(F.col("vente_id").alias("id"), F.col("id").alias("ligne_id"), "nom_produit",
                      "prix_unitaire", "quantite", "sous_total")
    return h.join(li, "id", "left")


def nested_receipts(sales: DataFrame, items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """J3 as documents: one row per sale, ``lignes`` an array of line structs by id (empty without lines).

    A receipt is one sale, so its lines are few; they are put together by the sale's id alone and the header joins them once.
    """
    h = sales.select("id", "total", "paiement", "mobile_operateur", "mobile_reference", "monnaie", "date_vente")
    li = items
    if ids is not None:
        h = h.join(ids.select("id").distinct(), "id", "left_semi")
        li = li.join(ids.select(F.col("id").alias("vente_id")).distinct(), "vente_id", "left_semi")
    line = F.struct(F.col("id").alias("ligne_id"), "nom_produit", "prix_unitaire", "quantite", "sous_total")
    lists = li.groupBy(F.col("vente_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lignes"))
    return h.join(lists, "id", "left").withColumn("lignes", F.coalesce("lignes", F.array().cast(lists.schema["lignes"].dataType)))


def receipt_lines(receipts: DataFrame) -> DataFrame:
    """The flat rows of nested receipts: what ``receipts`` gives."""
    return receipts.select(*[c for c in receipts.columns if c != "lignes"], F.explode_outer("lignes").alias("l")).select("*", "l.*").drop("l")


def purchase_history(purchases: DataFrame, suppliers_df: DataFrame, users: DataFrame, lines: DataFrame,
                     a: Dateish | None = None, b: Dateish | None = None, n: int | None = 200) -> DataFrame:
    """Purchases with supplier name, user name and units bought; newest ``n`` (None: all).

    The period applies only when both bounds are given (P7).
    """
    p = optional_period(purchases, "date_achat", a, b)
    units = lines.groupBy("achat_id").agg(F.sum("quantite").alias("_units"))
    f = suppliers_df.select(F.col("id").alias("_fid"), F.col("nom").alias("fournisseur_nom"))
    u = users.select(F.col("id").alias("_uid"), F.col("nom").alias("utilisateur_nom"))
    j = p.join(f, p.fournisseur_id == f._fid, "left")
    j = j.join(u, j.user_id == u._uid, "left")
    j = j.join(units, j.id == units.achat_id, "left")
    out = j.select(*[F.col(c) for c in purchases.columns], "fournisseur_nom", "utilisateur_nom",
                   F.coalesce(F.col("_units"), F.lit(0)).cast("long").alias("total_articles"))
    return newest(out, "date_achat", n)


def expense_history(expenses: DataFrame, users: DataFrame, a: Dateish | None = None,
                    b: Dateish | None = None, n: int | None = 200) -> DataFrame:
    """Expenses with the user's name; period only with both bounds; newest ``n`` (None: all)."""
    d = optional_period(expenses, "date_depense", a, b)
    u = users.select(F.col("id").alias("_uid"), F.col("nom").alias("utilisateur_nom"))
    out = d.join(u, d.user_id == u._uid, "left").drop("_uid")
    return newest(out, "date_depense", n)


def sale_lines(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Lines of valid sales with the sale time - the fact behind the product reports.

    Sales are filtered before the join; the join is a shuffle on ``vente_id``
    (AQE splits a sale or product that dominates a partition). Tables written
    by day or month join on that column too, so a later filter on it prunes both.
    """
    by = [c for c in ("jour", "mois") if c in items.columns and c in sales.columns]
    v = valid_sales(sales).select(F.col("id").alias("vente_id"), "date_vente", *by)
    return items.join(v, ["vente_id", *by], "inner")


def avg_cost(purchase_items: DataFrame) -> DataFrame:
    """Mean purchase price per product, not weighted by quantity, all-time.

    ``avg`` on decimal(18,2) gives decimal(22,6), rounded half up.
    """
    return purchase_items.groupBy("produit_id").agg(F.avg("prix_achat").alias("cout_moyen"))


def with_cost(lines: DataFrame, purchase_items: DataFrame, fallback: float = COST_FALLBACK) -> DataFrame:
    """Lines with their product's mean cost; a line without one (or without
    a product) costs ``fallback`` x its unit price."""
    c = avg_cost(purchase_items).withColumnRenamed("produit_id", "_pid")
    j = lines.join(c, lines.produit_id == c._pid, "left").drop("_pid")
    fb = F.col("prix_unitaire") * F.lit(fallback).cast("decimal(3,2)")
    return j.withColumn("cout_unitaire", F.coalesce(F.col("cout_moyen"), fb))


def known_active(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Mark purchase lines whose product exists and is active (``produit_ok``).

    One left join against the active ids (deduplicated) replaces a semi join
    plus an anti join over the same lines.
    """
    ok = active(products).select(F.col("id").alias("_pid")).distinct().withColumn("_hit", F.lit(True))
    j = lines.join(ok, lines.produit_id == ok._pid, "left")
    return j.withColumn("produit_ok", F.coalesce(F.col("_hit"), F.lit(False))).drop("_pid", "_hit")

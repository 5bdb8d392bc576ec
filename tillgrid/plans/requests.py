"""Request batches for the write rules, derived from the shop views.

Every batch covers the whole source table (one request per sale, purchase,
expense, product or supplier); ``id % n`` expressions only *perturb* values so
each reject path is exercised: padded/upper-case or unknown operators, blank
references and reasons, zero quantities and prices, unknown and inactive
products, duplicate and unknown ids, broken JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.sources.fixtures import ShopFixture

UNKNOWN_OFFSET = 1_000_000_000
AGAIN = 1_000_000_000  # added to a request_seq: the second change of the same row


def sale_payloads(fx: ShopFixture) -> DataFrame:
    """One JSON checkout payload per sale (its lines ordered by line id)."""
    v, items = fx["ventes"], fx["vente_items"]
    lines = items.groupBy("vente_id").agg(F.sort_array(F.collect_list(F.struct(
        "id", "produit_id", "nom_produit", "prix_unitaire", "quantite", "sous_total"))).alias("_lines"))
    j = v.join(lines, v.id == lines.vente_id, "left")
    k, op = F.col("id"), F.col("mobile_operateur")
    op_sent = (F.when(k % 10 == 1, F.concat(F.lit(" "), F.upper(op), F.lit(" ")))
                .when(k % 10 == 2, F.lit("wave")).otherwise(op))
    ref_sent = F.when(k % 10 == 3, F.lit("   ")).otherwise(F.col("mobile_reference"))
    item = lambda x: F.struct(x["produit_id"].alias("produit_id"), x["nom_produit"].alias("nom_produit"),
                              x["prix_unitaire"].cast("double").alias("prix_unitaire"),
                              x["quantite"].alias("quantite"), x["sous_total"].cast("double").alias("sous_total"))
    doc = F.to_json(F.struct(
        k.alias("request_id"), F.col("total").cast("double").alias("total"), "paiement",
        F.col("monnaie").cast("double").alias("monnaie"), op_sent.alias("mobile_operateur"),
        ref_sent.alias("mobile_reference"), "user_id", F.col("date_vente").alias("recu_le"),
        F.coalesce(F.transform("_lines", item), F.array()).alias("items")))
    broken = F.expr("substring(_doc, 1, length(_doc) - 5)")
    return (j.select(k.alias("source_id"), doc.alias("_doc"))
             .select("source_id", F.when(F.col("source_id") % 50 == 7, broken).otherwise(F.col("_doc"))
                     .alias("payload")))


def cart_batches(fx: ShopFixture) -> tuple[DataFrame, DataFrame]:
    """Checkout carts: the lines of every sale, and a payment whose received
    amount is 0 (exact) when no change was given, else the sale's total."""
    lines = fx["vente_items"].select(F.col("vente_id").alias("cart_id"), "prix_unitaire", "quantite")
    pay = fx["ventes"].select(F.col("id").alias("cart_id"), "paiement",
                              F.when(F.col("monnaie") == 0, F.lit(0)).otherwise(F.col("total")).alias("recu"))
    return lines, pay


def cancel_requests(fx: ShopFixture) -> DataFrame:
    """One request per sale, a second one for every 7th sale, unknown ids for every 13th."""
    v = fx["ventes"]
    k = F.col("id")
    after = F.col("date_vente") + F.make_dt_interval(F.lit(2))
    base = v.select((k * 4).alias("request_seq"), k.alias("vente_id"),
                    F.when(k % 5 == 0, F.lit("  ")).otherwise(F.lit("erreur caisse")).alias("motif"),
                    "user_id", after.alias("recu_le"))
    again = v.filter(k % 7 == 0).select((k * 4 + 1).alias("request_seq"), k.alias("vente_id"),
                                        F.lit("doublon").alias("motif"), "user_id", after.alias("recu_le"))
    unknown = v.filter(k % 13 == 0).select((k * 4 + 2).alias("request_seq"), (-k).alias("vente_id"),
                                           F.lit("inconnue").alias("motif"), "user_id", after.alias("recu_le"))
    return base.unionByName(again).unionByName(unknown)


def purchase_batches(fx: ShopFixture) -> tuple[DataFrame, DataFrame]:
    """Purchase headers (every purchase, plus line-less copies of every 11th)
    and their lines with zero quantities, zero prices and unknown products mixed in."""
    a, li = fx["achats"], fx["achat_items"]
    hcols = ["fournisseur_id", "reference", "notes", "user_id", F.col("date_achat").alias("recu_le")]
    headers = (a.select(F.col("id").alias("request_id"), *hcols)
                .unionByName(a.filter((F.col("id") % 11 == 0) & (F.col("id") != 0)).select((-F.col("id")).alias("request_id"), *hcols)))
    k = F.col("id")
    lines = li.select(
        F.col("achat_id").alias("request_id"), (k - F.col("achat_id") * 1000 - 1).cast("int").alias("pos"),
        F.when(k % 23 == 0, F.col("produit_id") + UNKNOWN_OFFSET).otherwise(F.col("produit_id")).alias("produit_id"),
        F.when(k % 17 == 0, F.lit(0)).otherwise(F.col("quantite")).cast("double").alias("quantite"),
        F.when(k % 19 == 0, F.lit(0)).otherwise(F.col("prix_achat")).cast("double").alias("prix_achat"))
    return headers, lines


def purchase_payloads(fx: ShopFixture) -> DataFrame:
    """One JSON purchase request per header of ``purchase_batches``; every other
    line sends its numbers as text, every 13th purchase is broken JSON."""
    headers, lines = purchase_batches(fx)
    text = F.col("pos") % 2 == 0
    item = F.when(text, F.to_json(F.struct(F.col("produit_id").cast("string").alias("produit_id"), F.col("quantite").cast("int").cast("string").alias("quantite"),
                                           F.format_string(" %s ", F.col("prix_achat")).alias("prix_achat")))
                  ).otherwise(F.to_json(F.struct("produit_id", "quantite", "prix_achat")))
    items = lines.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))).alias("_items"))
    j = headers.join(items, "request_id", "left")
    head = F.to_json(F.struct("request_id", "fournisseur_id", "reference", "notes", "user_id", "recu_le"))
    body = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"items":['),
                    F.coalesce(F.array_join(F.transform("_items", lambda x: x["i"]), ","), F.lit("")), F.lit("]}"))
    doc = F.when(F.col("request_id") % 13 == 0, F.substr(body, F.lit(1), F.length(body) - 4)).otherwise(body)
    return j.withColumn("_head", head).select(F.col("request_id").alias("source_id"), doc.alias("payload"))


def expense_requests(fx: ShopFixture) -> DataFrame:
    d = fx["depenses"]
    k = F.col("id")
    return d.select(
        k.alias("request_id"),
        F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("libelle"))).alias("libelle"),
        F.when(k % 7 == 0, F.lit(0)).when(k % 11 == 0, -F.col("montant")).otherwise(F.col("montant"))
         .cast("double").alias("montant"),
        F.when(k % 5 == 0, F.lit("  ")).otherwise(F.col("categorie")).alias("categorie"),
        F.lit(None).cast("string").alias("notes"), "user_id", F.col("date_depense").alias("recu_le"))


def product_changes(fx: ShopFixture) -> DataFrame:
    """An update per product (some without stock keys, some without a barcode
    key, some with an explicit NULL barcode or a neighbour's barcode, some for
    unknown ids) plus an insert for every 31st product."""
    p = fx["produits"]
    k = F.col("id")
    no_stock = k % 3 == 0
    neighbour = F.concat(F.lit("618"), F.lpad((k + 1).cast("string"), 10, "0"))
    upd = p.select(
        (k * 2).alias("request_seq"),
        F.when(k % 29 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("id"),
        F.concat(F.col("nom"), F.lit(" v2")).alias("nom"), F.col("prix").alias("prix"),
        F.when(no_stock, F.lit(None)).otherwise(F.col("stock") + 1).cast("int").alias("stock"),
        F.when(no_stock, F.lit(None)).otherwise(F.col("stock_alerte")).cast("int").alias("stock_alerte"),
        F.when(no_stock, F.lit(None)).otherwise(F.col("categorie_id")).cast("long").alias("categorie_id"),
        F.when(k % 4 == 2, neighbour).when(k % 4 == 3, F.col("code_barres")).otherwise(F.lit(None))
         .cast("string").alias("code_barres"),
        (k % 4 != 0).alias("has_code_barres"))
    ins = p.filter(k % 31 == 0).select(
        (k * 2 + 1).alias("request_seq"), F.lit(None).cast("long").alias("id"),
        F.concat(F.col("nom"), F.lit(" bis")).alias("nom"), F.col("prix"),
        F.lit(None).cast("int").alias("stock"), F.lit(None).cast("int").alias("stock_alerte"),
        F.lit(None).cast("long").alias("categorie_id"),
        F.concat(F.lit(" 999"), k.cast("string"), F.lit(" ")).alias("code_barres"), F.lit(True).alias("has_code_barres"))
    # A second change of every 5th product: the same barcode keys, a new name.
    again = upd.filter((F.col("request_seq") / 2) % 5 == 0).withColumns(
        {"request_seq": F.col("request_seq") + AGAIN, "nom": F.concat(F.col("nom"), F.lit(" v3"))})
    return upd.unionByName(ins).unionByName(again)


def supplier_changes(fx: ShopFixture) -> DataFrame:
    f = fx["fournisseurs"]
    k = F.col("id")
    upd = f.select(
        (k * 2).alias("request_seq"), F.when(k % 10 == 0, k + UNKNOWN_OFFSET).otherwise(k).alias("id"),
        F.when(k % 6 == 0, F.lit("  ")).otherwise(F.concat(F.col("nom"), F.lit(" "))).alias("nom"),
        F.concat(F.lit(" c"), k.cast("string"), F.lit(" ")).alias("contact"), F.lit("").alias("telephone"),
        F.lit(None).cast("string").alias("email"), F.lit(" Abidjan ").alias("adresse"),
        F.lit(None).cast("timestamp_ntz").alias("recu_le"))
    ins = f.filter(k % 9 == 0).select(
        (k * 2 + 1).alias("request_seq"), F.lit(None).cast("long").alias("id"),
        F.concat(F.col("nom"), F.lit(" bis")).alias("nom"), F.lit(None).cast("string").alias("contact"),
        F.lit(None).cast("string").alias("telephone"), F.lit("x@y.z").alias("email"),
        F.lit(None).cast("string").alias("adresse"),
        F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("recu_le"))
    again = upd.filter((F.col("request_seq") / 2) % 7 == 0).withColumns(
        {"request_seq": F.col("request_seq") + AGAIN, "contact": F.lit(" second ")})
    return upd.unionByName(ins).unionByName(again)


def catalogue_rows(fx: ShopFixture) -> DataFrame:
    """Catalogue rows to insert if absent: the existing names for even part keys,
    a brand variant (duplicated across parts) for odd ones."""
    part = fx.raw("part")
    k = F.col("p_partkey")
    return part.select(k.alias("request_seq"),
                       F.when(k % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
                        .alias("nom"),
                       F.col("p_retailprice").cast("decimal(18,2)").alias("prix"))


def new_categories(fx: ShopFixture) -> DataFrame:
    """One category per part brand (sequence = the brand's smallest part key)."""
    return (fx.raw("part").groupBy("p_brand").agg(F.min("p_partkey").alias("request_seq"))
            .select("request_seq", F.col("p_brand").alias("nom"), F.lit(None).cast("string").alias("couleur")))


def restock_requests(fx: ShopFixture) -> DataFrame:
    return fx.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
                     F.col("l_partkey").alias("produit_id"),
                     (F.col("l_quantity") - 25).alias("quantite"), F.col("l_shipdate").alias("recu_le"))


def barcode_scans(fx: ShopFixture) -> DataFrame:
    """Every product barcode as a scan (padded for every 5th), plus an unknown code per 9th product."""
    p = fx["produits"]
    k = F.col("id")
    known = p.filter(F.col("code_barres").isNotNull()).select(
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.col("code_barres"), F.lit(" "))).otherwise(F.col("code_barres"))
         .alias("code"))
    unknown = p.filter(k % 9 == 0).select(F.concat(F.lit("999"), k.cast("string")).alias("code"))
    return known.unionByName(unknown)

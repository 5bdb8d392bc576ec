"""Cash journal (U1), stock movements (W4, W15, N2) and the batch write rules.

The source applies each rule to one request inside one database transaction.
Here a rule is a pure function from (current tables, a batch of requests) to
new rows plus decisions with a reject reason; the caller writes the outputs
(append-only, one folder per batch id). A batch of any size is one Spark job.

A new row's id is the current maximum id (a one-row aggregate) plus the
request's own sequence number, a new line's the current maximum line id plus the lines
accepted before its request plus its place (a running sum over the headers), so
re-running a batch after an executor loss gives the same ids. Stock is never updated in
place; it is derived from an opening balance plus signed movements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.functions.scalars import clean_text, is_valid_operator, normalize_operator
from tillgrid.operators.strategy import running_sum
from tillgrid.session import written
from tillgrid.sources.commits import write_batch
from tillgrid.sources.fixtures import union_all
from tillgrid.sources.schemas import DEFAULTS, MONEY, PARTITION_COLS, load_shop

# Texts written by the source into journal rows.
SALE_DETAILS = ("Vente de ", " ligne(s)")
PURCHASE_DETAILS = "Achat fournisseur ref "
NO_REFERENCE = "-"
DEFAULT_CANCEL_REASON = "Annulation manuelle"

# Journal id = source row id * 4 + kind code (unique without a global numbering).
KIND_CODE = {"vente": 0, "annulation": 1, "achat": 2, "depense": 3}
# Movement kinds, in the order used to break timestamp ties.
MOVE_CODE = {"vente": 0, "annulation": 1, "achat": 2, "reappro": 3}

JOURNAL_COLS = ["id", "type", "evenement", "vente_id", "montant", "paiement", "operateur", "reference",
                "details", "user_id", "created_at"]
MOVE_COLS = ["produit_id", "delta", "ts", "kind", "ref_id"]


def max_id(df: DataFrame, col: str = "id") -> int:
    """Current maximum id (a one-row aggregate; 0 for an empty table)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v or 0)


def _journal_row(j_id, type_, evt, vente_id, montant, paiement, operateur, reference, details, user_id,
                 created_at) -> list[Column]:
    vals = [j_id, F.lit(type_), F.lit(evt), vente_id, montant, paiement, operateur, reference, details,
            user_id, created_at]
    types = ["long", "string", "string", "long", MONEY, "string", "string", "string", "string", "long",
             "timestamp_ntz"]
    return [(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n)
            for v, t, n in zip(vals, types, JOURNAL_COLS)]


def _sale_details(n: Column) -> Column:
    return F.concat(F.lit(SALE_DETAILS[0]), n.cast("string"), F.lit(SALE_DETAILS[1]))


def _purchase_details(ref: Column) -> Column:
    return F.concat(F.lit(PURCHASE_DETAILS), F.coalesce(clean_text(ref), F.lit(NO_REFERENCE)))


def sale_journal(sales: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("vente_id").agg(F.count(F.lit(1)).alias("_n"))
    j = sales.join(n, sales.id == n.vente_id, "left")
    return j.select(*_journal_row(F.col("id") * 4 + KIND_CODE["vente"], "entree", "vente", F.col("id"),
                                  F.col("total"), F.col("paiement"), F.col("mobile_operateur"),
                                  F.col("mobile_reference"), _sale_details(F.coalesce(F.col("_n"), F.lit(0))),
                                  F.col("user_id"), F.col("date_vente")))


def cancel_journal(cancels: DataFrame, sales: DataFrame) -> DataFrame:
    v = sales.select(F.col("id").alias("_vid"), F.col("total").alias("_total"), F.col("paiement").alias("_pay"),
                     F.col("mobile_operateur").alias("_op"), F.col("mobile_reference").alias("_ref"))
    j = cancels.join(v, cancels.vente_id == v._vid, "inner")
    return j.select(*_journal_row(F.col("id") * 4 + KIND_CODE["annulation"], "sortie", "annulation",
                                  F.col("vente_id"), F.col("_total"), F.col("_pay"), F.col("_op"), F.col("_ref"),
                                  F.col("motif"), F.col("user_id"), F.col("created_at")))


def purchase_journal(purchases: DataFrame) -> DataFrame:
    return purchases.select(*_journal_row(F.col("id") * 4 + KIND_CODE["achat"], "sortie", "achat", None,
                                          F.col("total"), None, None, None, _purchase_details(F.col("reference")),
                                          F.col("user_id"), F.col("date_achat")))


def expense_journal(expenses: DataFrame) -> DataFrame:
    return expenses.select(*_journal_row(F.col("id") * 4 + KIND_CODE["depense"], "sortie", "depense", None,
                                         F.col("montant"), None, None, None, F.col("libelle"),
                                         F.col("user_id"), F.col("date_depense")))


def build_cash_journal(sales: DataFrame, items: DataFrame, cancels: DataFrame, purchases: DataFrame,
                       expenses: DataFrame) -> DataFrame:
    """The cash journal derived from the facts.

    sale -> entree/vente at the sale time (``Vente de N ligne(s)``); cancellation
    -> sortie/annulation at the cancellation time with the sale's amount and the
    reason; purchase -> sortie/achat (``Achat fournisseur ref R``, ``-`` without
    reference); expense -> sortie/depense with its label.
    """
    return union_all([sale_journal(sales, items), cancel_journal(cancels, sales),
                      purchase_journal(purchases), expense_journal(expenses)])


# ---------------------------------------------------------------- movements
def _moves(df: DataFrame, produit: str, delta: Column, ts: str, kind: str, ref: str) -> DataFrame:
    return df.select(F.col(produit).alias("produit_id"), delta.cast("long").alias("delta"),
                     F.col(ts).cast("timestamp_ntz").alias("ts"), F.lit(kind).alias("kind"),
                     F.col(ref).cast("long").alias("ref_id"))


def sale_movements(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Every recorded sale line leaves stock at the sale time, whatever its later status."""
    v = sales.select(F.col("id").alias("vente_id"), "date_vente")
    return _moves(items.join(v, "vente_id", "inner"), "produit_id", -F.col("quantite"), "date_vente", "vente", "id")


def cancel_movements(cancels: DataFrame, items: DataFrame) -> DataFrame:
    """Lines of a cancelled sale come back at the cancellation time."""
    c = cancels.select("vente_id", F.col("created_at"))
    return _moves(items.join(c, "vente_id", "inner"), "produit_id", F.col("quantite"), "created_at",
                  "annulation", "id")


def purchase_movements(purchase_items: DataFrame, purchases: DataFrame) -> DataFrame:
    p = purchases.select(F.col("id").alias("achat_id"), "date_achat")
    return _moves(purchase_items.join(p, "achat_id", "inner"), "produit_id", F.col("quantite"), "date_achat",
                  "achat", "id")


def all_movements(items: DataFrame, sales: DataFrame, cancels: DataFrame, purchase_items: DataFrame,
                  purchases: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    parts = [sale_movements(items, sales), cancel_movements(cancels, items),
             purchase_movements(purchase_items, purchases)]
    if extra is not None:
        parts.append(extra.select(*MOVE_COLS))
    return union_all(parts)


def stock_on_hand(opening: DataFrame, movements: DataFrame) -> DataFrame:
    """Opening stock + the sum of signed movements, per product.

    A line listed twice counts twice; movements of unknown products are
    dropped (the source's UPDATE matches no row). Movements are summed per
    product before meeting the catalogue.
    """
    s = movements.groupBy("produit_id").agg(F.sum("delta").alias("_moved"))
    j = opening.select("id", "stock").join(s, F.col("id") == s.produit_id, "left")
    return j.select("id", (F.col("stock") + F.coalesce(F.col("_moved"), F.lit(0))).cast("long")
                    .alias("stock"))


def running_balance(movements: DataFrame, opening: DataFrame) -> DataFrame:
    """Stock after each movement, per product, in (ts, kind, ref_id) order.

    Over even slices (see ``strategy.running_sum``), so a product that gets a
    third of all movements, even at one moment, is still spread over many tasks.
    """
    code = F.create_map(*[x for k, v in MOVE_CODE.items() for x in (F.lit(k), F.lit(v))])
    m = movements.withColumn("kind_code", code[F.col("kind")])
    r = running_sum(m, ["produit_id"], ["ts", "kind_code", "ref_id"], "delta", "_cum")
    o = opening.select(F.col("id").alias("produit_id"), F.col("stock").alias("_open"))
    return (r.join(o, "produit_id", "inner")
             .select("produit_id", "ts", "kind", "ref_id", "delta",
                     (F.col("_open") + F.col("_cum")).cast("long").alias("solde")))


def restock(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restock requests -> (+qty movements, rejects).

    The page read-modify-wrote the absolute stock (lost updates under
    concurrency); here a restock is a signed movement. Quantity must be a
    positive integer (``parseInt`` truncation).
    """
    q = F.col("quantite").cast("double").cast("long")
    tagged = requests.withColumn("_q", q).withColumn(
        "rejet", F.when(F.col("_q").isNull() | (F.col("_q") <= 0), "quantite_invalide"))
    ok = tagged.filter(F.col("rejet").isNull())
    moves = _moves(ok.withColumn("_d", F.col("_q")), "produit_id", F.col("_d"), "recu_le", "reappro", "request_id")
    return moves, tagged.filter(F.col("rejet").isNotNull()).drop("_q")


# ---------------------------------------------------------------- sales
def validate_sales(headers: DataFrame) -> DataFrame:
    """Normalise and check sale headers.

    Mobile sales need an operator in {orange, mtn, moov} after trim/lower case
    (else ``operateur_invalide``); a blank reference becomes NULL. Other
    payment types lose operator and reference. A NULL payment type reads as
    the default ``especes``.
    """
    pay = F.coalesce(F.col("paiement"), F.lit(DEFAULTS["ventes"]["paiement"]))
    mobile = pay == "mobile"
    return headers.select(
        *[c for c in headers.columns if c not in ("paiement", "mobile_operateur", "mobile_reference")],
        pay.alias("paiement"),
        F.when(mobile, normalize_operator("mobile_operateur")).alias("mobile_operateur"),
        F.when(mobile, clean_text(F.coalesce(F.col("mobile_reference"), F.lit("")))).alias("mobile_reference"),
        F.when(mobile & ~is_valid_operator("mobile_operateur"), "operateur_invalide").alias("rejet"),
    )


def cart_totals(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Checkout arithmetic per cart.

    subtotal = price x qty, total = sum; a received amount of 0/NULL means
    "exact amount"; cash below the total is rejected; change = received - total
    for cash and 0 otherwise. A cart without lines is rejected.
    """
    t = lines.groupBy("cart_id").agg(
        F.sum(F.col("prix_unitaire").cast(MONEY) * F.col("quantite").cast("int")).alias("total"))
    j = payments.join(t, "cart_id", "left")
    recu = F.col("recu").cast(MONEY)
    eff = F.when(recu.isNull() | (recu == 0), F.col("total")).otherwise(recu)
    cash = F.col("paiement") == "especes"
    return j.select(
        "cart_id", "paiement", F.col("total").cast(MONEY).alias("total"), eff.cast(MONEY).alias("recu"),
        F.when(cash, eff - F.col("total")).otherwise(F.lit(0)).cast(MONEY).alias("monnaie"),
        F.when(F.col("total").isNull(), "panier_vide")
         .when(cash & (eff < F.col("total")), "montant_insuffisant").alias("rejet"))


def _first_line_ids(accepted: DataFrame, base_line_id: int, cheap: bool = False) -> DataFrame:
    """request_id, _before: the id before the first line of each accepted request
    (``n_items`` lines each), in request order without gaps."""
    n = accepted.select("request_id", F.col("n_items").cast("long").alias("n_items"))
    r = running_sum(n, [], ["request_id"], "n_items", "_upto", cheap)
    return r.select("request_id", (F.lit(base_line_id) + F.col("_upto") - F.col("n_items")).alias("_before"))


def record_sales(headers: DataFrame, lines: DataFrame, base_id: int, base_line_id: int = 0, written_input: bool = False) -> dict[str, DataFrame]:
    """Accepted sale payloads -> sales, lines, movements and journal rows.

    The total is taken from the request, not recomputed; stock is not
    checked (it may go negative). Sale id = ``base_id + request_id``; line ids
    follow ``base_line_id`` without gaps, in request and line order. ``written_input``: the inputs are scans of a written table.
    """
    v = validate_sales(headers)
    ok = v.filter(F.col("rejet").isNull()).withColumn("vid", F.lit(base_id) + F.col("request_id"))
    sales = ok.select(
        F.col("vid").alias("id"), F.col("total").cast(MONEY).alias("total"), "paiement", "mobile_operateur",
        "mobile_reference", F.lit("validee").alias("statut"),
        F.coalesce(F.col("monnaie"), F.lit(0)).cast(MONEY).alias("monnaie"),
        F.col("recu_le").alias("date_vente"), "user_id")
    li = (lines.join(ok.select("request_id", "vid", "recu_le"), "request_id", "inner")
               .join(_first_line_ids(ok, base_line_id, written_input), "request_id", "inner")
               .withColumn("_id", F.col("_before") + F.col("pos") + 1))
    items = li.select(F.col("_id").alias("id"), F.col("vid").alias("vente_id"),
                      "produit_id", "nom_produit", F.col("prix_unitaire").cast(MONEY).alias("prix_unitaire"),
                      F.col("quantite").cast("int").alias("quantite"),
                      F.col("sous_total").cast(MONEY).alias("sous_total"))
    moves = _moves(li, "produit_id", -F.col("quantite").cast("int"), "recu_le", "vente", "_id")
    journal = ok.select(*_journal_row(F.col("vid") * 4 + KIND_CODE["vente"], "entree", "vente", F.col("vid"),
                                      F.col("total").cast(MONEY), F.col("paiement"), F.col("mobile_operateur"),
                                      F.col("mobile_reference"), _sale_details(F.col("n_items")),
                                      F.col("user_id"), F.col("recu_le")))
    rejects = v.filter(F.col("rejet").isNotNull()).select("request_id", "rejet")
    return {"ventes": sales, "vente_items": items, "mouvements": moves, "caisse_evenements": journal,
            "rejets": rejects}


def cancel_sales(requests: DataFrame, sales: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Cancellation requests against the current sales.

    Decision per request (``request_seq`` order within a sale id):
    unknown sale -> ``introuvable``; sale already cancelled before the batch, or a
    later request for a sale this batch cancels -> ``deja_annulee``; else
    accepted: status ``annulee``, a cancellation row (blank reason ->
    ``Annulation manuelle``), a journal row and the lines' stock back.
    The first request per sale is found with a grouped min (partial
    aggregation), not a window over a possibly hot sale id.
    """
    first = requests.groupBy("vente_id").agg(F.min("request_seq").alias("_first"))
    s = sales.select(F.col("id").alias("vente_id"), F.col("statut").alias("_statut"))
    j = requests.join(s, "vente_id", "left").join(first, "vente_id", "inner")
    outcome = (F.when(F.col("_statut").isNull(), "introuvable")
                .when(F.col("_statut") == "annulee", "deja_annulee")
                .when(F.col("request_seq") != F.col("_first"), "deja_annulee")
                .otherwise("ok"))
    motif = F.coalesce(clean_text("motif"), F.lit(DEFAULT_CANCEL_REASON))
    decisions = j.select("request_seq", "vente_id", outcome.alias("outcome"), motif.alias("motif"),
                         "user_id", "recu_le")
    ok = decisions.filter(F.col("outcome") == "ok")
    cancels = ok.select(F.col("vente_id").alias("id"), "vente_id", "motif", "user_id",
                        F.col("recu_le").alias("created_at"))
    hit = ok.select(F.col("vente_id").alias("_vid"), F.lit(True).alias("_hit"))
    updated = (sales.join(hit, sales.id == hit._vid, "left")
                    .withColumn("statut", F.when(F.col("_hit"), F.lit("annulee")).otherwise(F.col("statut")))
                    .drop("_vid", "_hit"))
    return {"decisions": decisions, "annulations_vente": cancels, "ventes": updated,
            "mouvements": cancel_movements(cancels, items), "caisse_evenements": cancel_journal(cancels, sales)}


def cancel_stored(requests: DataFrame, path: str, root: str, batch_id: int) -> DataFrame:
    """W5 on tables stored by ``write_shop`` (by day or month): only the periods of cancelled sales are written anew.

    The decisions, cancellation rows, movements and journal rows are committed as batch ``batch_id`` under ``root``. The sales
    of the periods that change are then replaced by dynamic partition overwrite; running the batch again changes nothing more. Returns the decisions.
    """
    spark = requests.sparkSession
    tables = load_shop(spark, path, ["ventes", "vente_items"])
    sales, pcol = tables["ventes"], next(c for c in PARTITION_COLS.values() if c in tables["ventes"].columns)
    known = sales.join(requests.select(F.col("vente_id").alias("id")).distinct(), "id", "left_semi")  # the sales asked about, once
    asked = written(known, "asked")
    out = cancel_sales(requests, asked.drop(pcol), tables["vente_items"])
    decisions = written(out["decisions"], "decisions")
    hit = decisions.filter("outcome = 'ok'").select(F.col("vente_id").alias("id"), F.lit(True).alias("_hit"))
    periods = asked.join(hit, "id", "left_semi").select(pcol).distinct()
    # The periods' values prune the scan of the stored table; there are at most as many as folders that change.
    touched = sales.filter(F.col(pcol).isin([r[0] for r in periods.collect()]))
    changed = (touched.join(hit, "id", "left").withColumn("statut", F.when(F.col("_hit"), F.lit("annulee")).otherwise(F.col("statut"))).drop("_hit"))
    changed = written(changed.select(*sales.columns), "changed")
    write_batch(spark, {k: out[k] for k in ("annulations_vente", "mouvements", "caisse_evenements")} | {"decisions": decisions}, root, batch_id)
    (changed.hint("rebalance", pcol).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(pcol)
            .parquet(f"{path.rstrip('/')}/ventes"))
    return decisions


# ---------------------------------------------------------------- purchases
def validate_purchases(headers: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Reject a whole purchase when it has no line, or when a line has no
    product, quantity <= 0 (after truncation to int) or price <= 0
    (``lignes_invalides``), or names an unknown/inactive product
    (``produit_introuvable``). As in the source, lines are checked in order and
    the first failing line gives the reason.
    """
    from tillgrid.operators.joins import known_active
    qty = F.coalesce(F.col("quantite"), F.lit(0.0)).cast("long")
    price = F.coalesce(F.col("prix_achat"), F.lit(0.0))
    pid = F.col("produit_id")
    checked = known_active(lines.withColumn("_qty", qty).withColumn("_price", price), products)
    why = (F.when(pid.isNull() | (pid == 0) | (F.col("_qty") <= 0) | (F.col("_price") <= 0), "lignes_invalides")
            .when(~F.col("produit_ok"), "produit_introuvable"))
    per_line = checked.withColumn("_why", why)
    first_bad = per_line.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.col("_why"), F.when(F.col("_why").isNotNull(), F.col("pos"))).alias("_why"))
    j = headers.join(first_bad, "request_id", "left")
    rejet = F.when(F.col("_n").isNull(), "aucune_ligne").otherwise(F.col("_why"))
    return j.withColumn("rejet", rejet).withColumn("n_items", F.coalesce("_n", F.lit(0))).drop("_why", "_n")


def record_purchases(headers: DataFrame, lines: DataFrame, products: DataFrame, base_id: int,
                     base_line_id: int = 0) -> dict[str, DataFrame]:
    """Accepted purchases -> purchases, lines, movements and journal rows.

    Line subtotal = qty x price and the purchase total = sum of subtotals, both
    recomputed here; the line's product name is a snapshot of the catalogue.
    """
    v = written(validate_purchases(headers, lines, products), "validated")  # judged once, for all outputs and the line ids
    ok = v.filter(F.col("rejet").isNull()).withColumn("aid", F.lit(base_id) + F.col("request_id"))
    names = products.select(F.col("id").alias("produit_id"), F.col("nom").alias("nom_produit"))
    bought = lines.join(ok.select("request_id", "aid", "recu_le"), "request_id", "inner")
    li = bought.join(_first_line_ids(ok, base_line_id, cheap=True), "request_id", "inner").join(names, "produit_id", "left")
    price = F.col("prix_achat").cast(MONEY)
    qty = F.col("quantite").cast("long").cast("int")
    items = li.select((F.col("_before") + F.col("pos") + 1).alias("id"), F.col("aid").alias("achat_id"),
                      "produit_id", "nom_produit", price.alias("prix_achat"), qty.alias("quantite"),
                      (qty * price).cast(MONEY).alias("sous_total"))
    totals = bought.groupBy(F.col("aid").alias("achat_id")).agg(F.sum((qty * price).cast(MONEY)).cast(MONEY).alias("total"))
    purchases = ok.join(totals, ok.aid == totals.achat_id, "inner").select(
        F.col("aid").alias("id"), "fournisseur_id", "total", clean_text("reference").alias("reference"),
        clean_text("notes").alias("notes"), "user_id", F.col("recu_le").alias("date_achat"))
    moves = _moves(items.join(purchases.select(F.col("id").alias("achat_id"), "date_achat"), "achat_id"),
                   "produit_id", F.col("quantite"), "date_achat", "achat", "id")
    return {"achats": purchases, "achat_items": items, "mouvements": moves,
            "caisse_evenements": purchase_journal(purchases),
            "rejets": v.filter(F.col("rejet").isNotNull()).select("request_id", "rejet")}


def record_expenses(requests: DataFrame, base_id: int) -> dict[str, DataFrame]:
    """Expenses need a label and an amount > 0; blank category/notes -> NULL."""
    lib = clean_text("libelle")
    amount = F.coalesce(F.col("montant").cast("double"), F.lit(0.0))
    tagged = requests.withColumn("rejet", F.when(lib.isNull() | (amount <= 0), "depense_invalide"))
    ok = tagged.filter(F.col("rejet").isNull())
    expenses = ok.select((F.lit(base_id) + F.col("request_id")).alias("id"), lib.alias("libelle"),
                         amount.cast(MONEY).alias("montant"), clean_text("categorie").alias("categorie"),
                         clean_text("notes").alias("notes"), "user_id", F.col("recu_le").alias("date_depense"))
    return {"depenses": expenses, "caisse_evenements": expense_journal(expenses),
            "rejets": tagged.filter(F.col("rejet").isNotNull()).select("request_id", "rejet")}


# ---------------------------------------------------------------- catalogue
def upsert_products(current: DataFrame, changes: DataFrame, base_id: int) -> DataFrame:
    """Product inserts (``id`` NULL) and updates, one decision per change.

    Insert: barcode trimmed (blank -> NULL), stock 0, alert 5 and no category
    by default. Update: overwrites every field, and a change without
    stock/alert/category resets them to 0/5/NULL; only a change *without a
    barcode key* (``has_code_barres`` false) keeps the old barcode. Unknown id
    -> ``introuvable``. A non-NULL barcode held by another product, or claimed
    by an earlier change of the batch to another product -> ``code_barres_duplique``.
    Returns the changes with the resulting product row and ``rejet``.
    """
    cur = current.select(F.col("id").alias("_cid"), F.col("code_barres").alias("_ccb"),
                         F.col("actif").alias("_cactif"))
    c = changes.join(cur, changes.id == cur._cid, "left")
    is_insert = F.col("id").isNull()
    new_cb = clean_text(F.coalesce(F.col("code_barres"), F.lit("")))
    cb = F.when(is_insert | F.col("has_code_barres"), new_cb).otherwise(F.col("_ccb"))
    c = c.withColumn("_cb", cb).withColumn("_target", F.when(is_insert, F.lit(base_id) + F.col("request_seq"))
                                                      .otherwise(F.col("id")))
    holders = current.filter(F.col("code_barres").isNotNull()).select(
        F.col("code_barres").alias("_cb"), F.col("id").alias("_holder"))
    c = c.join(holders, "_cb", "left")
    unknown = ~is_insert & F.col("_cid").isNull()
    held = F.col("_cb").isNotNull() & F.col("_holder").isNotNull() & (F.col("_holder") != F.col("_target"))
    c = c.withColumn("_unknown", unknown).withColumn("_held", held)
    # Among the remaining claims on one barcode, the product of the earliest one wins;
    # that product's own later changes may keep it.
    firsts = (c.filter(F.col("_cb").isNotNull() & ~F.col("_held") & ~F.col("_unknown"))
               .groupBy("_cb").agg(F.min_by("_target", "request_seq").alias("_first")))
    c = c.join(firsts, "_cb", "left")
    dup = F.col("_held") | (F.col("_cb").isNotNull() & (F.col("_target") != F.col("_first")))
    rejet = F.when(F.col("_unknown"), "introuvable").when(dup, "code_barres_duplique")
    d = DEFAULTS["produits"]
    return c.select(
        "request_seq", F.when(is_insert, "insert").otherwise("update").alias("action"),
        F.col("_target").alias("id"), "nom", F.col("prix").cast(MONEY).alias("prix"),
        F.col("_cb").alias("code_barres"),
        F.coalesce(F.col("stock"), F.lit(d["stock"])).cast("int").alias("stock"),
        F.coalesce(F.col("stock_alerte"), F.lit(d["stock_alerte"])).cast("int").alias("stock_alerte"),
        F.col("categorie_id").cast("long").alias("categorie_id"),
        F.when(is_insert, F.lit(d["actif"])).otherwise(F.col("_cactif")).cast("int").alias("actif"),
        rejet.alias("rejet"))


def apply_product_changes(current: DataFrame, decided: DataFrame) -> DataFrame:
    """The product table after W9: the last accepted change of a product replaces its row, inserts are appended."""
    return _replaced(current, decided, ["id", "nom", "code_barres", "prix", "stock", "stock_alerte", "categorie_id", "actif"])


def apply_supplier_changes(current: DataFrame, decided: DataFrame) -> DataFrame:
    """The supplier table after W13, by the same rule."""
    return _replaced(current, decided, ["id", "nom", "contact", "telephone", "email", "adresse", "actif", "created_at"])


def accepted(decided: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` (id among them) of the last accepted change of each id."""
    rest = [c for c in cols if c != "id"]
    return (decided.filter(F.col("rejet").isNull()).groupBy("id")
                   .agg(F.max_by(F.struct(*rest), "request_seq").alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def _replaced(current: DataFrame, decided: DataFrame, cols: list[str]) -> DataFrame:
    ok = accepted(decided, cols)
    kept = current.join(ok.select(F.col("id").alias("_id")), current.id == F.col("_id"), "left_anti")
    return kept.select(*cols).unionByName(ok.select(*cols))


def soft_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Set ``actif = 0`` for the given ids; unknown ids do nothing."""
    hit = ids.select(F.col("id").alias("_did")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(hit, df.id == hit._did, "left")
    return j.withColumn("actif", F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("actif"))).drop("_did", "_hit")


def insert_if_absent(current: DataFrame, new: DataFrame, base_id: int, key: str = "nom") -> DataFrame:
    """Rows of ``new`` whose ``key`` is not in ``current``; the first
    (lowest ``request_seq``) of in-batch duplicates wins. Returns the rows to
    insert with new ids; running it twice inserts nothing the second time.
    """
    cols = [c for c in new.columns if c not in (key, "request_seq")]
    first = new.groupBy(key).agg(F.min_by(F.struct("request_seq", *cols), F.col("request_seq")).alias("_r"))
    absent = first.join(current.select(key).distinct(), key, "left_anti")
    return absent.select((F.lit(base_id) + F.col("_r.request_seq")).alias("id"), key,
                         *[F.col(f"_r.{c}").alias(c) for c in cols])


def delete_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Hard delete by id (children keep the dangling id)."""
    gone = ids.select(F.col("id").alias("_did")).distinct()
    return df.join(gone, df.id == gone._did, "left_anti")


def upsert_suppliers(current: DataFrame, changes: DataFrame, base_id: int) -> DataFrame:
    """Supplier inserts (``id`` NULL) and updates.

    The name is required after trimming (``nom_requis``); contact fields are
    trimmed, blanks -> NULL; an update replaces all five fields; an update of
    an unknown id changes nothing (``sans_effet``).
    """
    cur = current.select(F.col("id").alias("_cid"), F.col("actif").alias("_cactif"),
                         F.col("created_at").alias("_ccreated"))
    c = changes.join(cur, changes.id == cur._cid, "left")
    is_insert = F.col("id").isNull()
    nom = clean_text("nom")
    rejet = F.when(nom.isNull(), "nom_requis").when(~is_insert & F.col("_cid").isNull(), "sans_effet")
    return c.select(
        "request_seq", F.when(is_insert, "insert").otherwise("update").alias("action"),
        F.when(is_insert, F.lit(base_id) + F.col("request_seq")).otherwise(F.col("id")).alias("id"),
        nom.alias("nom"), *[clean_text(x).alias(x) for x in ("contact", "telephone", "email", "adresse")],
        F.when(is_insert, F.lit(1)).otherwise(F.col("_cactif")).cast("int").alias("actif"),
        F.when(is_insert, F.col("recu_le")).otherwise(F.col("_ccreated")).alias("created_at"),
        rejet.alias("rejet"))


def add_categories(current: DataFrame, new: DataFrame, base_id: int) -> DataFrame:
    """Append categories with the default colour; names are not checked for uniqueness."""
    added = new.select((F.lit(base_id) + F.col("request_seq")).alias("id"), "nom",
                       F.coalesce(F.col("couleur"), F.lit(DEFAULTS["categories"]["couleur"])).alias("couleur"))
    return current.select("id", "nom", "couleur").unionByName(added)


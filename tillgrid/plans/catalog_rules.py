"""Registry entries for the batch write rules (W1-W15) and chat presence (ST6-ST8).

Request batches come from ``plans.requests`` (whole tables, perturbed values).
The oracle SQL rebuilds the same batches from the same views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillgrid.functions.scalars import ntz_text
from tillgrid.operators import ledger as W
from tillgrid.operators import stored
from tillgrid.operators.catalogue import upsert_products_in_order
from tillgrid.plans import requests as R
from tillgrid.plans.catalog import m, q, ts, tsu
from tillgrid.session import shared_dir, written
from tillgrid.sources import payloads as S4
from tillgrid.streaming import presence as ST

UNK = R.UNKNOWN_OFFSET
AGAIN = R.AGAIN

# -- sale payload batch as SQL (mirrors requests.sale_payloads after parsing) --
SALE_HEADERS_SQL = """select id request_id, total, paiement, monnaie, user_id, date_vente recu_le,
    case when id % 10 = 1 then concat(' ', upper(mobile_operateur), ' ') when id % 10 = 2 then 'wave'
      else mobile_operateur end op_sent,
    case when id % 10 = 3 then '   ' else mobile_reference end ref_sent,
    (select count(*) from vente_items i where i.vente_id = v.id) n_items
  from ventes v where id % 50 <> 7"""

VALIDATED_SQL = f"""select request_id, total, monnaie, user_id, recu_le, n_items, coalesce(paiement, 'especes') paiement,
    case when paiement = 'mobile' then lower(trim(coalesce(op_sent, ''))) end mobile_operateur,
    case when paiement = 'mobile' then nullif(trim(coalesce(ref_sent, '')), '') end mobile_reference,
    case when paiement = 'mobile' and lower(trim(coalesce(op_sent, ''))) not in ('orange', 'mtn', 'moov')
      then 'operateur_invalide' end rejet
  from ({SALE_HEADERS_SQL}) h"""


def _sale_headers(fx):
    headers, lines, _ = S4.parse_payloads(R.sale_payloads(fx), "sale")
    return headers, lines


@q("validate_sales", f"""select request_id, paiement, mobile_operateur, mobile_reference, rejet
  from ({VALIDATED_SQL}) x""")
def _w1(fx):
    """W1 over every sale's payload (operators padded, upper-cased or unknown; blank references)."""
    headers, _ = _sale_headers(fx)
    return W.validate_sales(headers).select("request_id", "paiement", "mobile_operateur", "mobile_reference", "rejet")


@q("cart_totals", f"""with t as (select vente_id, sum(prix_unitaire * quantite) total from vente_items group by vente_id),
  p as (select id cart_id, paiement, case when monnaie = 0 then 0 else total end recu from ventes),
  j as (select p.cart_id, p.paiement, t.total, case when p.recu is null or p.recu = 0 then t.total else p.recu end eff
        from p left join t on t.vente_id = p.cart_id)
  select cart_id, paiement, {m('total')} total, {m('eff')} recu,
    {m("case when paiement = 'especes' then eff - total else 0 end")} monnaie,
    case when total is null then 'panier_vide' when paiement = 'especes' and eff < total then 'montant_insuffisant'
    end rejet from j""")
def _w2(fx):
    lines, pay = R.cart_batches(fx)
    return W.cart_totals(lines, pay)


RECORD_SALES_SQL = f"""select (select max(id) from ventes) + request_id id, {m('cast(total as decimal(18,2))')} total,
  paiement, mobile_operateur, mobile_reference, 'validee' statut,
  {m('cast(coalesce(monnaie, 0) as decimal(18,2))')} monnaie, {ts('recu_le')} date_vente, user_id
  from ({VALIDATED_SQL}) x where rejet is null"""


@q("record_sales", RECORD_SALES_SQL)
def _w3(fx):
    """Accepted payloads become new sales (ids after the current maximum)."""
    return _recorded_sales(fx)["ventes"]


def _recorded_sales(fx):
    headers, lines = _sale_headers(fx)
    return W.record_sales(headers, lines, W.max_id(fx["ventes"]), W.max_id(fx["vente_items"]))


def _recorded_lines(fx):
    """As ``_recorded_sales``, for outputs that take the payloads more than once: parsed once, the text kept for rejects alone."""
    tagged = S4.tag_payloads(R.sale_payloads(fx), "sale").withColumn("_raw", F.when(F.col("rejet").isNotNull(), F.col("_raw")))
    headers, lines, _ = S4.split_payloads(written(tagged, "payloads"), "sale")
    return W.record_sales(headers, lines, W.max_id(fx["ventes"]), W.max_id(fx["vente_items"]), written_input=True)


SALE_ITEMS_SQL = f"""select (select max(id) from vente_items) + coalesce(before, 0) + pos + 1 id,
    (select max(id) from ventes) + v.request_id vente_id, produit_id, nom_produit, prix_unitaire, quantite, sous_total, recu_le
  from (select *, sum(n_items) over (order by request_id rows between unbounded preceding and 1 preceding) before
        from ({VALIDATED_SQL}) x where rejet is null) v
  join (select *, row_number() over (partition by vente_id order by id) - 1 pos from vente_items) i on i.vente_id = v.request_id"""


@q("record_sales_items", f"""select cast(id as bigint) id, vente_id, produit_id, nom_produit, {m('prix_unitaire')} prix_unitaire,
  quantite, {m('sous_total')} sous_total from ({SALE_ITEMS_SQL}) x""")
def _w3_items(fx):
    """The accepted sales' lines, with ids that go on without gaps."""
    return _recorded_lines(fx)["vente_items"]


@q("record_sales_moves", f"""select produit_id, cast(-quantite as bigint) delta, {ts('recu_le')} ts, 'vente' kind, cast(id as bigint) ref_id
  from ({SALE_ITEMS_SQL}) x""")
def _w3_moves(fx):
    return _recorded_lines(fx)["mouvements"]


@q("record_sales_journal", f"""select ((select max(id) from ventes) + request_id) * 4 id, 'entree' type, 'vente' evenement,
    (select max(id) from ventes) + request_id vente_id, {m('cast(total as decimal(18,2))')} montant, paiement,
    mobile_operateur operateur, mobile_reference reference, concat('Vente de ', cast(n_items as varchar), ' ligne(s)') details, user_id,
    {ts('recu_le')} created_at from ({VALIDATED_SQL}) x where rejet is null""")
def _w3_journal(fx):
    return _recorded_sales(fx)["caisse_evenements"]


@q("record_sales_rejects", f"select request_id, rejet from ({VALIDATED_SQL}) x where rejet is not null")
def _w3_rejects(fx):
    return _recorded_sales(fx)["rejets"]


MOVES_SQL = """select i.produit_id, -i.quantite delta from vente_items i join ventes v on v.id = i.vente_id
  union all select i.produit_id, i.quantite from vente_items i join annulations_vente c on c.vente_id = i.vente_id
  union all select i.produit_id, i.quantite from achat_items i join achats a on a.id = i.achat_id"""


@q("stock_on_hand", f"""select p.id, cast(p.stock + coalesce(s.d, 0) as bigint) stock from produits p
  left join (select produit_id, sum(delta) d from ({MOVES_SQL}) mv group by produit_id) s on s.produit_id = p.id""")
def _w4(fx):
    mv = W.all_movements(fx["vente_items"], fx["ventes"], fx["annulations_vente"], fx["achat_items"], fx["achats"])
    return W.stock_on_hand(fx["produits"], mv)


@q("cancel_sales", """with r as (
    select id * 4 request_seq, id vente_id, case when id % 5 = 0 then '  ' else 'erreur caisse' end motif from ventes
    union all select id * 4 + 1, id, 'doublon' from ventes where id % 7 = 0
    union all select id * 4 + 2, -id, 'inconnue' from ventes where id % 13 = 0),
  f as (select vente_id, min(request_seq) first_seq from r group by vente_id)
  select r.request_seq, r.vente_id,
    case when v.id is null then 'introuvable' when v.statut = 'annulee' then 'deja_annulee'
      when r.request_seq <> f.first_seq then 'deja_annulee' else 'ok' end outcome,
    coalesce(nullif(trim(r.motif), ''), 'Annulation manuelle') motif
  from r join f on f.vente_id = r.vente_id left join ventes v on v.id = r.vente_id""")
def _w5(fx):
    """A request per sale, repeats for every 7th, unknown ids for every 13th."""
    out = W.cancel_sales(R.cancel_requests(fx), fx["ventes"], fx["vente_items"])
    return out["decisions"].select("request_seq", "vente_id", "outcome", "motif")


# Every valid sale is cancelled by the first request for it.
CANCELLED_SQL = """select id, user_id, date_vente + interval 2 day created_at,
    case when id % 5 = 0 then 'Annulation manuelle' else 'erreur caisse' end motif from ventes where statut <> 'annulee'"""


def _cancelled(fx, name):
    return W.cancel_sales(R.cancel_requests(fx), fx["ventes"], fx["vente_items"])[name]


@q("cancel_sales_rows", f"select id, id vente_id, motif, user_id, {ts('created_at')} created_at from ({CANCELLED_SQL}) c")
def _w5_rows(fx):
    return _cancelled(fx, "annulations_vente")


@q("cancel_sales_table", f"""select id, {m('total')} total, paiement, mobile_operateur, mobile_reference, 'annulee' statut,
  {m('monnaie')} monnaie, {ts('date_vente')} date_vente, user_id from ventes""")
def _w5_table(fx):
    return _cancelled(fx, "ventes")


@q("cancel_sales_moves", f"""select i.produit_id, cast(i.quantite as bigint) delta, {ts('c.created_at')} ts, 'annulation' kind, i.id ref_id
  from vente_items i join ({CANCELLED_SQL}) c on c.id = i.vente_id""")
def _w5_moves(fx):
    return _cancelled(fx, "mouvements")


@q("cancel_sales_journal", f"""select c.id * 4 + 1 id, 'sortie' type, 'annulation' evenement, c.id vente_id, {m('v.total')} montant, v.paiement,
  v.mobile_operateur operateur, v.mobile_reference reference, c.motif details, c.user_id, {ts('c.created_at')} created_at
  from ({CANCELLED_SQL}) c join ventes v on v.id = c.id""")
def _w5_journal(fx):
    return _cancelled(fx, "caisse_evenements")


@q("parse_purchase_payloads", f"""with l as (select achat_id request_id, id - achat_id * 1000 - 1 pos,
    case when id % 23 = 0 then produit_id + {UNK} else produit_id end produit_id,
    case when id % 17 = 0 then 0 else quantite end quantite, case when id % 19 = 0 then 0 else prix_achat end prix_achat from achat_items)
  select request_id, cast(pos as int) pos, produit_id, {m('quantite')} quantite, {m('prix_achat')} prix_achat
  from l where request_id in (select id from achats) and request_id % 13 <> 0""")
def _s4_purchases(fx):
    """S4 for purchases: numbers sent as numbers or as text; broken JSON gives no lines."""
    return S4.parse_payloads(R.purchase_payloads(fx), "purchase")[1]


PURCHASE_LINES_SQL = f"""select achat_id request_id, id - achat_id * 1000 - 1 pos,
    case when id % 23 = 0 then produit_id + {UNK} else produit_id end produit_id,
    case when id % 17 = 0 then 0 else quantite end quantite,
    case when id % 19 = 0 then 0 else prix_achat end prix_achat from achat_items"""

PURCHASE_CHECK_SQL = f"""with h as (select id request_id, fournisseur_id, reference, notes, user_id, date_achat recu_le from achats
    union all select -id, fournisseur_id, reference, notes, user_id, date_achat from achats where id % 11 = 0 and id <> 0),
  l as ({PURCHASE_LINES_SQL}),
  c as (select l.*, case when produit_id is null or produit_id = 0 or quantite <= 0 or prix_achat <= 0
          then 'lignes_invalides' when p.id is null then 'produit_introuvable' end why
        from l left join (select id from produits where actif = 1) p on p.id = l.produit_id),
  b as (select request_id, count(*) n, arg_min(why, pos) filter (where why is not null) why from c group by request_id),
  v as (select h.*, case when b.n is null then 'aucune_ligne' else b.why end rejet from h left join b using (request_id))"""


@q("validate_purchases", PURCHASE_CHECK_SQL + "\nselect request_id, rejet from v")
def _w6(fx):
    headers, lines = R.purchase_batches(fx)
    return W.validate_purchases(headers, lines, fx["produits"]).select("request_id", "rejet")


@q("record_purchases", PURCHASE_CHECK_SQL + f""",
  t as (select l.request_id, sum(cast(cast(l.quantite as bigint) as int) * cast(l.prix_achat as decimal(18,2))) total
        from l join v on v.request_id = l.request_id where v.rejet is null group by l.request_id)
  select (select max(id) from achats) + v.request_id id, v.fournisseur_id, {m('t.total')} total,
    nullif(trim(v.reference), '') reference, nullif(trim(v.notes), '') notes, v.user_id, {ts('v.recu_le')} date_achat
  from v join t on t.request_id = v.request_id where v.rejet is null""")
def _w7(fx):
    return _recorded_purchases(fx)["achats"]


def _recorded_purchases(fx):
    headers, lines = R.purchase_batches(fx)
    return W.record_purchases(headers, lines, fx["produits"], W.max_id(fx["achats"]), W.max_id(fx["achat_items"]))


PURCHASE_ITEMS_SQL = PURCHASE_CHECK_SQL + f""",
  f as (select request_id, recu_le, sum(n) over (order by request_id rows between unbounded preceding and 1 preceding) before
        from (select v.request_id, v.recu_le, b.n from v join b using (request_id) where v.rejet is null) x),
  i as (select (select max(id) from achat_items) + coalesce(before, 0) + pos + 1 id, (select max(id) from achats) + l.request_id achat_id,
          l.produit_id, p.nom nom_produit, cast(prix_achat as decimal(18,2)) prix_achat, cast(cast(quantite as bigint) as int) quantite, f.recu_le
        from l join f using (request_id) left join produits p on p.id = l.produit_id)"""


@q("record_purchases_items", PURCHASE_ITEMS_SQL + f"""
  select cast(id as bigint) id, achat_id, produit_id, nom_produit, {m('prix_achat')} prix_achat, quantite, {m('quantite * prix_achat')} sous_total from i""")
def _w7_items(fx):
    """The accepted purchases' lines, with ids that go on without gaps."""
    return _recorded_purchases(fx)["achat_items"]


@q("record_purchases_moves", PURCHASE_ITEMS_SQL + f"""
  select produit_id, cast(quantite as bigint) delta, {ts('recu_le')} ts, 'achat' kind, cast(id as bigint) ref_id from i""")
def _w7_moves(fx):
    return _recorded_purchases(fx)["mouvements"]


@q("record_purchases_rejects", PURCHASE_CHECK_SQL + "\nselect request_id, rejet from v where rejet is not null")
def _w7_rejects(fx):
    return _recorded_purchases(fx)["rejets"]


@q("record_expenses", f"""with r as (select id request_id,
    case when id % 9 = 0 then '  ' else concat(' ', libelle) end libelle,
    case when id % 7 = 0 then 0 when id % 11 = 0 then -montant else montant end montant,
    case when id % 5 = 0 then '  ' else categorie end categorie, user_id, date_depense recu_le from depenses)
  select (select max(id) from depenses) + request_id id, trim(libelle) libelle,
    {m('cast(cast(montant as double) as decimal(18,2))')} montant, nullif(trim(categorie), '') categorie,
    cast(null as varchar) notes, user_id, {ts('recu_le')} date_depense
  from r where nullif(trim(libelle), '') is not null and montant > 0""")
def _w8(fx):
    return W.record_expenses(R.expense_requests(fx), W.max_id(fx["depenses"]))["depenses"]


PRODUCT_CHANGES_SQL = f"""with up as (
    select id * 2 request_seq, case when id % 29 = 0 then id + {UNK} else id end id, concat(nom, ' v2') nom, prix,
      case when id % 3 = 0 then null else stock + 1 end stock,
      case when id % 3 = 0 then null else stock_alerte end stock_alerte,
      case when id % 3 = 0 then null else categorie_id end categorie_id,
      case when id % 4 = 2 then concat('618', lpad(cast(id + 1 as varchar), 10, '0'))
           when id % 4 = 3 then code_barres end code_barres,
      id % 4 <> 0 has_cb from produits),
  ch as (select * from up
    union all select request_seq + {AGAIN}, id, concat(nom, ' v3'), prix, stock, stock_alerte, categorie_id, code_barres, has_cb
      from up where (request_seq // 2) % 5 = 0
    union all select id * 2 + 1, null, concat(nom, ' bis'), prix, null, null, null,
      concat(' 999', cast(id as varchar), ' '), true from produits where id % 31 = 0),
  c as (select ch.*, cur.id cid, cur.actif cactif,
      case when ch.id is null or ch.has_cb then nullif(trim(coalesce(ch.code_barres, '')), '') else cur.code_barres end cb,
      case when ch.id is null then (select max(id) from produits) + ch.request_seq else ch.id end target
    from ch left join produits cur on cur.id = ch.id),
  h as (select c.*, hold.id holder, (c.id is not null and c.cid is null) unknown_id,
      coalesce(c.cb is not null and hold.id is not null and hold.id <> c.target, false) held
    from c left join produits hold on hold.code_barres = c.cb),
  f as (select cb, arg_min(target, request_seq) first_target from h where cb is not null and not held and not unknown_id group by cb),
  d as (select h.request_seq, case when h.id is null then 'insert' else 'update' end action, h.target id, h.nom,
    {m('h.prix')} prix, h.cb code_barres, cast(coalesce(h.stock, 0) as int) stock,
    cast(coalesce(h.stock_alerte, 5) as int) stock_alerte, cast(h.categorie_id as bigint) categorie_id,
    cast(case when h.id is null then 1 else h.cactif end as int) actif,
    case when h.unknown_id then 'introuvable'
      when h.held or (h.cb is not null and h.target <> f.first_target) then 'code_barres_duplique' end rejet
  from h left join f on f.cb = h.cb)"""


@q("upsert_products", PRODUCT_CHANGES_SQL + "\nselect * from d")
def _w9(fx):
    return W.upsert_products(fx["produits"], R.product_changes(fx), W.max_id(fx["produits"]))


@q("upsert_products_in_order", PRODUCT_CHANGES_SQL + f""",
  handed as (select p.id * 2 + 2 * {AGAIN} request_seq, 'update' action, p.id, concat(p.nom, ' v4') nom, {m('p.prix')} prix,
    concat('618', lpad(cast(p.id + 1 as varchar), 10, '0')) code_barres, 0 stock, 5 stock_alerte, cast(null as bigint) categorie_id, p.actif,
    case when n.code_barres is not null and n.id % 29 = 0 then 'code_barres_duplique' end rejet
    from produits p left join produits n on n.id = p.id + 1 where p.id % 4 = 0)
  select * from d union all select * from handed""")
def _w9_in_order(fx):
    """W9 in request order: every 4th product asks last for the barcode that its neighbour gave up before (where it could)."""
    k = F.col("id")
    handed = fx["produits"].filter(k % 4 == 0).select(
        (k * 2 + 2 * R.AGAIN).alias("request_seq"), "id", F.concat("nom", F.lit(" v4")).alias("nom"), "prix",
        F.concat(F.lit("618"), F.lpad((k + 1).cast("string"), 10, "0")).alias("code_barres"), F.lit(True).alias("has_code_barres"))
    changes = R.product_changes(fx).unionByName(handed, allowMissingColumns=True)
    return upsert_products_in_order(fx["produits"], changes, W.max_id(fx["produits"]))


PRODUCT_TABLE_SQL = PRODUCT_CHANGES_SQL + f"""
  select id, nom, code_barres, {m('prix')} prix, stock, stock_alerte, categorie_id, actif from produits where id not in (select id from d where rejet is null)
  union all select id, nom, code_barres, prix, stock, stock_alerte, categorie_id, actif from d where rejet is null
  qualify row_number() over (partition by id order by request_seq desc) = 1"""


@q("apply_product_changes", PRODUCT_TABLE_SQL)
def _w9_table(fx):
    """The product table after the batch; of several changes to a product the last accepted one holds."""
    return W.apply_product_changes(fx["produits"], _w9(fx))


SOFT_DELETE_SQL = """select id, nom, case when id % 4 = 0 then 0 else actif end actif from fournisseurs"""


@q("soft_delete", SOFT_DELETE_SQL)
def _w10(fx):
    """Every 4th supplier deleted, plus ids that do not exist (no effect)."""
    f = fx["fournisseurs"]
    ids = (f.filter(F.col("id") % 4 == 0).select("id")
            .unionByName(f.filter(F.col("id") % 4 == 1).select((F.col("id") + UNK).alias("id"))))
    return W.soft_delete(f, ids).select("id", "nom", "actif")


@q("insert_if_absent", f"""with n as (select p_partkey request_seq,
    case when p_partkey % 2 = 0 then p_name else concat(p_name, ' ', p_brand) end nom,
    cast(p_retailprice as decimal(18,2)) prix from part),
  f as (select nom, min(request_seq) s from n group by nom)
  select (select max(id) from produits) + f.s id, f.nom, {m('n.prix')} prix
  from f join n on n.request_seq = f.s where not exists (select 1 from produits p where p.nom = f.nom)""")
def _w11(fx):
    return W.insert_if_absent(fx["produits"], R.catalogue_rows(fx), W.max_id(fx["produits"]))


DELETE_CATEGORIES_SQL = """select p.id, p.nom, p.categorie_id, c.nom categorie_nom from produits p
  left join (select * from categories where id % 2 <> 0) c on c.id = p.categorie_id where p.actif = 1"""


@q("delete_categories", DELETE_CATEGORIES_SQL)
def _w12(fx):
    """Even category ids deleted; the catalogue then shows NULL for their products."""
    from tillgrid.operators.joins import catalog
    cats = fx["categories"]
    left = W.delete_by_id(cats, cats.filter(F.col("id") % 2 == 0).select("id"))
    return catalog(fx["produits"], left).select("id", "nom", "categorie_id", "categorie_nom")


SUPPLIER_CHANGES_SQL = f"""with up as (
    select id * 2 request_seq, case when id % 10 = 0 then id + {UNK} else id end id,
      case when id % 6 = 0 then '  ' else concat(nom, ' ') end nom, concat(' c', cast(id as varchar), ' ') contact,
      '' telephone, cast(null as varchar) email, ' Abidjan ' adresse, cast(null as timestamp) recu_le from fournisseurs),
  ch as (select * from up
    union all select request_seq + {AGAIN}, id, nom, ' second ', telephone, email, adresse, recu_le from up where (request_seq // 2) % 7 = 0
    union all select id * 2 + 1, null, concat(nom, ' bis'), null, null, 'x@y.z', null, timestamp '2000-01-01 00:00:00'
      from fournisseurs where id % 9 = 0),
  d as (select ch.request_seq, case when ch.id is null then 'insert' else 'update' end action,
    case when ch.id is null then (select max(id) from fournisseurs) + ch.request_seq else ch.id end id,
    nullif(trim(ch.nom), '') nom, nullif(trim(ch.contact), '') contact, nullif(trim(ch.telephone), '') telephone,
    nullif(trim(ch.email), '') email, nullif(trim(ch.adresse), '') adresse,
    cast(case when ch.id is null then 1 else cur.actif end as int) actif,
    {ts('case when ch.id is null then ch.recu_le end')} created_at,
    case when nullif(trim(ch.nom), '') is null then 'nom_requis' when ch.id is not null and cur.id is null
      then 'sans_effet' end rejet
  from ch left join fournisseurs cur on cur.id = ch.id)"""


@q("upsert_suppliers", SUPPLIER_CHANGES_SQL + "\nselect * from d")
def _w13(fx):
    return W.upsert_suppliers(fx["fournisseurs"], R.supplier_changes(fx), W.max_id(fx["fournisseurs"]))


SUPPLIER_TABLE_SQL = SUPPLIER_CHANGES_SQL + f"""
  select id, nom, cast(null as varchar) contact, cast(null as varchar) telephone, cast(null as varchar) email,
    cast(null as varchar) adresse, actif, cast(null as varchar) created_at from fournisseurs where id not in (select id from d where rejet is null)
  union all select id, nom, contact, telephone, email, adresse, actif, created_at from d where rejet is null
  qualify row_number() over (partition by id order by request_seq desc) = 1"""


@q("apply_supplier_changes", SUPPLIER_TABLE_SQL)
def _w13_table(fx):
    """The supplier table after the batch."""
    return W.apply_supplier_changes(fx["fournisseurs"], _w13(fx))


def _kept_in_folders(table, schema, change):
    """The table stored by ``write_keyed``, changed in place and read back."""
    path = shared_dir(table.sparkSession, "catalogue")
    stored.write_keyed(table.select(*schema.fieldNames()), path)
    change(path)
    return stored.read_keyed(table.sparkSession, path, schema).select(*schema.fieldNames())


@q("apply_product_changes_stored", PRODUCT_TABLE_SQL)
def _w9_stored(fx):
    """W9 on a stored table: only the folders of changed products are rewritten."""
    out = _w9(fx)
    cols = ["id", "nom", "code_barres", "prix", "stock", "stock_alerte", "categorie_id", "actif"]
    schema = fx["produits"].select(*cols).schema
    return _kept_in_folders(fx["produits"], schema, lambda path: stored.apply_stored(out, path, schema))


@q("soft_delete_stored", SOFT_DELETE_SQL)
def _w10_stored(fx):
    f = fx["fournisseurs"]
    ids = (f.filter(F.col("id") % 4 == 0).select("id")
            .unionByName(f.filter(F.col("id") % 4 == 1).select((F.col("id") + UNK).alias("id"))))
    return _kept_in_folders(f, f.schema, lambda path: stored.soft_delete_stored(ids, path, f.schema)).select("id", "nom", "actif")


@q("delete_categories_stored", DELETE_CATEGORIES_SQL)
def _w12_stored(fx):
    from tillgrid.operators.joins import catalog
    cats = fx["categories"]
    left = _kept_in_folders(cats, cats.schema, lambda path: stored.delete_stored(cats.filter(F.col("id") % 2 == 0).select("id"), path, cats.schema))
    return catalog(fx["produits"], left).select("id", "nom", "categorie_id", "categorie_nom")


@q("apply_supplier_changes_stored", SUPPLIER_TABLE_SQL)
def _w13_stored(fx):
    out = _w13(fx)
    cols = ["id", "nom", "contact", "telephone", "email", "adresse", "actif", "created_at"]
    schema = fx["fournisseurs"].select(*cols).schema
    return _kept_in_folders(fx["fournisseurs"], schema, lambda path: stored.apply_stored(out, path, schema))


@q("add_categories", """select id, nom, couleur from categories
  union all select (select max(id) from categories) + min(p_partkey), p_brand, '#22c55e' from part group by p_brand""")
def _w14(fx):
    return W.add_categories(fx["categories"], R.new_categories(fx), W.max_id(fx["categories"]))


@q("restock", f"""select l_partkey produit_id, cast(cast(l_quantity - 25 as double) as bigint) delta,
  {ts('l_shipdate')} ts, 'reappro' kind from lineitem
  where cast(cast(l_quantity - 25 as double) as bigint) > 0""")
def _w15(fx):
    moves, _ = W.restock(R.restock_requests(fx))
    return moves.select("produit_id", "delta", "ts", "kind")


# ============================================================ presence (batch)
PREV_SQL = """select *,
    last_value(case when kind <> 'message' then kind end ignore nulls)
      over (partition by conn order by ts, id rows between unbounded preceding and 1 preceding) prev_kind,
    last_value(case when kind <> 'message' then username end ignore nulls)
      over (partition by conn order by ts, id rows between unbounded preceding and 1 preceding) prev_name
  from chat_events"""

TRANSITIONS_SQL = f"""select id, ts, conn, kind, username,
    case when kind = 'join' and coalesce(prev_kind, 'disconnect') <> 'join' then 1
         when kind = 'disconnect' and prev_kind = 'join' then -1 else 0 end delta
  from ({PREV_SQL}) e where kind <> 'message'"""


def _micro(df, *cols):
    for c in cols:
        df = df.withColumn(c, ntz_text(c, micros=True))
    return df


PRESENCE_SQL = f"""select id, {tsu('ts')} ts, conn, kind, delta,
  sum(delta) over (order by ts, id rows between unbounded preceding and current row) en_ligne
  from ({TRANSITIONS_SQL}) t"""

GATED_SQL = f"""select id, {tsu('ts')} ts, conn, username from ({PREV_SQL}) e
  where kind = 'message' and prev_kind = 'join' and prev_name = username"""


@q("presence_counts", PRESENCE_SQL)
def _st6(fx):
    return _micro(ST.presence_counts(fx["chat_events"]), "ts")


@q("gated_messages", GATED_SQL)
def _st7(fx):
    return _micro(ST.gated_messages(fx["chat_events"]), "ts")


SESSIONS_SQL = f"""select conn, username, {tsu('ts')} debut,
  {tsu("case when nd = -1 then nts end")} fin,
  case when nd = -1 then (epoch_us(nts) - epoch_us(ts)) / 1e6 end duree_s
  from (select *, lead(ts) over (partition by conn order by ts, id) nts,
               lead(delta) over (partition by conn order by ts, id) nd
        from ({TRANSITIONS_SQL}) t where delta <> 0) s where delta = 1"""


@q("presence_sessions", SESSIONS_SQL)
def _st8(fx):
    return _micro(ST.presence_sessions(fx["chat_events"]), "debut", "fin")

"""Query registry: one entry per operator of the inventory.

Each entry is a Spark builder ``(spark, sf_dir) -> DataFrame`` over the shop
views derived from the test data, plus (where SQL can say it) the same query
as DuckDB SQL for the correctness gate. Result columns are rendered at the
edge the way the source's API returns them: money as double (summed exactly as
decimal first), timestamps and dates as text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.functions import scalars as FX
from tillgrid.operators import filters as P
from tillgrid.operators import joins as J
from tillgrid.operators import ledger as W
from tillgrid.operators import reports as A
from tillgrid.plans import requests as R
from tillgrid.plans.oracle_views import with_views
from tillgrid.sources import export as X
from tillgrid.sources import payloads as S4
from tillgrid.sources import schemas as S
from tillgrid.session import shared_dir, written
from tillgrid.sources.fixtures import ShopFixture, shop, union_all
from tillgrid.streaming import presence as ST

# Fixed parameters of the registered queries (see FIXTURES.md section 4).
AS_OF = dt.date(2000, 1, 31)
PERIOD = (dt.date(2000, 1, 1), dt.date(2000, 1, 31))
DAY = dt.date(2000, 1, 4)
SQL_PERIOD = "date '2000-01-01' and date '2000-01-31'"
SQL_DAY = "date '2000-01-04'"
# A period with more rows than the histories show.
WIDE = (dt.date(1995, 1, 1), dt.date(2000, 1, 31))
SQL_WIDE = "date '1995-01-01' and date '2000-01-31'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    """Render decimals as double and timestamps/dates as text (the API's JSON shape)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.TimestampNTZType):
            c = FX.ntz_text(c)
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def q(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge(fn(shop(spark, sf_dir)))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return fn
    return deco


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def tsu(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def dd(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def m(x: str) -> str:
    return f"cast({x} as double)"


VENTES_OUT = (f"id, {m('total')} total, paiement, mobile_operateur, mobile_reference, statut, "
              f"{m('monnaie')} monnaie, {ts('date_vente')} date_vente, user_id")
PRODUITS_OUT = f"id, nom, code_barres, {m('prix')} prix, stock, stock_alerte, categorie_id, actif"


# ============================================================ S: sources & sinks
@q("load_shop", f"select {VENTES_OUT} from ventes")
def _s1(fx: ShopFixture):
    """Sales written month-partitioned to the shared folder, read back with explicit schemas."""
    root = S.write_shop({"ventes": fx["ventes"]}, shared_dir(fx.spark, "shop"), grain="month")
    return S.load_shop(fx.spark, root, ["ventes"])["ventes"].drop("mois")


MONEY_OF = {t: next(f.name for f in s.fields if f.dataType == S.MONEY) for t, s in S.SCHEMAS.items() if any(f.dataType == S.MONEY for f in s.fields)}


@q("load_shop_tables", " union all ".join(
    f"select '{t}' table_name, count(*) n, cast(sum(id) as bigint) ids, {m(f'sum({MONEY_OF[t]})') if t in MONEY_OF else 'cast(null as double)'} montant from {t}"
    for t in S.SCHEMAS))
def _s1_all(fx: ShopFixture):
    """Rows, ids and amounts of all eleven tables after a round trip, line tables partitioned by their parent's month."""
    root = S.write_shop({t: fx[t].select(*[c for c in s.fieldNames() if c in fx[t].columns]) for t, s in S.SCHEMAS.items()},
                        shared_dir(fx.spark, "shop"), grain="month")
    parts = [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.sum("id").alias("ids"),
                    (F.sum(MONEY_OF[t]) if t in MONEY_OF else F.lit(None)).cast("double").alias("montant"))
             for t, df in S.load_shop(fx.spark, root).items()]
    return union_all(parts)


@q("apply_defaults", f"""select id, nom, code_barres, {m('prix')} prix,
  coalesce(case when stock < 0 then null else stock end, 0) stock, 5 stock_alerte, categorie_id, 1 actif
  from produits""")
def _s2(fx):
    """Products missing alert/active columns and with NULL (negative) stock get defaults."""
    p = fx["produits"].drop("stock_alerte", "actif")
    p = p.withColumn("stock", F.when(F.col("stock") < 0, F.lit(None)).otherwise(F.col("stock")))
    return S.apply_defaults(p, "produits")


@q("evolve_schema", f"""select id, {m('total')} total, paiement,
  case when date_vente < timestamp '1998-01-01' then null else mobile_operateur end mobile_operateur,
  case when date_vente < timestamp '1998-01-01' then null else mobile_reference end mobile_reference,
  case when date_vente < timestamp '1998-01-01' then 'validee' else statut end statut,
  {m('monnaie')} monnaie, {ts('date_vente')} date_vente, user_id from ventes""")
def _s3(fx):
    """S3: sales before 1998 come from old-layout files without the late columns."""
    v = fx["ventes"]
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    old = v.filter(F.col("date_vente") < cut).drop("mobile_operateur", "mobile_reference", "statut")
    new = v.filter(F.col("date_vente") >= cut)
    return S.union_generations(old, new, "ventes")


@q("parse_sale_payloads", """
  with n as (select vente_id, count(*) n, sum(quantite) u from vente_items group by vente_id)
  select v.id source_id, case when v.id % 50 = 7 then null else v.id end request_id,
         case when v.id % 50 = 7 then null else coalesce(n.n, 0) end n_items,
         case when v.id % 50 = 7 then null else cast(coalesce(n.u, 0) as bigint) end units,
         case when v.id % 50 = 7 then 'json_invalide' end rejet
  from ventes v left join n on n.vente_id = v.id""")
def _s4(fx):
    """One checkout payload per sale parsed back into headers + lines; broken JSON rejected."""
    t = S4.tag_payloads(R.sale_payloads(fx), "sale")
    ok = F.col("rejet").isNull()
    units = F.aggregate(F.coalesce(F.col("p.items"), F.array()), F.lit(0).cast("long"),
                        lambda acc, x: acc + x["quantite"].cast("long"))
    return t.select("source_id", F.when(ok, F.col("p.request_id")).alias("request_id"),
                    F.when(ok, S4.item_count()).alias("n_items"), F.when(ok, units).alias("units"), "rejet")


@q("export_sales_csv", """select id, strftime(date_vente, '%Y-%m-%d %H:%M:%S') date_vente, statut, paiement,
  coalesce(mobile_operateur, '') operateur, coalesce(mobile_reference, '') reference,
  cast(total as double) total, cast(monnaie as double) monnaie
  from ventes order by date_vente desc, id desc limit 2000""")
def _s5(fx):
    """The newest 2,000 sales in export shape."""
    return X.export_sales(fx["ventes"])


@q("export_purchases_csv", """select a.id, strftime(a.date_achat, '%Y-%m-%d %H:%M:%S') date_achat,
  coalesce(f.nom, '-') fournisseur, coalesce(a.reference, '') reference, cast(a.total as double) total
  from (select * from achats order by date_achat desc, id desc limit 2000) a
  left join fournisseurs f on f.id = a.fournisseur_id""")
def _s6(fx):
    """The newest 2,000 purchases with supplier names in export shape."""
    return X.export_purchases(fx["achats"], fx["fournisseurs"])


@q("rows_to_json", """select to_json(struct_pack(id := p.id, nom := p.nom, code_barres := p.code_barres,
  prix := cast(p.prix as double), stock := p.stock, stock_alerte := p.stock_alerte, categorie_id := p.categorie_id, actif := p.actif,
  categorie_nom := c.nom)) json
  from produits p left join categories c on c.id = p.categorie_id where p.actif = 1""")
def _s7(fx):
    """The product catalogue as JSON objects (NULLs kept)."""
    cat = J.catalog(fx["produits"], fx["categories"])
    return X.rows_to_json(cat.select("id", "nom", "code_barres", "prix", "stock", "stock_alerte", "categorie_id", "actif", "categorie_nom"))


# ============================================================ P: filters
@q("active_products", f"select {PRODUITS_OUT} from produits where actif = 1")
def _p1(fx):
    return P.active(fx["produits"])


@q("list_categories", "select id, nom, couleur from categories")
def _p2(fx):
    return P.categories(fx["categories"])


@q("active_suppliers", f"select id, nom, contact, telephone, email, adresse, actif, {ts('created_at')} created_at "
                       "from (select *, null contact, null telephone, null email, null adresse, "
                       "cast(null as timestamp) created_at from fournisseurs) where actif = 1")
def _p3(fx):
    return P.suppliers(fx["fournisseurs"])


@q("valid_sales", f"select {VENTES_OUT} from ventes where statut = 'validee'")
def _p4(fx):
    return P.valid_sales(fx["ventes"])


@q("sales_on_day", f"select {VENTES_OUT} from ventes where cast(date_vente as date) = {SQL_DAY}")
def _p5(fx):
    return P.on_day(fx["ventes"], "date_vente", DAY)


@q("sales_between_days", f"select {VENTES_OUT} from ventes where cast(date_vente as date) between {SQL_PERIOD}")
def _p6(fx):
    return P.between_days(fx["ventes"], "date_vente", *PERIOD)


@q("optional_period", f"""select id, fournisseur_id, {m('total')} total, reference, notes, user_id,
  {ts('date_achat')} date_achat from achats""")
def _p7(fx):
    """Only one bound given -> no period filter at all."""
    return P.optional_period(fx["achats"].drop("notes").withColumn("notes", F.lit(None).cast("string"))
                             .select("id", "fournisseur_id", "total", "reference", "notes", "user_id", "date_achat"),
                             "date_achat", PERIOD[0], None)


@q("optional_period_both", f"""select id, fournisseur_id, {m('total')} total, reference, user_id,
  {ts('date_achat')} date_achat from achats where cast(date_achat as date) between {SQL_PERIOD}""")
def _p7_both(fx):
    """Both bounds given -> rows of the period."""
    return P.optional_period(fx["achats"].select("id", "fournisseur_id", "total", "reference", "user_id", "date_achat"), "date_achat", *PERIOD)


@q("resolve_period", f"""select {VENTES_OUT} from ventes
  where cast(date_vente as date) between date '2000-01-01' and date '2000-01-31'""")
def _p8(fx):
    """The owner report's default period for as_of = 2000-01-31 (start = as_of - 30)."""
    a, b = P.resolve_period("owner", None, None, AS_OF)
    return P.between_days(fx["ventes"], "date_vente", a, b)


@q("product_search", f"""select {PRODUITS_OUT} from produits
  where lower(nom) like '%plate%' or lower(coalesce(code_barres, '')) like '%plate%'""")
def _p9(fx):
    """Checkout search for ' PLATE ' (trimmed, case-insensitive)."""
    return P.search(fx["produits"], " PLATE ", trim=True)


@q("barcode_lookup", """with s as (
    select case when id % 5 = 0 then concat(' ', code_barres, ' ') else code_barres end code from produits
      where code_barres is not null
    union all select concat('999', cast(id as varchar)) from produits where id % 9 = 0)
  select s.code, p.id produit_id, p.nom produit_nom, p.stock produit_stock,
    case when p.id is null then 'unknown' when p.stock <= 0 then 'out_of_stock' else 'ok' end outcome
  from s left join (select * from produits where actif = 1) p on p.code_barres = trim(s.code)""")
def _p10(fx):
    """P10: every barcode scanned once (some padded) plus unknown codes, against the active catalogue."""
    return P.lookup(R.barcode_scans(fx), P.active(fx["produits"]))


@q("out_of_stock", "select id, nom, stock, stock_alerte from produits where actif = 1 and stock <= 0")
def _p11(fx):
    return P.out_of_stock(fx["produits"])


@q("low_stock", "select id, nom, stock, stock_alerte from produits where actif = 1 and stock > 0 "
                "and stock <= stock_alerte")
def _p12(fx):
    return P.low_stock(fx["produits"])


# ============================================================ J: joins
@q("product_catalog", f"""select p.id, p.nom, p.code_barres, {m('p.prix')} prix, p.stock, p.stock_alerte,
  p.categorie_id, p.actif, c.nom categorie_nom from produits p left join categories c on c.id = p.categorie_id
  where p.actif = 1""")
def _j1(fx):
    return J.catalog(fx["produits"], fx["categories"])


@q("cash_journal", f"""select e.id, e.type, e.evenement, e.vente_id, {m('e.montant')} montant, e.paiement,
  e.operateur, e.reference, e.details, {ts('e.created_at')} created_at, u.nom utilisateur
  from caisse_evenements e left join users u on u.id = e.user_id
  where cast(e.created_at as date) between {SQL_PERIOD}""")
def _j2(fx):
    return J.journal(fx["caisse_evenements"], fx["users"], *PERIOD)


RECEIPTS_SQL = f"""select v.id, {m('v.total')} total, v.paiement, v.mobile_operateur, v.mobile_reference,
  {m('v.monnaie')} monnaie, {ts('v.date_vente')} date_vente, i.id ligne_id, i.nom_produit,
  {m('i.prix_unitaire')} prix_unitaire, i.quantite, {m('i.sous_total')} sous_total
  from ventes v left join vente_items i on i.vente_id = v.id"""


@q("receipts", RECEIPTS_SQL)
def _j3(fx):
    return J.receipts(fx["ventes"], fx["vente_items"])


@q("receipts_nested", RECEIPTS_SQL)
def _j3_nested(fx):
    """J3 as one document per sale, written, read back and laid out flat for the comparison."""
    return J.receipt_lines(written(J.nested_receipts(fx["ventes"], fx["vente_items"]), "receipts"))


@q("purchase_history", f"""select a.id, a.fournisseur_id, {m('a.total')} total, a.reference, a.notes, a.user_id,
  {ts('a.date_achat')} date_achat, f.nom fournisseur_nom, u.nom utilisateur_nom,
  cast(coalesce(s.q, 0) as bigint) total_articles
  from achats a left join fournisseurs f on f.id = a.fournisseur_id left join users u on u.id = a.user_id
  left join (select achat_id, sum(quantite) q from achat_items group by achat_id) s on s.achat_id = a.id
  where cast(a.date_achat as date) between {SQL_WIDE}
  order by a.date_achat desc, a.id desc limit 200""")
def _j4(fx):
    return J.purchase_history(fx["achats"], fx["fournisseurs"], fx["users"], fx["achat_items"], *WIDE)


@q("expense_history", f"""select d.id, d.libelle, {m('d.montant')} montant, d.categorie, d.notes, d.user_id,
  {ts('d.date_depense')} date_depense, u.nom utilisateur_nom
  from (select id, libelle, montant, categorie, cast(null as varchar) notes, user_id, date_depense from depenses) d
  left join users u on u.id = d.user_id
  where cast(d.date_depense as date) between {SQL_WIDE} order by d.date_depense desc, d.id desc limit 200""")
def _j5(fx):
    return J.expense_history(fx["depenses"], fx["users"], *WIDE)


@q("sale_lines_valid", f"""select i.vente_id, i.id, i.produit_id, i.nom_produit, {m('i.prix_unitaire')} prix_unitaire,
  i.quantite, {m('i.sous_total')} sous_total, {ts('v.date_vente')} date_vente
  from vente_items i join ventes v on v.id = i.vente_id where v.statut = 'validee'""")
def _j6(fx):
    return J.sale_lines(fx["vente_items"], fx["ventes"])


# Exact decimal mean in DuckDB: avg(decimal) there is a double, while Spark's is
# decimal(22,6) rounded half up; integer arithmetic on cents gives the latter.
AVG_COST_SQL = """select produit_id,
    cast(cast((sum(cast(prix_achat * 100 as bigint)) * 20000 + count(*)) // (2 * count(*)) as decimal(38,0))
         * cast(0.000001 as decimal(7,6)) as decimal(22,6)) cout_moyen
  from achat_items group by produit_id"""


@q("cost_join", f"""with c as ({AVG_COST_SQL})
  select l.vente_id, l.id, l.produit_id, l.nom_produit, {m('l.prix_unitaire')} prix_unitaire, l.quantite,
    {m('l.sous_total')} sous_total, {ts('v.date_vente')} date_vente, {m('c.cout_moyen')} cout_moyen,
    {m('coalesce(c.cout_moyen, l.prix_unitaire * cast(0.70 as decimal(3,2)))')} cout_unitaire
  from vente_items l join ventes v on v.id = l.vente_id left join c on c.produit_id = l.produit_id
  where v.statut = 'validee'""")
def _j7(fx):
    return J.with_cost(J.sale_lines(fx["vente_items"], fx["ventes"]), fx["achat_items"])


@q("purchase_product_exists", f"""select i.id, i.achat_id, i.produit_id, i.nom_produit, {m('i.prix_achat')} prix_achat,
  i.quantite, {m('i.sous_total')} sous_total, i.l_suppkey, {ts('i.l_shipdate')} l_shipdate,
  p.id is not null produit_ok
  from achat_items i left join (select id from produits where actif = 1) p on p.id = i.produit_id""")
def _j8(fx):
    return J.known_active(fx["achat_items"], fx["produits"])


# ============================================================ A: aggregations
@q("day_kpis", f"""select count(*) nb_ventes, {m('coalesce(sum(total), 0)')} total_jour from ventes
  where cast(date_vente as date) = {SQL_DAY} and statut = 'validee'""")
def _a1(fx):
    return A.day_kpis(fx["ventes"], DAY)


@q("active_product_count", "select count(*) nb_produits from produits where actif = 1")
def _a2(fx):
    return A.active_count(fx["produits"])


@q("stock_alert_count", "select count(*) alertes_stock from produits where actif = 1 and stock <= stock_alerte")
def _a3(fx):
    return A.alert_count(fx["produits"])


@q("daily_sales_7d", f"""select {dd('cast(date_vente as date)')} jour, {m('sum(total)')} total from ventes
  where date_vente >= timestamp '2000-01-24 00:00:00' and statut = 'validee' group by cast(date_vente as date)""")
def _a4(fx):
    return A.daily_sales(fx["ventes"], AS_OF)


@q("daily_report_stats", f"""select {dd('cast(date_vente as date)')} jour, count(*) nb_ventes,
  {m('coalesce(sum(total), 0)')} total_jour,
  {m("coalesce(sum(case when paiement = 'mobile' then total else 0 end), 0)")} total_mobile,
  {m("coalesce(sum(case when paiement = 'especes' then total else 0 end), 0)")} total_especes
  from ventes where statut = 'validee' group by cast(date_vente as date)""")
def _a5(fx):
    """A5 for every day at once."""
    return A.daily_stats(fx["ventes"])


@q("mobile_operator_split", f"""select {dd('cast(date_vente as date)')} jour, coalesce(mobile_operateur, 'inconnu') operateur,
  count(*) nb, {m('coalesce(sum(total), 0)')} total from ventes where paiement = 'mobile' and statut = 'validee'
  group by cast(date_vente as date), coalesce(mobile_operateur, 'inconnu')""")
def _a6(fx):
    return A.operator_split(fx["ventes"])


@q("sales_with_item_counts", f"""select v.id, {m('v.total')} total, v.paiement, v.mobile_operateur, v.mobile_reference,
  {m('v.monnaie')} monnaie, {ts('v.date_vente')} date_vente, cast(coalesce(sum(i.quantite), 0) as bigint) total_articles
  from ventes v left join vente_items i on i.vente_id = v.id where v.statut = 'validee'
  group by v.id, v.total, v.paiement, v.mobile_operateur, v.mobile_reference, v.monnaie, v.date_vente""")
def _a7(fx):
    return A.sales_detail(fx["ventes"], fx["vente_items"])


@q("top_products_day", f"""select i.nom_produit, cast(sum(i.quantite) as bigint) quantite, {m('sum(i.sous_total)')} montant
  from vente_items i join ventes v on v.id = i.vente_id
  where cast(v.date_vente as date) = {SQL_DAY} and v.statut = 'validee'
  group by i.nom_produit order by quantite desc, i.nom_produit limit 5""")
def _a8(fx):
    return A.top_products(fx["vente_items"], fx["ventes"], DAY)


@q("period_revenue", f"""select {m('coalesce(sum(total), 0)')} ca from ventes
  where cast(date_vente as date) between {SQL_PERIOD} and statut = 'validee'""")
def _a9(fx):
    return A.revenue(fx["ventes"], *PERIOD)


@q("period_expenses", f"""select {m('coalesce(sum(montant), 0)')} depenses from depenses
  where cast(date_depense as date) between {SQL_PERIOD}""")
def _a10(fx):
    return A.expenses_total(fx["depenses"], *PERIOD)


@q("period_purchases", f"""select {m('coalesce(sum(total), 0)')} achats from achats
  where cast(date_achat as date) between {SQL_PERIOD}""")
def _a11(fx):
    return A.purchases_total(fx["achats"], *PERIOD)


@q("payment_mix", f"""select paiement, count(*) nb, {m('coalesce(sum(total), 0)')} total from ventes
  where cast(date_vente as date) between {SQL_PERIOD} and statut = 'validee' group by paiement""")
def _a12(fx):
    return A.payment_mix(fx["ventes"], *PERIOD)


@q("sales_by_cashier", f"""select e.user_id, u.nom caissier, count(*) nb, {m('coalesce(sum(e.montant), 0)')} total
  from caisse_evenements e left join users u on u.id = e.user_id
  where e.evenement = 'vente' and cast(e.created_at as date) between {SQL_PERIOD}
  group by e.user_id, u.nom""")
def _a13(fx):
    return A.by_cashier(fx["caisse_evenements"], fx["users"], *PERIOD)


@q("peak_hours", f"""select strftime(date_vente, '%H') heure, count(*) nb from ventes
  where cast(date_vente as date) between {SQL_PERIOD} and statut = 'validee'
  group by 1 order by nb desc, heure limit 5""")
def _a14(fx):
    return A.peak_hours(fx["ventes"], *PERIOD)


@q("avg_purchase_cost", f"select produit_id, {m('cout_moyen')} cout_moyen from ({AVG_COST_SQL})")
def _a15(fx):
    return J.avg_cost(fx["achat_items"])


@q("top_profitable_products", f"""with c as ({AVG_COST_SQL})
  select i.nom_produit, cast(sum(i.quantite) as bigint) quantite, {m('sum(i.sous_total)')} chiffre,
    {m('round(sum(i.sous_total - coalesce(c.cout_moyen, i.prix_unitaire * cast(0.70 as decimal(3,2))) * i.quantite), 2)')}
      marge_estimee
  from vente_items i join ventes v on v.id = i.vente_id left join c on c.produit_id = i.produit_id
  where cast(v.date_vente as date) between {SQL_PERIOD} and v.statut = 'validee'
  group by i.nom_produit order by marge_estimee desc, i.nom_produit limit 8""")
def _a16(fx):
    return A.top_profitable(fx["vente_items"], fx["ventes"], fx["achat_items"], *PERIOD)


@q("owner_kpis", f"""with k as (
    select (select coalesce(sum(total), 0) from ventes
              where cast(date_vente as date) between {SQL_PERIOD} and statut = 'validee') ca,
           (select coalesce(sum(montant), 0) from depenses where cast(date_depense as date) between {SQL_PERIOD}) dep,
           (select coalesce(sum(total), 0) from achats where cast(date_achat as date) between {SQL_PERIOD}) ach)
  select {m('ca')} ca, {m('dep')} depenses, {m('ach')} achats, {m('ca - dep - ach')} benefice_net from k""")
def _a17(fx):
    return A.owner_kpis(fx["ventes"], fx["depenses"], fx["achats"], *PERIOD)


FAST_AS_WRITTEN_SQL = """select p.id, p.nom, p.stock, p.stock_alerte, cast(coalesce(sum(vi.quantite), 0) as bigint) qte_7j,
    round(cast(coalesce(sum(vi.quantite), 0) as decimal(38,0)) / 7, 2) moyenne_jour
  from produits p left join vente_items vi on vi.produit_id = p.id
  left join ventes v on v.id = vi.vente_id and v.statut = 'validee' and v.date_vente >= timestamp '2000-01-24 00:00:00'
  where p.actif = 1 group by p.id, p.nom, p.stock, p.stock_alerte
  having coalesce(sum(vi.quantite), 0) > 0 order by qte_7j desc, p.id limit 12"""


@q("fast_movers_as_written", f"select id, nom, stock, stock_alerte, qte_7j, {m('moyenne_jour')} moyenne_jour "
                             f"from ({FAST_AS_WRITTEN_SQL})")
def _a18(fx):
    return A.fast_movers(fx["produits"], fx["vente_items"], fx["ventes"], AS_OF, mode="as_written")


@q("fast_movers_7d", """select p.id, p.nom, p.stock, p.stock_alerte, cast(sum(i.quantite) as bigint) qte_7j,
    cast(round(cast(sum(i.quantite) as decimal(38,0)) / 7, 2) as double) moyenne_jour
  from produits p join vente_items i on i.produit_id = p.id join ventes v on v.id = i.vente_id
  where p.actif = 1 and v.statut = 'validee' and v.date_vente >= timestamp '2000-01-24 00:00:00'
  group by p.id, p.nom, p.stock, p.stock_alerte having sum(i.quantite) > 0
  order by qte_7j desc, p.id limit 12""")
def _a19(fx):
    return A.fast_movers(fx["produits"], fx["vente_items"], fx["ventes"], AS_OF, mode="strict")


@q("reorder_suggestions", f"""select id, nom, stock, cast(moyenne_jour as double) moyenne_jour,
    cast(round_even(cast(moyenne_jour as double) * 10.0, 0) as bigint) stock_cible,
    greatest(cast(round_even(cast(moyenne_jour as double) * 10.0, 0) as bigint) - stock, 0) a_commander
  from ({FAST_AS_WRITTEN_SQL})
  where greatest(cast(round_even(cast(moyenne_jour as double) * 10.0, 0) as bigint) - stock, 0) > 0""")
def _a20(fx):
    return A.suggest(A.fast_movers(fx["produits"], fx["vente_items"], fx["ventes"], AS_OF, mode="as_written"))


@q("stock_status_counts", """select case when stock <= 0 then 'Rupture' when stock <= stock_alerte then 'Stock bas'
    else 'Stock OK' end statut, count(*) nb from produits where actif = 1 group by 1""")
def _a21(fx):
    return A.status_counts(fx["produits"])


@q("catalog_counts", """select (select count(*) from categories) categories,
  (select count(*) from produits where actif = 1) produits, (select count(*) from ventes) ventes""")
def _a22(fx):
    return A.counts(fx["categories"], fx["produits"], fx["ventes"])


# ============================================================ N, K, U
@q("top_products_per_day", f"""select * from (
  select {dd('jour')} jour, nom_produit, quantite, {m('montant')} montant,
    row_number() over (partition by jour order by quantite desc, nom_produit) rang
  from (select cast(v.date_vente as date) jour, i.nom_produit, cast(sum(i.quantite) as bigint) quantite,
          sum(i.sous_total) montant
        from vente_items i join ventes v on v.id = i.vente_id where v.statut = 'validee' group by 1, 2) t)
  where rang <= 5""")
def _n1(fx):
    return A.top_products_per_day(fx["vente_items"], fx["ventes"])


MOVES_SQL = """select i.produit_id, -i.quantite delta, v.date_vente ts, 'vente' kind, 0 kind_code, i.id ref_id
    from vente_items i join ventes v on v.id = i.vente_id
  union all select i.produit_id, i.quantite, c.created_at, 'annulation', 1, i.id
    from vente_items i join annulations_vente c on c.vente_id = i.vente_id
  union all select i.produit_id, i.quantite, a.date_achat, 'achat', 2, i.id
    from achat_items i join achats a on a.id = i.achat_id"""


def _moves(fx):
    return W.all_movements(fx["vente_items"], fx["ventes"], fx["annulations_vente"], fx["achat_items"], fx["achats"])


@q("stock_running_balance", f"""with mv as ({MOVES_SQL})
  select mv.produit_id, {ts('mv.ts')} ts, mv.kind, mv.ref_id, cast(mv.delta as bigint) delta,
    cast(p.stock + sum(mv.delta) over (partition by mv.produit_id order by mv.ts, mv.kind_code, mv.ref_id
      rows between unbounded preceding and current row) as bigint) solde
  from mv join produits p on p.id = mv.produit_id""")
def _n2(fx):
    return W.running_balance(_moves(fx), fx["produits"])


@q("recent_sales", f"select {VENTES_OUT} from ventes order by date_vente desc, id desc limit 100")
def _k1(fx):
    return A.recent_sales(fx["ventes"])


@q("build_cash_journal", f"""select id, type, evenement, vente_id, {m('montant')} montant, paiement, operateur,
  reference, details, user_id, {ts('created_at')} created_at from caisse_evenements""")
def _u1(fx):
    return fx["caisse_evenements"]


# ============================================================ F: scalar functions
@q("clean_text", """select id, nullif(trim(case when id % 3 = 0 then '   '
  else concat(' ', mobile_reference, ' ') end), '') ref from ventes""")
def _f1(fx):
    v = fx["ventes"]
    raw = F.when(F.col("id") % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), "mobile_reference", F.lit(" ")))
    return v.select("id", FX.clean_text(raw).alias("ref"))


@q("normalize_operator", """select id, lower(trim(coalesce(case when id % 2 = 0 then concat(' ', upper(mobile_operateur), ' ')
    else mobile_operateur end, ''))) operateur,
  lower(trim(coalesce(case when id % 2 = 0 then concat(' ', upper(mobile_operateur), ' ')
    else mobile_operateur end, ''))) in ('orange', 'mtn', 'moov') valide
  from ventes where paiement = 'mobile'""")
def _f2(fx):
    v = fx["ventes"].filter(F.col("paiement") == "mobile")
    sent = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.upper("mobile_operateur"), F.lit(" "))) \
        .otherwise(F.col("mobile_operateur"))
    return v.select("id", FX.normalize_operator(sent).alias("operateur"), FX.is_valid_operator(sent).alias("valide"))


@q("payment_label", """select id,
  case when paiement = 'mobile' then concat(coalesce(case mobile_operateur when 'orange' then 'Orange Money'
      when 'mtn' then 'MTN MoMo' when 'moov' then 'Moov Money' end, nullif(mobile_operateur, ''), 'Mobile'),
    case when coalesce(mobile_reference, '') <> '' then concat(' • ', mobile_reference) else '' end)
    else 'Espèces' end libelle,
  case when paiement = 'mobile' then concat(coalesce(case mobile_operateur when 'orange' then 'Orange Money CI'
      when 'mtn' then 'MTN MoMo CI' when 'moov' then 'Moov Money CI' end, 'Mobile Money'),
    case when coalesce(mobile_reference, '') <> '' then concat(' (', mobile_reference, ')') else '' end)
    else 'Espèces' end libelle_ticket
  from ventes""")
def _f3(fx):
    v = fx["ventes"]
    return v.select("id", FX.payment_label("paiement", "mobile_operateur", "mobile_reference").alias("libelle"),
                    FX.payment_label("paiement", "mobile_operateur", "mobile_reference", style="receipt")
                    .alias("libelle_ticket"))


@q("operator_label", """select id, coalesce(case coalesce(mobile_operateur, 'inconnu') when 'orange' then 'Orange Money'
  when 'mtn' then 'MTN MoMo' when 'moov' then 'Moov Money' when 'inconnu' then 'Mobile (non précisé)' end,
  coalesce(mobile_operateur, 'inconnu')) libelle from ventes where paiement = 'mobile'""")
def _f4(fx):
    v = fx["ventes"].filter(F.col("paiement") == "mobile")
    return v.select("id", FX.operator_label(F.coalesce(F.col("mobile_operateur"), F.lit("inconnu"))).alias("libelle"))


@q("stock_status", """select id, case when stock <= 0 then 'Rupture' when stock <= stock_alerte then 'Stock bas'
  else 'Stock OK' end statut from produits""")
def _f5(fx):
    return fx["produits"].select("id", FX.stock_status("stock", "stock_alerte").alias("statut"))


@q("stock_fill_pct", """select id, cast(greatest(0, least(100, floor(cast(stock as double) /
  cast(greatest(case when stock_alerte is null or stock_alerte = 0 then 5 else stock_alerte end * 4, 10) as double)
  * 100.0 + 0.5))) as int) pct from produits""")
def _f6(fx):
    return fx["produits"].select("id", FX.stock_fill_pct("stock", "stock_alerte").alias("pct"))


@q("sale_hour_minute", "select id, strftime(date_vente, '%H:%M') heure from ventes")
def _f7(fx):
    return fx["ventes"].select("id", FX.sale_hour_minute("date_vente").alias("heure"))


@q("make_barcode", "select id, concat('618', lpad(cast(id as varchar), 10, '0')) code_barres from produits")
def _f8(fx):
    return fx["produits"].select("id", FX.make_barcode("id").alias("code_barres"))

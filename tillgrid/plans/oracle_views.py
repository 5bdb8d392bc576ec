"""DuckDB text of the shop views over the test-data tables (the fixture mapping).

The oracle SQL of every query starts with ``WITH`` + the views it needs, so
DuckDB sees only the driver's pre-registered test-data tables.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "categories": """select cast(row_number() over (order by p_type) as bigint) id, p_type nom, '#22c55e' couleur
  from (select distinct p_type from part) t""",
    "produits": """select p_partkey id, p_name nom,
  case when p_partkey%7=0 then null else concat('618', lpad(cast(p_partkey as varchar),10,'0')) end code_barres,
  cast(p_retailprice as decimal(18,2)) prix, cast(p_size-10 as int) stock, cast(5+p_partkey%10 as int) stock_alerte,
  case when p_partkey%13=0 then null when p_partkey%17=0 then 99 else c.id end categorie_id,
  case when p_partkey%20=0 then 0 else 1 end actif
  from part left join categories c on c.nom=p_type""",
    "users": "select cast(n_nationkey as bigint) id, n_name nom from nation",
    "fournisseurs": """select s_suppkey id, s_name nom, case when s_suppkey%15=0 then 0 else 1 end actif from supplier""",
    "ventes": """select o_orderkey id, cast(o_totalprice as decimal(18,2)) total,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'mobile' when o_orderpriority='4-NOT SPECIFIED' then 'carte' else 'especes' end paiement,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then case o_custkey%4 when 0 then 'orange' when 1 then 'mtn' when 2 then 'moov' end end mobile_operateur,
  case when o_orderpriority in ('1-URGENT','2-HIGH') and o_orderkey%3<>0 then concat('REF',cast(o_orderkey as varchar)) end mobile_reference,
  case when o_orderstatus='F' then 'annulee' else 'validee' end statut,
  cast(case when o_orderpriority in ('3-MEDIUM','5-LOW') then (o_orderkey%5)*100 else 0 end as decimal(18,2)) monnaie,
  o_orderdate + to_hours(cast(o_orderkey%24 as int)) date_vente,
  case when o_custkey%50=0 then null else o_custkey%25 end user_id from orders""",
    "vente_items": """select l_orderkey*1000 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) id,
  l_orderkey vente_id, l_partkey produit_id, p_name nom_produit, cast(floor(l_extendedprice/l_quantity) as decimal(18,2)) prix_unitaire,
  cast(l_quantity as int) quantite, cast(l_extendedprice as decimal(18,2)) sous_total
  from lineitem join part on p_partkey=l_partkey where l_partkey%11<>0""",
    "achat_items": """select l_orderkey*1000 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) id,
  l_orderkey achat_id, l_partkey produit_id, p_name nom_produit,
  cast(floor(l_extendedprice/l_quantity*cast(0.6 as double)) as decimal(18,2)) prix_achat,
  cast(l_quantity as int) quantite,
  cast(cast(l_quantity as int)*floor(l_extendedprice/l_quantity*cast(0.6 as double)) as decimal(18,2)) sous_total,
  l_suppkey, l_shipdate
  from lineitem join part on p_partkey=l_partkey where l_returnflag='R' and l_partkey%3<>0""",
    "achats": """select achat_id id, case when achat_id%9=0 then null else min(l_suppkey) end fournisseur_id,
  cast(sum(sous_total) as decimal(18,2)) total,
  case when achat_id%4=0 then null else concat('F-',cast(achat_id as varchar)) end reference,
  cast(null as varchar) notes,
  case when achat_id%6=0 then null else achat_id%25 end user_id, min(l_shipdate) date_achat
  from achat_items group by achat_id""",
    "depenses": """select event_id id, concat(event_type,'-',cast(user_id as varchar)) libelle, cast(value as decimal(18,2)) montant,
  event_type categorie, user_id%25 user_id, ts - interval '24' year date_depense from events where event_type='error'""",
    "annulations_vente": """select id, id vente_id, case when id%3=0 then 'Annulation manuelle' else 'erreur prix' end motif, user_id,
  date_vente + to_hours(24) created_at from ventes where statut='annulee'""",
    "chat_events": """select event_id id, ts, user_id conn,
  case event_type when 'signup' then 'join' when 'error' then 'disconnect' else 'message' end kind,
  case when event_id%10=0 then 'spoof' else concat('u',cast(user_id as varchar)) end username from events""",
    # The cash journal is derived from the facts (operator U1).
    "caisse_evenements": """
  select v.id*4 id, 'entree' type, 'vente' evenement, v.id vente_id, v.total montant, v.paiement,
         v.mobile_operateur operateur, v.mobile_reference reference,
         concat('Vente de ', cast(coalesce(n.n, 0) as varchar), ' ligne(s)') details, v.user_id, v.date_vente created_at
    from ventes v left join (select vente_id, count(*) n from vente_items group by vente_id) n on n.vente_id = v.id
  union all
  select c.id*4+1, 'sortie', 'annulation', c.vente_id, v.total, v.paiement, v.mobile_operateur, v.mobile_reference,
         c.motif, c.user_id, c.created_at
    from annulations_vente c join ventes v on v.id = c.vente_id
  union all
  select a.id*4+2, 'sortie', 'achat', null, a.total, null, null, null,
         concat('Achat fournisseur ref ', coalesce(a.reference, '-')), a.user_id, a.date_achat
    from achats a
  union all
  select d.id*4+3, 'sortie', 'depense', null, d.montant, null, null, null, d.libelle, d.user_id, d.date_depense
    from depenses d""",
}

ORDER = ["categories", "produits", "users", "fournisseurs", "ventes", "vente_items", "achat_items", "achats",
         "depenses", "annulations_vente", "chat_events", "caisse_evenements"]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the shop views it references (and their dependencies)."""
    extra = extra or {}
    allv = {**VIEWS, **extra}
    order = ORDER + [k for k in extra]
    need: set[str] = set()
    stack = [v for v in allv if re.search(rf"\b{v}\b", body)]
    while stack:
        v = stack.pop()
        if v in need:
            continue
        need.add(v)
        for d in {x for x in allv if x != v and re.search(rf"\b{x}\b", allv[v])}:
            if d not in need:
                stack.append(d)
    ctes = [f"{v} as ({allv[v]})" for v in order if v in need]
    if not ctes:
        return body
    head = body.lstrip()
    if re.match(r"(?i)with\s", head):
        # The body has its own CTEs: append them after the views.
        return "with " + ",\n".join(ctes) + ",\n" + head[5:]
    return "with " + ",\n".join(ctes) + "\n" + body

"""Golden rows for the semantic traps of the inventory (tiny hand-written inputs)."""

import datetime as dt
import glob
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillgrid.functions import scalars as FX
from tillgrid.operators import filters as P
from tillgrid.operators import ledger as W
from tillgrid.operators import reports as A
from tillgrid.session import shared_dir
from tillgrid.sources import export as X
from tillgrid.sources import payloads as S4
from tillgrid.sources import schemas as S

TS = dt.datetime


def mk(spark, data, ddl):
    """DataFrame from tuples; decimal columns are given as whole numbers and cast."""
    dec = re.findall(r"(\w+) decimal\((\d+),(\d+)\)", ddl)
    df = spark.createDataFrame(data, re.sub(r"decimal\(\d+,\d+\)", "long", ddl))
    for name, p, sc in dec:
        df = df.withColumn(name, F.col(name).cast(f"decimal({p},{sc})"))
    return df


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


PRODUCTS = "id long, nom string, code_barres string, prix decimal(18,2), stock int, stock_alerte int, " \
           "categorie_id long, actif int"
SALES = "id long, total decimal(18,2), paiement string, mobile_operateur string, mobile_reference string, " \
        "statut string, monnaie decimal(18,2), date_vente timestamp_ntz, user_id long"
ITEMS = "id long, vente_id long, produit_id long, nom_produit string, prix_unitaire decimal(18,2), quantite int, " \
        "sous_total decimal(18,2)"


def test_update_without_stock_resets_and_absent_barcode_is_kept(spark):
    cur = mk(spark, [(1, "a", "6180000000001", 10, 40, 9, 3, 1), (2, "b", "6180000000002", 10, 7, 6, 3, 1)], PRODUCTS)
    ch = mk(spark, [
        (10, 1, "a2", 11.0, None, None, None, None, False),          # no stock/alert/category/barcode keys
        (11, 2, "b2", 12.0, 5, 2, 3, None, True),                     # explicit NULL barcode -> cleared
        (12, 7, "x", 1.0, None, None, None, None, False),             # unknown id
        (13, None, "new", 3.0, None, None, None, " 6180000000001 ", True),  # barcode held by product 1
        (14, None, "new2", 3.0, None, None, None, "  ", True),        # blank barcode -> NULL, defaults
    ], "request_seq long, id long, nom string, prix double, stock int, stock_alerte int, categorie_id long, "
       "code_barres string, has_code_barres boolean")
    out = {r["request_seq"]: r for r in rows(W.upsert_products(cur, ch, 100))}
    assert (out[10]["stock"], out[10]["stock_alerte"], out[10]["categorie_id"]) == (0, 5, None)
    assert out[10]["code_barres"] == "6180000000001" and out[10]["rejet"] is None
    assert out[11]["code_barres"] is None and out[11]["stock"] == 5
    assert out[12]["rejet"] == "introuvable"
    assert out[13]["rejet"] == "code_barres_duplique"
    assert out[14]["id"] == 114 and out[14]["code_barres"] is None and out[14]["stock"] == 0
    assert out[14]["stock_alerte"] == 5 and out[14]["actif"] == 1


def test_fill_gauge_reads_zero_alert_as_five(spark):
    df = spark.createDataFrame([(7, 0), (7, None), (-3, 4), (100, 1), (3, 2)], "stock int, alerte int")
    got = [r[0] for r in df.select(FX.stock_fill_pct("stock", "alerte")).collect()]
    # target 20 -> 35 %; clamp at 0; target max(4, 10) = 10 -> 100; 3/10 -> 30
    assert got == [35, 35, 0, 100, 30]


def test_cart_received_zero_means_exact_and_short_cash_is_rejected(spark):
    lines = spark.createDataFrame([(1, 100.0, 2), (2, 50.0, 1), (3, 10.0, 3)], "cart_id long, prix_unitaire double, quantite int")
    pay = spark.createDataFrame([(1, "especes", 0.0), (2, "especes", 20.0), (3, "mobile", 500.0), (4, "especes", 1.0)],
                                "cart_id long, paiement string, recu double")
    out = {r["cart_id"]: r for r in rows(W.cart_totals(lines, pay))}
    assert float(out[1]["monnaie"]) == 0 and float(out[1]["recu"]) == 200 and out[1]["rejet"] is None
    assert out[2]["rejet"] == "montant_insuffisant"
    assert float(out[3]["monnaie"]) == 0 and out[3]["rejet"] is None
    assert out[4]["rejet"] == "panier_vide"


def _shop(spark):
    prods = mk(spark, [(1, "p1", None, 10, 5, 5, None, 1), (2, "p2", None, 10, 50, 5, None, 1)], PRODUCTS)
    sales = mk(spark, [
        (1, 10, "especes", None, None, "annulee", 0, TS(1999, 1, 1, 10), 3),   # old and cancelled
        (2, 20, "mobile", None, None, "validee", 0, TS(2000, 1, 30, 9), None),
        (3, 30, "carte", None, None, "validee", 0, TS(2000, 1, 30, 11), 4),
    ], SALES)
    items = mk(spark, [(11, 1, 1, "p1", 10, 9, 90), (21, 2, 2, "p2", 10, 1, 10), (31, 3, 2, "p2", 10, 2, 20)], ITEMS)
    return prods, sales, items


def test_fast_movers_as_written_counts_all_time_and_cancelled_lines(spark):
    prods, sales, items = _shop(spark)
    written = {r["id"]: r["qte_7j"] for r in rows(A.fast_movers(prods, items, sales, "2000-01-31", "as_written"))}
    strict = {r["id"]: r["qte_7j"] for r in rows(A.fast_movers(prods, items, sales, "2000-01-31", "strict"))}
    assert written == {1: 9, 2: 3}
    assert strict == {2: 3}


def test_reorder_target_rounds_half_even(spark):
    fast = mk(spark, [(1, "a", 0, 0.25), (2, "b", 0, 0.35), (3, "c", 9, 0.43)],
                                 "id long, nom string, stock int, moyenne_jour double").withColumn("stock_alerte", F.lit(1))
    out = {r["id"]: r["a_commander"] for r in rows(A.suggest(fast))}
    assert out == {1: 2, 2: 4}  # 2.5 -> 2, 3.5 -> 4; item 3 needs nothing


def test_cashier_ranking_keeps_cancelled_sales_and_null_user(spark):
    prods, sales, items = _shop(spark)
    cancels = spark.createDataFrame([(1, 1, "x", 3, TS(2000, 1, 30, 12))],
                                    "id long, vente_id long, motif string, user_id long, created_at timestamp_ntz")
    empty_p = mk(spark, [], "id long, fournisseur_id long, total decimal(18,2), reference string, "
                                        "notes string, user_id long, date_achat timestamp_ntz")
    empty_d = mk(spark, [], "id long, libelle string, montant decimal(18,2), categorie string, notes string, "
                                        "user_id long, date_depense timestamp_ntz")
    sales2 = sales.withColumn("date_vente", F.when(F.col("id") == 1, F.lit(TS(2000, 1, 29))).otherwise(F.col("date_vente")))
    j = W.build_cash_journal(sales2, items, cancels, empty_p, empty_d)
    users = spark.createDataFrame([(3, "Awa"), (4, "Awa")], "id long, nom string")
    out = rows(A.by_cashier(j, users, "2000-01-01", "2000-01-31"), "user_id")
    assert [(r["user_id"], r["caissier"], r["nb"]) for r in out] == [(None, None, 1), (3, "Awa", 1), (4, "Awa", 1)]
    details = {r["evenement"]: r["details"] for r in j.collect()}
    assert details["vente"] == "Vente de 1 ligne(s)"


def test_one_period_bound_alone_is_ignored(spark):
    _, sales, _ = _shop(spark)
    assert P.optional_period(sales, "date_vente", "2000-01-01", None).count() == 3
    assert P.optional_period(sales, "date_vente", "2000-01-01", "2000-01-31").count() == 2
    assert P.between_days(sales, "date_vente", "2000-01-31", "2000-01-01").count() == 0


def test_owner_default_period_starts_thirty_days_before_today():
    assert P.resolve_period("owner", None, "2000-01-10", "2000-01-31") == (dt.date(2000, 1, 1), dt.date(2000, 1, 10))
    assert P.resolve_period("journal", "2000-01-05", None, "2000-01-31") == (dt.date(2000, 1, 5), dt.date(2000, 1, 5))


def test_cancel_first_request_wins(spark):
    _, sales, items = _shop(spark)
    req = spark.createDataFrame([(1, 2, " "), (2, 2, "again"), (3, 1, None), (4, 9, None)],
                                "request_seq long, vente_id long, motif string") \
        .withColumn("user_id", F.lit(1).cast("long")).withColumn("recu_le", F.lit(TS(2000, 2, 1)))
    out = W.cancel_sales(req, sales, items)
    d = {r["request_seq"]: (r["outcome"], r["motif"]) for r in out["decisions"].collect()}
    assert d == {1: ("ok", "Annulation manuelle"), 2: ("deja_annulee", "again"), 3: ("deja_annulee", "Annulation manuelle"),
                 4: ("introuvable", "Annulation manuelle")}
    assert {r["id"]: r["statut"] for r in out["ventes"].collect()}[2] == "annulee"
    assert [(r["produit_id"], r["delta"]) for r in out["mouvements"].collect()] == [(2, 1)]


def test_stock_on_hand_equals_last_running_balance(spark, fx):
    mv = W.all_movements(fx["vente_items"], fx["ventes"], fx["annulations_vente"], fx["achat_items"], fx["achats"])
    onhand = {r["id"]: r["stock"] for r in W.stock_on_hand(fx["produits"], mv).collect()}
    bal = W.running_balance(mv, fx["produits"])
    last = bal.groupBy("produit_id").agg(F.max_by("solde", F.struct("ts", "kind", "ref_id")).alias("s"))
    for r in last.collect():
        assert onhand[r["produit_id"]] == r["s"]


def test_payment_mix_adds_up_to_revenue(fx):
    mix = sum(float(r["total"]) for r in A.payment_mix(fx["ventes"], "1990-01-01", "2010-01-01").collect())
    assert mix == pytest.approx(float(A.revenue(fx["ventes"], "1990-01-01", "2010-01-01").first()["ca"]))


def test_insert_if_absent_is_idempotent(spark):
    cur = spark.createDataFrame([(1, "a")], "id long, nom string")
    new = spark.createDataFrame([(5, "b", 1.0), (3, "b", 2.0), (4, "a", 3.0)], "request_seq long, nom string, prix double")
    first = W.insert_if_absent(cur, new, 10)
    assert [(r["id"], r["nom"], r["prix"]) for r in first.collect()] == [(13, "b", 2.0)]
    again = cur.unionByName(first.select("id", "nom"))
    assert W.insert_if_absent(again, new, 20).count() == 0


def test_payment_labels(spark):
    df = spark.createDataFrame([("mobile", "orange", "R1"), ("mobile", "wave", None), ("mobile", "", ""),
                                ("carte", None, None), ("mobile", None, "X")], "p string, o string, r string")
    rep = [r[0] for r in df.select(FX.payment_label("p", "o", "r")).collect()]
    tic = [r[0] for r in df.select(FX.payment_label("p", "o", "r", style="receipt")).collect()]
    assert rep == ["Orange Money • R1", "wave", "Mobile", "Espèces", "Mobile • X"]
    assert tic == ["Orange Money CI (R1)", "Mobile Money", "Mobile Money", "Espèces", "Mobile Money (X)"]


def test_sale_validation(spark):
    h = spark.createDataFrame([(1, "mobile", " Orange ", "  "), (2, "mobile", "wave", "r"), (3, "especes", "mtn", "r"),
                               (4, None, None, None)],
                              "request_id long, paiement string, mobile_operateur string, mobile_reference string")
    out = {r["request_id"]: r for r in W.validate_sales(h).collect()}
    assert (out[1]["mobile_operateur"], out[1]["mobile_reference"], out[1]["rejet"]) == ("orange", None, None)
    assert out[2]["rejet"] == "operateur_invalide"
    assert (out[3]["mobile_operateur"], out[3]["mobile_reference"]) == (None, None)
    assert out[4]["paiement"] == "especes"


def test_purchase_first_failing_line_gives_the_reason(spark):
    prods = mk(spark, [(1, "p1", None, 1, 1, 1, None, 1), (2, "p2", None, 1, 1, 1, None, 0)], PRODUCTS)
    h = spark.createDataFrame([(i, 7, " F-1 ", None, 2, TS(2000, 1, 3)) for i in (1, 2, 3, 4)],
                              "request_id long, fournisseur_id long, reference string, notes string, user_id long, "
                              "recu_le timestamp_ntz")
    li = spark.createDataFrame([(1, 0, 1, 2.9, 5.0), (2, 0, 2, 1.0, 1.0), (2, 1, 1, 0.0, 1.0), (3, 0, 1, 0.5, 1.0)],
                               "request_id long, pos int, produit_id long, quantite double, prix_achat double")
    out = {r["request_id"]: r["rejet"] for r in W.validate_purchases(h, li, prods).collect()}
    assert out == {1: None, 2: "produit_introuvable", 3: "lignes_invalides", 4: "aucune_ligne"}
    rec = W.record_purchases(h, li, prods, 100)
    a = rec["achats"].first()
    assert (a["id"], float(a["total"]), a["reference"]) == (101, 10.0, "F-1")  # int(2.9) = 2 units x 5.0
    assert rec["caisse_evenements"].first()["details"] == "Achat fournisseur ref F-1"


def test_payload_parsing_rejects_broken_json(spark):
    df = spark.createDataFrame([(1, '{"request_id": 1, "total": 5, "items": [{"produit_id": 3, "nom_produit": "x", "prix_unitaire": 1, "quantite": 2, "sous_total": 2}]}'),
                                (2, '{"request_id": 2, "total": '), (3, '{"request_id": 3}')],
                               "source_id long, payload string")
    h, li, rej = S4.parse_payloads(df, "sale")
    assert [r["request_id"] for r in h.collect()] == [1]
    assert [(r["request_id"], r["pos"], r["quantite"]) for r in li.collect()] == [(1, 0, 2.0)]
    assert {r["source_id"]: r["rejet"] for r in rej.collect()} == {2: "json_invalide", 3: "champ_manquant"}


def test_defaults_and_evolution(spark):
    df = spark.createDataFrame([(1, "x", 0, None)], "id long, nom string, stock int, stock_alerte int")
    r = S.apply_defaults(df, "produits").first()
    assert (r["stock"], r["stock_alerte"], r["actif"], r["code_barres"]) == (0, 5, 1, None)
    old = spark.createDataFrame([(1, 5.0)], "id long, total double")
    e = S.evolve_schema(old, "ventes").first()
    assert (e["statut"], e["mobile_operateur"]) == ("validee", None)


def test_sales_csv_bytes(spark):
    sales = spark.createDataFrame([(1, 12.5, "mobile", None, 'a"b,c', "validee", 0.0, TS(2000, 1, 2, 3, 4, 5), None)],
                                  SALES.replace("decimal(18,2)", "double"))
    path = shared_dir(spark, "csv")
    X.export_sales(sales, path)
    (part,) = glob.glob(os.path.join(path.replace("file:", ""), "part-*.csv"))
    data = open(part, "rb").read()
    assert data.startswith(b"id,date_vente,statut,paiement,operateur,reference,total,monnaie\r\n")
    assert b'1,2000-01-02 03:04:05,validee,mobile,,"a""b,c",12.5,0.0\r\n' in data


def test_sliced_running_sum_and_carry_forward_match_brute_force(spark):
    from tillgrid.operators.strategy import carry_forward, running_sum
    import random
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "a", "a", "b"]), i, TS(2000, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 600)),
             rnd.randint(-5, 5), rnd.choice([None, None, "x", "y"])) for i in range(400)]
    data += [(None, 1000 + i, TS(2000, 1, 1), i, "z" if i % 7 == 0 else None) for i in range(300)]  # one key, one moment
    df = spark.createDataFrame(data, "k string, id long, ts timestamp_ntz, v int, s string")
    rs = {r["id"]: r["cum"] for r in running_sum(df, ["k"], ["ts", "id"], "v", "cum").collect()}
    cf = {r["id"]: r["prev"] for r in carry_forward(df, ["k"], ["ts", "id"], "s", "prev").collect()}
    pdf = pd.DataFrame(data, columns=["k", "id", "ts", "v", "s"]).sort_values(["k", "ts", "id"])
    pdf["cum"] = pdf.groupby("k", dropna=False)["v"].cumsum()
    pdf["prev"] = pdf.groupby("k", dropna=False)["s"].transform(lambda s: s.ffill().shift(1))
    for r in pdf.itertuples():
        assert rs[r.id] == r.cum
        assert cf[r.id] == (None if pd.isna(r.prev) else r.prev)


def test_day_partitioned_layout_prunes_period_reports(spark, fx):
    root = S.write_shop({"ventes": fx["ventes"]}, shared_dir(spark, "shop"), grain="month")
    v = S.load_shop(spark, root, ["ventes"])["ventes"]
    sel = P.between_days(v, "date_vente", "1995-03-01", "1995-03-31")
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mois" in plan and "mois#" in plan
    assert sel.count() == P.between_days(fx["ventes"], "date_vente", "1995-03-01", "1995-03-31").count()
    assert A.revenue(v, "1995-01-01", "1995-12-31").first()[0] == A.revenue(fx["ventes"], "1995-01-01",
                                                                            "1995-12-31").first()[0]


def test_line_tables_are_pruned_by_their_sales_day(spark, fx):
    from tillgrid.operators import joins as J
    root = S.write_shop({"ventes": fx["ventes"], "vente_items": fx["vente_items"]}, shared_dir(spark, "shop"), grain="month")
    t = S.load_shop(spark, root, ["ventes", "vente_items"])
    day = "1995-03-04"
    lines = P.on_day(J.sale_lines(t["vente_items"], t["ventes"]), "date_vente", day)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(.*?)\].*?PartitionFilters: \[(.*?)\]", plan)
    assert len(scans) >= 2 and all("mois" in filters for _, filters in scans)
    assert rows(A.top_products(t["vente_items"], t["ventes"], day)) == rows(A.top_products(fx["vente_items"], fx["ventes"], day))
    assert t["vente_items"].count() == fx["vente_items"].count()


def test_more_than_a_thousand_lines_have_distinct_ids(spark):
    n = 1001
    heads = spark.createDataFrame([(1, 5.0, "especes", None, None, 0.0, 1, TS(2000, 1, 1), n), (2, 5.0, "especes", None, None, 0.0, 1, TS(2000, 1, 1), 1)],
                                  "request_id long, total double, paiement string, mobile_operateur string, mobile_reference string, monnaie double, "
                                  "user_id long, recu_le timestamp_ntz, n_items int")
    lines = spark.createDataFrame([(1, i, 7, "p", 1.0, 1.0, 1.0) for i in range(n)] + [(2, 0, 7, "p", 1.0, 1.0, 1.0)],
                                  "request_id long, pos int, produit_id long, nom_produit string, prix_unitaire double, quantite double, sous_total double")
    out = W.record_sales(heads, lines, 100, 50)
    assert sorted(r.id for r in out["vente_items"].collect()) == list(range(51, 51 + n + 1))
    assert out["mouvements"].select("ref_id").distinct().count() == n + 1
    products = mk(spark, [(7, "p", None, 1, 0, 5, None, 1)], PRODUCTS)
    ph = heads.select("request_id", F.lit(None).cast("long").alias("fournisseur_id"), F.lit("r").alias("reference"), F.lit(None).cast("string").alias("notes"), "user_id", "recu_le")
    pl = lines.select("request_id", "pos", "produit_id", "quantite", F.col("prix_unitaire").alias("prix_achat"))
    bought = W.record_purchases(ph, pl, products, 100, 50)
    assert sorted(r.id for r in bought["achat_items"].collect()) == list(range(51, 51 + n + 1))


def test_two_changes_of_one_product_leave_one_row(spark):
    cur = mk(spark, [(1, "a", "618", 10, 40, 9, 3, 1), (2, "b", None, 10, 7, 6, 3, 1)], PRODUCTS)
    ch = mk(spark, [(1, 1, "a2", 1.0, 1, 1, None, "618", True), (2, 1, "a3", 1.0, 1, 1, None, "618", True), (3, 2, "b2", 1.0, 1, 1, None, None, False),
                    (4, 2, "b3", 1.0, 1, 1, None, None, False), (5, 2, "b4", 1.0, 1, 1, None, "618", True)],
            "request_seq long, id long, nom string, prix double, stock int, stock_alerte int, categorie_id long, code_barres string, has_code_barres boolean")
    decided = W.upsert_products(cur, ch, 100)
    assert [r["rejet"] for r in rows(decided, "request_seq")] == [None, None, None, None, "code_barres_duplique"]
    assert [(r["id"], r["nom"]) for r in rows(W.apply_product_changes(cur, decided), "id")] == [(1, "a3"), (2, "b3")]


def test_exports_print_amounts_like_the_source_and_can_be_unbounded(spark):
    sales = mk(spark, [(i, 1234567850 + i, "especes", None, None, "validee", 0, TS(2000, 1, 1, 0, 0, i % 60), 1) for i in range(30)], SALES)
    sales = sales.withColumn("total", (F.col("total") / 100).cast("decimal(18,2)"))
    path = shared_dir(spark, "csv")
    X.export_sales(sales, path, n=None)
    parts = sorted(glob.glob(path.replace("file:", "") + "/part-*"))
    lines = [x for p in parts for x in open(p, newline="").read().split("\r\n")[1:] if x]
    assert len(lines) == 30 and lines[0].startswith("29,") and ",12345678.5,0.0" in lines[-1]
    assert X.sales_export(sales, 7).count() == 7 and A.recent_sales(sales, None).count() == 30
    js = [r[0] for r in X.rows_to_json(sales.filter("id = 0").select("id", "total", "date_vente", "mobile_operateur", "statut")).collect()]
    assert js == ['{"id":0,"total":12345678.5,"date_vente":"2000-01-01 00:00:00","mobile_operateur":null,"statut":"validee"}']


def test_payload_items_need_their_keys_and_purchases_take_numbers_as_text(spark):
    full = '{"produit_id":1,"nom_produit":null,"prix_unitaire":2,"quantite":1,"sous_total":2}'
    docs = [(1, f'{{"request_id":1,"total":2,"items":[{full}]}}'), (2, '{"request_id":2,"total":2,"items":[{"produit_id":1}]}'), (3, '{"request_id":3,"total":0,"items":[]}')]
    tags = {r.source_id: r.rejet for r in S4.tag_payloads(spark.createDataFrame(docs, "source_id long, payload string"), "sale").collect()}
    assert tags == {1: None, 2: "champ_manquant", 3: None}
    doc = spark.createDataFrame([(1, '{"request_id":1,"items":[{"produit_id":"4","quantite":" 2 ","prix_achat":1.5},{"produit_id":5,"quantite":"x","prix_achat":"3"}]}')],
                                "source_id long, payload string")
    lines = rows(S4.parse_payloads(doc, "purchase")[1], "pos")
    assert [(r["produit_id"], r["quantite"], r["prix_achat"]) for r in lines] == [(4, 2.0, 1.5), (5, None, 3.0)]


def test_a_cluster_session_without_a_shared_folder_is_told_so():
    from types import SimpleNamespace
    from tillgrid.session import checkpoint_root
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(fake)

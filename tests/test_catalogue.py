"""Product edits in request order against a plain replay; JSON edits with absent and NULL keys."""

import random

from tillgrid.operators import catalogue, ledger

PRODUCTS = "id long, nom string, code_barres string, prix decimal(18,2), stock int, stock_alerte int, categorie_id long, actif int"
CHANGES = "request_seq long, id long, nom string, prix decimal(18,2), stock int, stock_alerte int, categorie_id long, code_barres string, has_code_barres boolean"


def replay(products, changes, base):
    """request_seq -> (product, barcode, reject) by applying one change after the other."""
    hold = {p: b for p, b in products}
    owner = {b: p for p, b in products if b}
    out = {}
    for seq, p, b, told in sorted(changes):
        target = base + seq if p is None else p
        b = (b or "").strip() or None
        if p is not None and p not in dict(products):
            out[seq] = (target, "introuvable")
            continue
        if p is None or told:
            if b and owner.get(b, target) != target:
                out[seq] = (target, "code_barres_duplique")
                continue
            if hold.get(target):
                del owner[hold[target]]
            hold[target] = b
            if b:
                owner[b] = target
        out[seq] = (target, None, hold.get(target))
    return out, {p: b for p, b in hold.items()}


def decided(spark, products, changes, base=1000):
    current = spark.createDataFrame([(p, f"p{p}", b, 1, 1, 1, None, 1) for p, b in products], "id long, nom string, code_barres string, prix int, stock int, stock_alerte int, categorie_id long, actif int")
    current = current.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in PRODUCTS.split(", ")])
    rows = spark.createDataFrame([(s, p, f"n{s}", b, t) for s, p, b, t in changes], "request_seq long, id long, nom string, code_barres string, has_code_barres boolean")
    rows = rows.selectExpr("*", "cast(2 as decimal(18,2)) prix", "cast(null as int) stock", "cast(null as int) stock_alerte", "cast(null as long) categorie_id")
    out = catalogue.upsert_products_in_order(current, rows, base)
    got = {r.request_seq: (r.id, r.rejet) if r.rejet else (r.id, None, r.code_barres) for r in out.collect()}
    table = {r.id: r.code_barres for r in ledger.apply_product_changes(current, out).collect()}
    return got, table


def test_hand_overs_swaps_and_random_batches(spark):
    products = [(1, "A"), (2, "B"), (3, None), (4, "D")]
    swap = [(0, 1, None, True), (1, 2, "A", True), (2, 1, "B", True), (3, 3, "A", True), (4, 2, "C", True), (5, 3, "A", True), (6, None, " A ", True),
            (7, 3, " ", True), (8, None, "A", True), (9, 9, "Z", True), (10, 4, "ignored", False), (11, 4, "E", True), (12, 4, "E", False), (13, None, "D", True)]
    assert decided(spark, products, swap) == replay(products, swap, 1000)
    rng = random.Random(6)
    many = [(s, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice(["A", "A", "A", "B", "C", "D", None]), rng.random() < 0.85) for s in range(60)]
    products += [(5, "E"), (6, None)]
    assert decided(spark, products, many) == replay(products, many, 1000)


def test_a_barcode_everybody_wants_takes_few_rounds(spark, monkeypatch):
    rounds, settle = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: rounds.append(name) or settle(df, name))
    products = [(p, None) for p in range(1, 301)]
    crowd = [(s, s + 1, "HOT", True) for s in range(300)]  # the first keeps it: all others are refused together
    assert decided(spark, products, crowd) == replay(products, crowd, 1000)
    assert rounds.count("verdicts") <= 3


def test_a_round_deals_its_events_twice(spark, monkeypatch):
    from tillgrid.operators import strategy
    names, keep = [], strategy.written
    monkeypatch.setattr(strategy, "written", lambda df, name: names.append(name) or keep(df, name))
    products = [(p, None) for p in range(1, 31)]
    crowd = [(s, s + 1, "HOT", True) for s in range(30)]
    assert decided(spark, products, crowd) == replay(products, crowd, 1000)
    # Two rounds, each by product and by barcode, and the barcodes that products keep.
    assert names.count("slices") <= 5 and names.count("rows") <= 1


def test_json_edits(spark):
    texts = ['{"id": 1, "nom": "a", "prix": 2.5}', '{"id": 1, "nom": "a", "prix": "3", "code_barres": null, "stock": 4}', '{"nom": "b", "prix": 1, "code_barres": "X", "stock": "many"}',
             '{"id": 2, "nom": " ", "prix": 1}', "[1]", "{", None, '{"nom": "c"}']
    good, rejects = catalogue.parse_product_changes(spark.createDataFrame(list(enumerate(texts)), "request_seq long, payload string"))
    assert [(r.request_seq, r.id, r.nom, float(r.prix), r.stock, r.code_barres, r.has_code_barres) for r in good.orderBy("request_seq").collect()] == [
        (0, 1, "a", 2.5, None, None, False), (1, 1, "a", 3.0, 4, None, True), (2, None, "b", 1.0, None, "X", True)]
    assert [(r.request_seq, r.rejet) for r in rejects.orderBy("request_seq").collect()] == [
        (3, "champ_manquant"), (4, "json_invalide"), (5, "json_invalide"), (6, "json_invalide"), (7, "champ_manquant")]
    products = spark.createDataFrame([(1, "p", "OLD")], "id long, nom string, code_barres string").selectExpr(
        "*", "cast(1 as decimal(18,2)) prix", "1 stock", "1 stock_alerte", "cast(null as long) categorie_id", "1 actif")
    got = catalogue.upsert_products_in_order(products, good, 10).orderBy("request_seq").collect()
    assert [(r.id, r.code_barres, r.rejet) for r in got] == [(1, "OLD", None), (1, None, None), (12, "X", None)]

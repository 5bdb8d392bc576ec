"""Presence and stock streams over several triggers against plain replays; receipts as documents; cancellations in place."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tillgrid.operators import joins, ledger
from tillgrid.session import shared_dir
from tillgrid.sources.commits import read_committed
from tillgrid.sources.schemas import SCHEMAS, load_shop, write_shop
from tillgrid.streaming import live as L
from tillgrid.streaming import presence_live as P

D = dt.datetime
CHAT = "id long, ts timestamp_ntz, conn long, kind string, username string"
START = D(2000, 1, 1)


def chat(n, hot=None):
    """Events of a few connections, one of them with most events; several at the same moment."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        conn = hot if hot is not None and rng.random() < 0.6 else rng.randrange(6)
        kind = rng.choice(["join", "message", "message", "disconnect"])
        rows.append((i, START + dt.timedelta(minutes=13 * (i // 2), microseconds=i % 3), conn, kind, rng.choice(["a", "b", None])))
    return rows


def replay(rows):
    """(messages relayed, [(conn, name, start, end)], [(id, delta, online)]) of events in (ts, id) order, one by one."""
    online, sessions, counts, messages = {}, {}, [], []
    closed = []
    for i, ts, conn, kind, name in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "message":
            if conn in online and online[conn] is not None and online[conn] == name:
                messages.append(i)
            continue
        delta = 0
        if kind == "join":
            if conn not in online:
                delta, sessions[conn] = 1, (name, ts)
            online[conn] = name
        elif conn in online:
            delta = -1
            del online[conn]
            closed.append((conn, *sessions.pop(conn), ts))
        counts.append((i, delta, len(online)))
    return messages, closed + [(c, n, t, None) for c, (n, t) in sessions.items()], counts


def late(col="ts", key="id"):
    return F.col(col) + F.when(F.col(key) % 7 == 0, F.make_dt_interval(F.lit(0), F.lit(20))).otherwise(F.make_dt_interval(F.lit(0)))


CUTS = ["2000-01-01 09:00:00", "2000-01-02 01:00:00", "2000-01-02 20:00:00", "2000-01-03 12:00:00", "2090-01-01 00:00:00"]


def chat_stream(spark, rows, name):
    events = spark.createDataFrame([*rows, (-1, D(2100, 1, 1), -1, "message", None), (-2, None, 1, "join", "x"), (-3, START, None, "join", "x")], CHAT)
    return L.feed(events, F.coalesce(late(), F.lit(START)), CUTS, shared_dir(spark, name))


def test_late_events_are_put_in_order(spark):
    rows = chat(500, hot=3)
    messages, sessions, counts = replay(rows)
    out = L.run_stream(P.gated_messages(chat_stream(spark, rows, "gated")), "gated", "append")
    assert sorted(r.id for r in L.read_result(spark, out, None, P.MESSAGES).collect()) == sorted(messages)
    out = L.run_stream(P.presence_sessions(chat_stream(spark, rows, "sessions")), "sessions", "append")
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 4  # state lived across triggers
    got = P.latest_sessions(L.read_result(spark, out, None, P.SESSIONS)).collect()
    assert sorted(((r.conn, r.username, r.debut, r.fin) for r in got), key=str) == sorted(sessions, key=str)
    root = shared_dir(spark, "counts")
    (P.transitions(chat_stream(spark, rows, "counted")).writeStream.outputMode("append").foreachBatch(P.count_batches(root))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    got = read_committed(spark, root, "counts", P.COUNTS).collect()
    assert sorted((r.id, r.delta, r.en_ligne) for r in got) == sorted(counts)


def test_connections_share_state_keys(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKETS", 3)
    rows = [(k, START + dt.timedelta(minutes=k // 100), k % 100, "join" if k < 100 else "message", "a") for k in range(300)]
    out = L.run_stream(P.gated_messages(chat_stream(spark, rows, "shared")), "shared", "append")
    assert L.read_result(spark, out, None, P.MESSAGES).count() == 200
    state = spark.read.format("statestore").option("stateVarName", "status").load(out.replace("/out", "/checkpoint"))
    assert state.select("key").distinct().count() <= 3


def test_a_trigger_is_evaluated_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf
    batch = spark.createDataFrame([(k, k, 1, "join", 1) for k in range(50)], "id long, us long, conn long, kind string, delta long")
    root = shared_dir(spark, "once")
    P.count_batches(root)(batch.mapInPandas(seen, batch.schema), 0)
    assert runs.value == 50 and read_committed(spark, root, "counts", P.COUNTS).agg(F.max("en_ligne")).first()[0] == 50


def test_a_trigger_s_movements_are_written_once(spark, monkeypatch):
    from tillgrid.operators import strategy
    names = []
    for module in (strategy, L):
        monkeypatch.setattr(module, "written", lambda df, name, keep=module.written: names.append(name) or keep(df, name))
    moves = spark.createDataFrame([(1, -2, START, "vente", k) for k in range(20)], "produit_id long, delta long, ts timestamp_ntz, kind string, ref_id long")
    root = shared_dir(spark, "lean")
    L.status_change_batches(spark.createDataFrame([(1, 10, 3)], "id long, stock int, stock_alerte int"), root)(moves, 0)
    assert names == ["slices"] and read_committed(spark, root, "changements", L.CHANGES).count() == 2


def test_a_stream_started_again_goes_on_from_its_state(spark):
    rows = chat(200)
    root = shared_dir(spark, "again")
    inbox = f"{root}/inbox"
    events = spark.createDataFrame([*rows, (-1, D(2100, 1, 1), -1, "message", None)], CHAT)
    for lo, hi in (("1999-01-01", "2000-01-01 16:00:00"), ("2000-01-01 16:00:00", "2200-01-01")):
        events.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))).write.mode("append").parquet(inbox)
        # A new query each time: nothing but the checkpoint tells it of the connections that are online.
        stream = spark.readStream.schema(CHAT).parquet(inbox)
        (P.presence_sessions(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    got = P.latest_sessions(spark.read.schema(P.SESSIONS).parquet(f"{root}/out")).collect()
    assert sorted(((r.conn, r.username, r.debut, r.fin) for r in got), key=str) == sorted(replay(rows)[1], key=str)


def test_advance():
    state, seen = None, []
    for event in [(1, 1, "message", "a"), (2, 2, "disconnect", "a"), (3, 3, "join", "a"), (4, 4, "join", "b"), (5, 5, "message", "a"), (6, 6, "message", "b"),
                  (7, 7, "disconnect", "b"), (8, 8, "message", "b")]:
        state, out = P.advance(state, event)
        seen.append(out[:3])
    assert seen == [(None, False, None), (0, None, None), (1, None, 3), (0, None, None), (None, False, None), (None, True, None), (-1, None, 3), (None, False, None)]


def test_status_changes_at_every_movement(spark):
    rng = random.Random(4)
    products = [(1, 10, 3), (2, 5, None), (3, 0, 4)]
    moves = [(rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([-4, -3, -1, 2, 3, 3]), START + dt.timedelta(hours=6 * (k // 3)), rng.choice(["vente", "achat"]), k) for k in range(150)]

    def status(stock, alert):
        return L.STATUS_OUT if stock <= 0 else L.STATUS_LOW if alert is not None and stock <= alert else L.STATUS_OK
    want, stock = [], {p: s for p, s, _ in products}
    alert = {p: a for p, _, a in products}
    for p, delta, ts, kind, ref in sorted(moves, key=lambda m: (m[2], ledger.MOVE_CODE[m[3]], m[4])):
        if p in stock:
            before = status(stock[p], alert[p])
            stock[p] += delta
            if status(stock[p], alert[p]) != before:
                want.append((p, ts, kind, ref, stock[p], status(stock[p], alert[p]), before))
    df = spark.createDataFrame(moves, "produit_id long, delta long, ts timestamp_ntz, kind string, ref_id long")
    stream = L.feed(df, F.col("ts"), ["2000-01-03 00:00:00", "2000-01-06 00:00:00", "2000-01-20 00:00:00"], shared_dir(spark, "changes"))
    root = shared_dir(spark, "changed")
    body = L.status_change_batches(spark.createDataFrame(products, "id long, stock int, stock_alerte int"), root)

    def twice(batch, n):  # a trigger that is run again replaces its own output
        body(batch, n)
        body(batch, n)
    (stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    got = read_committed(spark, root, "changements", L.CHANGES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 12


SALES = [(i, 10 * i, D(2024, 5, 1 + i % 4, 9, i)) for i in range(1, 41)]


def sales_tables(spark):
    sales = spark.createDataFrame([(i, t, at) for i, t, at in SALES], "id long, total int, date_vente timestamp_ntz")
    sales = sales.select("id", F.col("total").cast("decimal(18,2)").alias("total"), F.lit("especes").alias("paiement"), "date_vente", F.lit("validee").alias("statut"))
    lines = spark.range(1, 81).select(F.col("id"), (F.col("id") % 40 + 1).alias("vente_id"), (F.col("id") % 5).alias("produit_id"), F.lit("p").alias("nom_produit"),
                                      F.lit(5).cast("decimal(18,2)").alias("prix_unitaire"), F.lit(2).alias("quantite"), F.lit(10).cast("decimal(18,2)").alias("sous_total"))
    full = lambda df, n: df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[n]])
    return {"ventes": full(sales, "ventes"), "vente_items": full(lines, "vente_items")}


def test_receipts_as_documents(spark):
    t = sales_tables(spark)
    none = t["vente_items"].filter("vente_id <> 7")
    docs = joins.nested_receipts(t["ventes"], none)
    rows = {r.id: r for r in docs.collect()}
    assert len(rows) == 40 and rows[7].lignes == [] and all([x.ligne_id for x in r.lignes] == sorted(x.ligne_id for x in r.lignes) for r in rows.values())
    flat = sorted(map(str, joins.receipts(t["ventes"], none).select(joins.receipt_lines(docs).columns).collect()))
    assert sorted(map(str, joins.receipt_lines(docs).collect())) == flat
    assert [r.id for r in joins.nested_receipts(t["ventes"], none, spark.createDataFrame([(3,), (3,), (99,)], "id long")).collect()] == [3]
    path = shared_dir(spark, "documents")
    docs.write.parquet(path)
    plan = spark.read.parquet(path).select(F.col("lignes.quantite"))._jdf.queryExecution().executedPlan().toString()
    assert "lignes:array<struct<quantite:int>>" in plan  # of the nested lines, one field is read


def test_a_day_s_cancellations_rewrite_that_day(spark):
    path, root = shared_dir(spark, "shop"), shared_dir(spark, "cancelled")
    write_shop(sales_tables(spark), path)

    def files():
        rows = spark.read.parquet(f"{path}/ventes").select("jour", F.input_file_name().alias("f")).distinct().collect()
        return {str(d): sorted(r.f for r in rows if r.jour == d) for d in {r.jour for r in rows}}
    before = files()
    day = [i for i, _, at in SALES if at.day == 2]
    asked = [(k, i, "erreur", None, D(2024, 5, 9)) for k, i in enumerate([day[0], day[1], day[0], 999])]
    requests = spark.createDataFrame(asked, "request_seq long, vente_id long, motif string, user_id long, recu_le timestamp_ntz")
    outcomes = [r.outcome for r in ledger.cancel_stored(requests, path, root, 1).orderBy("request_seq").collect()]
    assert outcomes == ["ok", "ok", "deja_annulee", "introuvable"]
    after = files()
    assert {d for d in after if after[d] != before[d]} == {"2024-05-02"} and before.keys() == after.keys()
    sales = load_shop(spark, path, ["ventes"])["ventes"]
    assert sales.count() == 40 and sorted(r.id for r in sales.filter("statut = 'annulee'").collect()) == day[:2]
    assert read_committed(spark, root, "annulations_vente", SCHEMAS["annulations_vente"]).count() == 2
    again = ledger.cancel_stored(requests, path, root, 2)
    assert again.filter("outcome = 'ok'").count() == 0 and files() == after

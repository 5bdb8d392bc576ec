"""Catalogue tables changed in place: the same rows as the whole-table forms, and only the folders of changed ids rewritten."""

import pathlib

import pytest
from pyspark.sql import functions as F

from tillgrid.operators import ledger, stored
from tillgrid.plans import catalog_rules
from tillgrid.sources import payloads

DDL = "id long, nom string, actif int"


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet")}


def folders(path):
    return {f.split("/")[0] for f in files(path)}


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "nom", "actif").collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = spark.createDataFrame([(i, f"n{i}", 1) for i in range(1, 201)] + [(None, "no id", 1)], DDL)
    path = str(tmp_path / "t")
    stored.write_keyed(t, path, folders=16)
    return t, path


def test_only_folders_of_changed_ids_are_rewritten(spark, table):
    t, path = table
    assert rows(stored.read_keyed(spark, path, t.schema, 16)) == rows(t)
    before = files(path)
    ids = spark.createDataFrame([(7,), (7,), (9999,), (None,)], "id long")
    stored.soft_delete_stored(ids, path, t.schema, 16)
    assert rows(stored.read_keyed(spark, path, t.schema, 16)) == rows(ledger.soft_delete(t, ids))
    assert len({f.split("/")[0] for f in before ^ files(path)}) == 1  # 9999 is unknown: its folder stays
    before = files(path)
    stored.soft_delete_stored(spark.createDataFrame([(9999,)], "id long"), path, t.schema, 16)
    stored.change_stored(spark, path, t.schema, folders=16)
    stored.delete_stored(spark.createDataFrame([], "id long"), path, t.schema, 16)
    assert files(path) == before


def test_changes_inserts_and_deletes_run_again(spark, table):
    t, path = table
    decided = spark.createDataFrame([(0, 3, "first", 1, None), (1, 3, "last", 0, None), (2, 4, "refused", 0, "introuvable"), (3, 500, "new", 1, None)],
                                    "request_seq long, id long, nom string, actif int, rejet string")
    want = [r for r in rows(t) if r[0] not in (3, 11)] + [(3, "last", 0), (500, "new", 1)]
    for _ in range(2):  # a batch that is run again changes nothing more
        stored.apply_stored(decided, path, t.schema, 16)
        stored.delete_stored(spark.createDataFrame([(11,), (12345,)], "id long"), path, t.schema, 16)
        assert rows(stored.read_keyed(spark, path, t.schema, 16)) == sorted(want, key=str)
    both = spark.createDataFrame([(600, "gone at once", 1), (601, "stays", 1)], DDL)
    stored.change_stored(spark, path, t.schema, both, both.filter("id = 600").select("id"), 16)
    assert rows(stored.read_keyed(spark, path, t.schema, 16)) == sorted([*want, (601, "stays", 1)], key=str)


def test_a_folder_that_loses_its_last_row_goes(spark, table):
    t, path = table
    all_but_one = t.filter("id <> 1").select("id")
    stored.delete_stored(all_but_one, path, t.schema, 16)
    assert rows(stored.read_keyed(spark, path, t.schema, 16)) == sorted([(1, "n1", 1), (None, "no id", 1)], key=str)
    assert len(folders(path)) <= 2


def test_another_number_of_folders_is_refused(spark, table):
    t, path = table
    with pytest.raises(ValueError):
        stored.delete_stored(t.select("id"), path, t.schema, 32)


def test_a_hot_table_is_pruned(spark, table):
    """The scan of a change reads the touched folders alone."""
    t, path = table
    plan = stored.read_keyed(spark, path, t.schema, 16).filter(F.col("part16").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part16" in plan or "part16#" in plan.split("PartitionFilters")[1]


def test_a_payload_is_parsed_once(spark, fx):
    """The text is parsed in one place of the plan, and its keys looked at only where a value is NULL."""
    item = '{"produit_id":1,"nom_produit":%s,"prix_unitaire":1.0,"quantite":1,"sous_total":1.0}'
    sale = '{"request_id":%d,"total":2.0,"items":[%s]}'
    texts = [sale % (1, item % '"a"'), sale % (2, item % "null"), sale % (3, '{"produit_id":1}'), sale % (4, ""), sale % (5, "null"), '{"request_id":6,"total":2.0}', "{", None]
    sent = spark.createDataFrame(list(enumerate(texts)), "source_id long, payload string")
    headers, lines, rejects = payloads.parse_payloads(sent, "sale")
    assert sorted((r.request_id, r.n_items) for r in headers.collect()) == [(1, 1), (2, 1), (4, 0), (5, 1)]
    assert sorted((r.request_id, r.nom_produit) for r in lines.filter("produit_id = 1").collect()) == [(1, "a"), (2, None)]
    assert sorted((r.source_id, r.rejet, r.payload) for r in rejects.collect()) == [
        (2, "champ_manquant", texts[2]), (5, "champ_manquant", texts[5]), (6, "json_invalide", "{"), (7, "json_invalide", None)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in ledger.record_sales(headers, lines, 10, 10)["ventes"], rejects:
        assert plan(df).count("from_json") <= 3 and plan(df).count("request_id,LongType") == 1
    out = catalog_rules._recorded_lines(fx)
    assert "from_json" not in plan(out["vente_items"]) + plan(out["mouvements"])

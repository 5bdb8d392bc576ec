"""Product edits applied one after the other (W9 in request order), and their JSON requests with absent and NULL keys told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.functions.scalars import clean_text
from tillgrid.operators.strategy import carry_forward, look_back
from tillgrid.session import written
from tillgrid.sources.schemas import DEFAULTS, MONEY

#: After every request.
_NEVER = 1 << 62


def parse_product_changes(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(changes for W9, rejects) of JSON product edits; ``df`` has ``request_seq`` and the text.

    The text is read as VARIANT: ``has_code_barres`` is true where the key is there, be its value NULL or not. Values of
    another type than a field's are cast where that can be done and NULL otherwise. A text that is no JSON object, or has no name or price, is a reject.
    """
    v = df.select("request_seq", F.col(col).alias("_raw"), F.try_parse_json(col).alias("_v"))
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    fields = v.select("request_seq", "_raw", (F.schema_of_variant("_v").startswith("OBJECT")).alias("_object"), get("id", "long").alias("id"),
                      get("nom", "string").alias("nom"), get("prix", "decimal(18,2)").alias("prix"), get("stock", "int").alias("stock"),
                      get("stock_alerte", "int").alias("stock_alerte"), get("categorie_id", "long").alias("categorie_id"),
                      get("code_barres", "string").alias("code_barres"), get("code_barres", "variant").isNotNull().alias("has_code_barres"))
    bad = F.when(~F.coalesce("_object", F.lit(False)), "json_invalide").when(clean_text("nom").isNull() | F.col("prix").isNull(), "champ_manquant")
    tagged = fields.withColumn("rejet", bad)
    good = tagged.filter("rejet is null").drop("_raw", "_object", "rejet")
    return good, tagged.filter("rejet is not null").select("request_seq", F.col("_raw").alias("payload"), "rejet")


def _decide(events: DataFrame) -> DataFrame:
    """seq of the claims and releases that are accepted.

    ``events`` (seq, p, b, sure): products' barcodes over time; ``b`` NULL is a release, ``sure`` events are known to hold.
    In each round a claim is refused where a sure holder has no event, sure or not, up to it, and accepted
    where neither a sure holder nor an open claim can reach up to it. The earliest open claim is always decided, and so are all
    others that don't hang on an open hand-over: rounds follow the longest chain of hand-overs, not the number of claims.
    """
    now = written(events, "events")
    while not now.filter("not sure").isEmpty():
        # The first later event of the same product, and the first sure one.
        back = now.withColumns({"_back": -F.col("seq"), "_at": F.when(F.col("sure"), F.col("seq"))})
        d = look_back(back, ["p"], ["_back"], lasts={"_any": "seq", "_sure": "_at"}, cheap=True)
        d = d.select(*now.columns, F.coalesce("_any", F.lit(_NEVER)).alias("any_end"), F.coalesce("_sure", F.lit(_NEVER)).alias("sure_end"))
        d = written(d, "ends")
        on = d.filter("b is not null").withColumn("_holder", F.when(F.col("sure"), F.struct("p", "any_end", "sure_end"))).withColumn(
            "_open", F.when(~F.col("sure"), F.col("sure_end")))
        on = look_back(on, ["b"], ["seq"], lasts={"_last": "_holder"}, tops={"_reach": "_open"}, cheap=True).filter("not sure")
        other = F.coalesce(F.col("_last.p") != F.col("p"), F.lit(False))
        no = other & (F.col("_last.any_end") > F.col("seq"))
        yes = ~(other & (F.col("_last.sure_end") > F.col("seq"))) & (F.coalesce("_reach", F.lit(-1)) <= F.col("seq"))
        verdict = written(on.select("seq", F.when(no, False).when(yes, True).alias("accepted")).filter("accepted is not null"), "verdicts")
        now = written(now.join(verdict, "seq", "left").filter("coalesce(accepted, true)")
                         .select("seq", "p", "b", (F.col("sure") | F.col("accepted").isNotNull()).alias("sure")), "events")
    return now.filter("seq >= 0").select("seq")


def upsert_products_in_order(current: DataFrame, changes: DataFrame, base_id: int) -> DataFrame:
    """W9 with every change seeing what the changes before it left: a barcode that one gives up, the next may take.

    Rules, columns and defaults as ``ledger.upsert_products``; ``request_seq`` (0 or more, all different) is the order. A change that keeps
    its barcode keeps the one an earlier change of the batch gave the product. No product, barcode or moment is one task's work.
    """
    cur = current.select(F.col("id").alias("_cid"), F.col("code_barres").alias("_ccb"), F.col("actif").alias("_cactif"))
    c = changes.join(cur, changes.id == cur._cid, "left")
    is_insert = F.col("id").isNull()
    c = written(c.withColumns({
        "_insert": is_insert, "_unknown": ~is_insert & F.col("_cid").isNull(), "_target": F.when(is_insert, F.lit(base_id) + F.col("request_seq")).otherwise(F.col("id")),
        "_told": is_insert | F.col("has_code_barres"), "_cb": clean_text(F.coalesce(F.col("code_barres"), F.lit("")))}), "changes")
    told = c.filter("_told and not _unknown").select(F.col("request_seq").cast("long").alias("seq"), F.col("_target").alias("p"), F.col("_cb").alias("b"),
                                                     F.col("_cb").isNull().alias("sure"))
    claimed = told.filter("b is not null").select("b").distinct()
    held = current.filter(F.col("code_barres").isNotNull()).select(F.lit(-1).cast("long").alias("seq"), F.col("id").alias("p"), F.col("code_barres").alias("b"),
                                                                   F.lit(True).alias("sure")).join(claimed, "b", "left_semi").select("seq", "p", "b", "sure")
    accepted = _decide(told.unionByName(held)).withColumn("_ok", F.lit(True))
    d = c.join(accepted, c.request_seq == accepted.seq, "left").drop("seq")
    d = d.withColumn("_set", F.when(F.col("_ok") & F.col("_told"), F.struct(F.col("_cb").alias("b"))))
    d = carry_forward(d, ["_target"], ["request_seq"], "_set", "_had")
    kept = F.when(F.col("_had").isNotNull(), F.col("_had.b")).otherwise(F.col("_ccb"))
    rejet = F.when(F.col("_unknown"), "introuvable").when(F.col("_told") & F.col("_ok").isNull(), "code_barres_duplique")
    f = DEFAULTS["produits"]
    return d.select(
        "request_seq", F.when(F.col("_insert"), "insert").otherwise("update").alias("action"), F.col("_target").alias("id"), "nom",
        F.col("prix").cast(MONEY).alias("prix"), F.when(F.col("_told"), F.col("_cb")).otherwise(kept).alias("code_barres"),
        F.coalesce(F.col("stock"), F.lit(f["stock"])).cast("int").alias("stock"),
        F.coalesce(F.col("stock_alerte"), F.lit(f["stock_alerte"])).cast("int").alias("stock_alerte"), F.col("categorie_id").cast("long").alias("categorie_id"),
        F.when(F.col("_insert"), F.lit(f["actif"])).otherwise(F.col("_cactif")).cast("int").alias("actif"), rejet.alias("rejet"))

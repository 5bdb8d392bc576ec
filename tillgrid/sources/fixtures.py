"""Shop tables derived from the driver's test data (TPC-H-like tables + events).

The rules are the fixture mapping described in FIXTURES.md, written with the
DataFrame API. Every view is lazy: Catalyst prunes the test-data columns that a
query does not need and pushes its filters into the Parquet scans.

Scale notes: ``vente_items``/``achat_items`` number lines with a window
partitioned by order key (bounded by the lines of one order); ``categories``
numbers the distinct part types, a small dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillgrid.sources.schemas import MONEY

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _line_number(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return df.withColumn("_rn", F.row_number().over(w))


class ShopFixture:
    """Lazily built shop views over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = f"raw:{name}"
        if key not in self._cache:
            self._cache[key] = read_test_table(self.spark, self.sf_dir, name)
        return self._cache[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = getattr(self, f"_{name}")()
        return self._cache[name]

    def tables(self, *names: str) -> list[DataFrame]:
        return [self[n] for n in names]

    # -- dimensions -------------------------------------------------------
    def _categories(self) -> DataFrame:
        types = self.raw("part").select("p_type").distinct()
        return types.select(
            F.row_number().over(Window.orderBy("p_type")).cast("long").alias("id"),
            F.col("p_type").alias("nom"),
            F.lit("#22c55e").alias("couleur"),
        )

    def _produits(self) -> DataFrame:
        part = self.raw("part")
        cat = self["categories"].select(F.col("id").alias("_cat_id"), F.col("nom").alias("_cat_nom"))
        k = F.col("p_partkey")
        return part.join(cat, part.p_type == cat._cat_nom, "left").select(
            k.alias("id"),
            F.col("p_name").alias("nom"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("618"), F.lpad(k.cast("string"), 10, "0"))).alias("code_barres"),
            F.col("p_retailprice").cast(MONEY).alias("prix"),
            (F.col("p_size") - 10).cast("int").alias("stock"),
            (F.lit(5) + k % 10).cast("int").alias("stock_alerte"),
            F.when(k % 13 == 0, F.lit(None).cast("long")).when(k % 17 == 0, F.lit(99).cast("long"))
             .otherwise(F.col("_cat_id")).alias("categorie_id"),
            F.when(k % 20 == 0, 0).otherwise(1).alias("actif"),
        )

    def _users(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"),
                                         F.col("n_name").alias("nom"))

    def _fournisseurs(self) -> DataFrame:
        k = F.col("s_suppkey")
        null_s = F.lit(None).cast("string")
        return self.raw("supplier").select(
            k.alias("id"), F.col("s_name").alias("nom"),
            null_s.alias("contact"), null_s.alias("telephone"), null_s.alias("email"), null_s.alias("adresse"),
            F.when(k % 15 == 0, 0).otherwise(1).alias("actif"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    # -- facts ------------------------------------------------------------
    def _ventes(self) -> DataFrame:
        return ventes_from_orders(self.raw("orders"))

    def _lines_with_part(self, keep) -> DataFrame:
        li = self.raw("lineitem").filter(keep)
        part = self.raw("part").select("p_partkey", "p_name")
        return _line_number(li.join(part, li.l_partkey == part.p_partkey, "inner"))

    def _vente_items(self) -> DataFrame:
        df = self._lines_with_part(F.col("l_partkey") % 11 != 0)
        return df.select(
            (F.col("l_orderkey") * 1000 + F.col("_rn")).alias("id"),
            F.col("l_orderkey").alias("vente_id"),
            F.col("l_partkey").alias("produit_id"),
            F.col("p_name").alias("nom_produit"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast(MONEY).alias("prix_unitaire"),
            F.col("l_quantity").cast("int").alias("quantite"),
            F.col("l_extendedprice").cast(MONEY).alias("sous_total"),
        )

    def _achat_items(self) -> DataFrame:
        df = self._lines_with_part((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 3 != 0))
        unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * F.lit(0.6))
        return df.select(
            (F.col("l_orderkey") * 1000 + F.col("_rn")).alias("id"),
            F.col("l_orderkey").alias("achat_id"),
            F.col("l_partkey").alias("produit_id"),
            F.col("p_name").alias("nom_produit"),
            unit.cast(MONEY).alias("prix_achat"),
            F.col("l_quantity").cast("int").alias("quantite"),
            (F.col("l_quantity").cast("int") * unit).cast(MONEY).alias("sous_total"),
            "l_suppkey", "l_shipdate",
        )

    def _achats(self) -> DataFrame:
        a = F.col("achat_id")
        g = self["achat_items"].groupBy("achat_id").agg(
            F.min("l_suppkey").alias("_supp"), F.sum("sous_total").alias("_total"),
            F.min("l_shipdate").alias("date_achat"))
        return g.select(
            a.alias("id"),
            F.when(a % 9 == 0, F.lit(None).cast("long")).otherwise(F.col("_supp")).alias("fournisseur_id"),
            F.col("_total").cast(MONEY).alias("total"),
            F.when(a % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("F-"), a.cast("string")))
             .alias("reference"),
            F.lit(None).cast("string").alias("notes"),
            F.when(a % 6 == 0, F.lit(None).cast("long")).otherwise(a % 25).alias("user_id"),
            "date_achat",
        )

    def _depenses(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") == "error")
        return ev.select(
            F.col("event_id").alias("id"),
            F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("libelle"),
            F.col("value").cast(MONEY).alias("montant"),
            F.col("event_type").alias("categorie"),
            F.lit(None).cast("string").alias("notes"),
            (F.col("user_id") % 25).alias("user_id"),
            (F.col("ts") - F.make_ym_interval(F.lit(24), F.lit(0))).alias("date_depense"),
        )

    def _annulations_vente(self) -> DataFrame:
        return annulations_from_ventes(self["ventes"])

    def _chat_events(self) -> DataFrame:
        ev = self.raw("events")
        kind = (F.when(F.col("event_type") == "signup", "join")
                 .when(F.col("event_type") == "error", "disconnect").otherwise("message"))
        return ev.select(
            F.col("event_id").alias("id"), "ts", F.col("user_id").alias("conn"), kind.alias("kind"),
            F.when(F.col("event_id") % 10 == 0, "spoof")
             .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("username"),
        )

    def _caisse_evenements(self) -> DataFrame:
        from tillgrid.operators.ledger import build_cash_journal
        return build_cash_journal(self["ventes"], self["vente_items"], self["annulations_vente"],
                                  self["achats"], self["depenses"])


def ventes_from_orders(o: DataFrame) -> DataFrame:
    """Sales from orders; row-by-row, so it also maps a stream of orders."""
    k, prio, cust = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey")
    mobile = prio.isin("1-URGENT", "2-HIGH")
    return o.select(
        k.alias("id"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
        F.when(mobile, "mobile").when(prio == "4-NOT SPECIFIED", "carte").otherwise("especes").alias("paiement"),
        F.when(mobile, F.when(cust % 4 == 0, "orange").when(cust % 4 == 1, "mtn")
               .when(cust % 4 == 2, "moov")).alias("mobile_operateur"),
        F.when(mobile & (k % 3 != 0), F.concat(F.lit("REF"), k.cast("string"))).alias("mobile_reference"),
        F.when(F.col("o_orderstatus") == "F", "annulee").otherwise("validee").alias("statut"),
        F.when(prio.isin("3-MEDIUM", "5-LOW"), (k % 5) * 100).otherwise(0).cast(MONEY).alias("monnaie"),
        (F.col("o_orderdate") + _hours(k % 24)).alias("date_vente"),
        F.when(cust % 50 == 0, F.lit(None).cast("long")).otherwise(cust % 25).alias("user_id"),
    )


def annulations_from_ventes(v: DataFrame) -> DataFrame:
    """Cancellations of the cancelled sales, a day after the sale; row-by-row (stream-safe)."""
    v = v.filter(F.col("statut") == "annulee")
    return v.select(
        F.col("id"), F.col("id").alias("vente_id"),
        F.when(F.col("id") % 3 == 0, "Annulation manuelle").otherwise("erreur prix").alias("motif"),
        "user_id", (F.col("date_vente") + _hours(F.lit(24))).alias("created_at"),
    )


_FIXTURES: dict[tuple[int, str], ShopFixture] = {}


def shop(spark: SparkSession, sf_dir: str) -> ShopFixture:
    """The (lazy) views of one test-data folder, shared by all queries of a session.

    Sharing the DataFrame objects means each view is analysed once and a
    query that uses one view twice gets one plan subtree (exchange reuse).
    """
    key = (id(spark), sf_dir)
    fx = _FIXTURES.get(key)
    if fx is None or fx.spark is not spark:
        fx = _FIXTURES[key] = ShopFixture(spark, sf_dir)
    return fx


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)

"""Shop table schemas (S1), declared defaults (S2) and schema evolution (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
L, S, I, TS = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampNTZType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "categories": _schema(("id", L), ("nom", S), ("couleur", S)),
    "produits": _schema(("id", L), ("nom", S), ("code_barres", S), ("prix", MONEY), ("stock", I),
                        ("stock_alerte", I), ("categorie_id", L), ("actif", I)),
    "ventes": _schema(("id", L), ("total", MONEY), ("paiement", S), ("mobile_operateur", S),
                      ("mobile_reference", S), ("statut", S), ("monnaie", MONEY), ("date_vente", TS),
                      ("user_id", L)),
    "vente_items": _schema(("id", L), ("vente_id", L), ("produit_id", L), ("nom_produit", S),
                           ("prix_unitaire", MONEY), ("quantite", I), ("sous_total", MONEY)),
    "users": _schema(("id", L), ("nom", S)),
    "fournisseurs": _schema(("id", L), ("nom", S), ("contact", S), ("telephone", S), ("email", S),
                            ("adresse", S), ("actif", I), ("created_at", TS)),
    "achats": _schema(("id", L), ("fournisseur_id", L), ("total", MONEY), ("reference", S), ("notes", S),
                      ("user_id", L), ("date_achat", TS)),
    "achat_items": _schema(("id", L), ("achat_id", L), ("produit_id", L), ("nom_produit", S),
                           ("prix_achat", MONEY), ("quantite", I), ("sous_total", MONEY)),
    "depenses": _schema(("id", L), ("libelle", S), ("montant", MONEY), ("categorie", S), ("notes", S),
                        ("user_id", L), ("date_depense", TS)),
    "caisse_evenements": _schema(("id", L), ("type", S), ("evenement", S), ("vente_id", L), ("montant", MONEY),
                                 ("paiement", S), ("operateur", S), ("reference", S), ("details", S),
                                 ("user_id", L), ("created_at", TS)),
    "annulations_vente": _schema(("id", L), ("vente_id", L), ("motif", S), ("user_id", L), ("created_at", TS)),
}

# Declared column defaults of the shop tables.
DEFAULTS: dict[str, dict[str, object]] = {
    "categories": {"couleur": "#22c55e"},
    "produits": {"stock": 0, "stock_alerte": 5, "actif": 1},
    "ventes": {"paiement": "especes", "statut": "validee", "monnaie": 0},
    "fournisseurs": {"actif": 1},
}

# Columns added to older databases after the first release; ``statut`` is the
# only one with a value to backfill.
LATE_COLUMNS: dict[str, list[str]] = {
    "produits": ["code_barres"],
    "ventes": ["mobile_operateur", "mobile_reference", "statut"],
}


# Facts are stored partitioned by the calendar day (``jour``) or month (``mois``,
# first day of the month) of this column, so day and period reports read only
# the matching folders. Day suits large shops; month avoids thousands of tiny
# folders when a day holds only a few rows.
DAY_PARTITIONED = {"ventes": "date_vente", "achats": "date_achat", "depenses": "date_depense",
                   "annulations_vente": "created_at", "caisse_evenements": "created_at"}
PARTITION_COLS = {"day": "jour", "month": "mois"}
# Line tables carry their parent's day or month: (parent, its id on the line).
LINE_PARENTS = {"vente_items": ("ventes", "vente_id"), "achat_items": ("achats", "achat_id")}


def load_shop(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Read the shop tables (one Parquet folder per table) with explicit schemas.

    The scan is given the declared schema, so no footer is read to plan it; columns
    an older file lacks come back NULL and are evolved (S3). Partitioned
    tables keep their ``jour`` or ``mois`` column, which the date filters use for pruning.
    """
    out = {}
    for name in tables or list(SCHEMAS):
        df = spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}")
        out[name] = evolve_schema(df, name)
    return out


def write_shop(tables: dict[str, DataFrame], path: str, mode: str = "overwrite", grain: str = "day") -> str:
    """Write shop tables for ``load_shop``; facts and their lines partitioned by day or month.

    Lines get their parent's day, so the parent table must be among ``tables``
    for them to be partitioned; lines without a parent go to the NULL partition.

    The ``rebalance`` hint lets AQE size the write tasks from the data: quiet
    days are coalesced into one file, and a day holding a third of all sales
    is split into advisory-size pieces written by many tasks.
    """
    for name, df in tables.items():
        w, pcol = df, PARTITION_COLS[grain]
        period = lambda ts: F.to_date(ts) if grain == "day" else F.trunc(F.to_date(ts), "month")
        parent, key = LINE_PARENTS.get(name, (None, None))
        if name in DAY_PARTITIONED:
            w = df.withColumn(pcol, period(DAY_PARTITIONED[name]))
        elif parent in tables:
            days = tables[parent].select(F.col("id").alias(key), period(DAY_PARTITIONED[parent]).alias(pcol))
            w = df.join(days, key, "left").select(*df.columns, pcol)
        if pcol in w.columns:
            w = w.hint("rebalance", pcol)
            w.write.mode(mode).partitionBy(pcol).parquet(f"{path.rstrip('/')}/{name}")
        else:
            w.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
    return path


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill declared defaults where a value is absent (missing column) or NULL.

    Explicit falsy values (stock 0, actif 0) are kept: only NULL is replaced.
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in df.columns:
            c = F.col(field.name)
            if field.name in defaults:
                c = F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType))
            cols.append(c.cast(field.dataType).alias(field.name))
        elif field.name in defaults:
            cols.append(F.lit(defaults[field.name]).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def evolve_schema(df: DataFrame, table: str) -> DataFrame:
    """S3: accept files written before the late columns existed.

    Missing columns come back NULL except ``ventes.statut`` which is
    backfilled ``validee``; columns are then cast to the declared types.
    """
    schema = SCHEMAS[table]
    late = LATE_COLUMNS.get(table, [])
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in df.columns:
            c = F.col(field.name)
            if field.name in late and field.name in DEFAULTS.get(table, {}):
                c = F.coalesce(c, F.lit(DEFAULTS[table][field.name]))
        elif field.name in late and field.name in DEFAULTS.get(table, {}):
            c = F.lit(DEFAULTS[table][field.name])
        else:
            c = F.lit(None)
        cols.append(c.cast(field.dataType).alias(field.name))
    for pcol in PARTITION_COLS.values():
        if pcol in df.columns and pcol not in schema.fieldNames():
            cols.append(F.col(pcol).cast("date"))
    return df.select(*cols)


def union_generations(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Read an old-layout and a new-layout file set as one table (S3)."""
    return evolve_schema(new.unionByName(old, allowMissingColumns=True), table)

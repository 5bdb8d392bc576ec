"""Column helpers (F1-F8). All are built-in expressions: they stay inside
whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mobile-money operators accepted at checkout.
VALID_OPERATORS = ["orange", "mtn", "moov"]

# Operator display labels in the daily report (inconnu = unknown).
OPERATOR_LABELS = {
    "orange": "Orange Money",
    "mtn": "MTN MoMo",
    "moov": "Moov Money",
    "inconnu": "Mobile (non précisé)",
}

# Operator labels printed on a receipt, and the receipt fallback.
RECEIPT_OPERATOR_LABELS = {
    "orange": "Orange Money CI",
    "mtn": "MTN MoMo CI",
    "moov": "Moov Money CI",
}
RECEIPT_MOBILE_FALLBACK = "Mobile Money"

# Other display texts.
CASH_LABEL = "Espèces"
MOBILE_FALLBACK = "Mobile"
REPORT_REF_SEPARATOR = " • "
STATUS_OUT = "Rupture"
STATUS_LOW = "Stock bas"
STATUS_OK = "Stock OK"
BARCODE_PREFIX = "618"
BARCODE_DIGITS = 10
DEFAULT_ALERT = 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Trim leading/trailing white space (Unicode-aware, like ``str.strip``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """trimmed text, or NULL when empty/blank/NULL."""
    return F.nullif(strip_ws(c), F.lit(""))


def normalize_operator(c) -> Column:
    """operator code as compared at checkout: trimmed, lower case ('' when NULL)."""
    return F.lower(strip_ws(F.coalesce(_c(c), F.lit(""))))


def is_valid_operator(c) -> Column:
    """the normalised code is one of the accepted operators."""
    return normalize_operator(c).isin(*VALID_OPERATORS)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[key]


def _truthy(c: Column) -> Column:
    """JavaScript truthiness of a text value: not NULL and not empty."""
    return c.isNotNull() & (c != F.lit(""))


def payment_label(paiement, operateur, reference, style: str = "report") -> Column:
    """display label of a payment.

    ``report``: mobile -> operator label (else the raw code, else ``Mobile``),
    plus `` • ref`` when there is a reference; anything else -> ``Espèces``.
    ``receipt``: mobile -> receipt label (else ``Mobile Money``) plus `` (ref)``.
    """
    pay, op, ref = _c(paiement), _c(operateur), _c(reference)
    if style == "receipt":
        name = F.coalesce(_lookup(RECEIPT_OPERATOR_LABELS, op), F.lit(RECEIPT_MOBILE_FALLBACK))
        suffix = F.when(_truthy(ref), F.concat(F.lit(" ("), ref, F.lit(")"))).otherwise(F.lit(""))
    else:
        name = F.coalesce(_lookup({k: v for k, v in OPERATOR_LABELS.items() if k != "inconnu"}, op),
                          F.when(_truthy(op), op), F.lit(MOBILE_FALLBACK))
        suffix = F.when(_truthy(ref), F.concat(F.lit(REPORT_REF_SEPARATOR), ref)).otherwise(F.lit(""))
    return F.when(pay == F.lit("mobile"), F.concat(name, suffix)).otherwise(F.lit(CASH_LABEL))


def operator_label(operateur) -> Column:
    """operator display label; unknown codes are shown as they are."""
    op = _c(operateur)
    return F.coalesce(_lookup(OPERATOR_LABELS, op), op)


def stock_status(stock, alerte) -> Column:
    """Rupture when stock <= 0, Stock bas when stock <= alert, else Stock OK."""
    s, a = _c(stock), _c(alerte)
    return (F.when(s <= 0, F.lit(STATUS_OUT))
             .when(s <= a, F.lit(STATUS_LOW))
             .otherwise(F.lit(STATUS_OK)))


def stock_fill_pct(stock, alerte) -> Column:
    """fill gauge 0..100.

    target = max(alert * 4, 10) with a 0/NULL alert read as 5; the ratio is
    rounded half up (floor(x + 0.5)) and clamped to [0, 100].
    """
    s, a = _c(stock), _c(alerte)
    eff = F.when(a.isNull() | (a == 0), F.lit(DEFAULT_ALERT)).otherwise(a)
    target = F.greatest(eff * 4, F.lit(10))
    ratio = s.cast("double") / target.cast("double") * F.lit(100.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(ratio + F.lit(0.5)).cast("int")))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def hour_text(ts) -> Column:
    """``HH`` of a TIMESTAMP_NTZ from its own field (``date_format`` would pass
    through the session time zone and shift wall-clock times inside a DST gap)."""
    return _two(F.hour(_c(ts)))


def ntz_text(ts, micros: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.SSSSSS]`` of a TIMESTAMP_NTZ, built from its fields
    so that no time zone is involved."""
    t = _c(ts)
    parts = [F.to_date(t).cast("string"), F.lit(" "), _two(F.hour(t)), F.lit(":"), _two(F.minute(t)), F.lit(":"),
             _two(F.second(t))]
    if micros:
        frac = (F.extract(F.lit("SECOND"), t) * 1000000).cast("long") % 1000000
        parts += [F.lit("."), F.lpad(frac.cast("string"), 6, "0")]
    return F.concat(*parts)


def sale_hour_minute(ts) -> Column:
    """``HH:mm`` of a sale time."""
    t = _c(ts)
    return F.concat(_two(F.hour(t)), F.lit(":"), _two(F.minute(t)))


def make_barcode(n) -> Column:
    """F8: shop barcode for a catalogue index: prefix 618 + index on 10 digits."""
    return F.concat(F.lit(BARCODE_PREFIX), F.lpad(_c(n).cast("string"), BARCODE_DIGITS, "0"))

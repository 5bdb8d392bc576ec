"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

DataFrame functions only. A base pattern gives spans of its own kind. Further
candidates, runs of at least 20 letters, digits and ``+/_-`` that touch no
base span, are read as chains of characters: two first-order Markov models, one of random
strings and one of ordinary identifiers, give each its probability, and a
candidate whose log-likelihood ratio is high enough becomes a span of kind ``markov``. Both models are
trained from samples the corpus labels itself: values the base patterns found, and words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import boxed, let, unboxed, whole_text

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{3,}"
KINDS = ("assign", "access", "hex", "markov")

#: Symbols of the chains: letters in either case, digits; everything else is symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SYMBOLS = len(ALPHABET) + 1
#: Documents sampled (expected number, by a hash of the text) for random strings and for identifiers.
RANDOM_DOCS = 20_000
ORDINARY_DOCS = 1_000
#: Share of the uniform distribution in the model of random strings, whatever values were found.
UNIFORM = 0.5
#: Nats by which a candidate must be likelier random than ordinary.
RATIO = 12.0
MASK = "[SECRET]"

_BLOCK = 256


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches, in code points, end exclusive.

    The gaps between matches and the matches alternate, so places are running
    sums of lengths: within blocks of matches first, then over blocks.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def located(gaps: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: place(gaps, m, v)))

    def place(gaps: Column, m: Column, v: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def block(b: Column) -> Column:
            first = b * _BLOCK
            return F.aggregate(F.sequence(first, F.least(first + _BLOCK, F.size(m)) - 1), start, lambda a, i: let(
                a["at"] + F.length(F.get(gaps, i)), lambda s: let(s + F.length(F.get(m, i)), lambda e: F.struct(
                    e.alias("at"), F.array_append(a["out"], F.struct(s.alias("start"), e.alias("end"), F.get(v, i).alias("value"))).alias("out")))))

        def shifted(blocks: Column) -> Column:
            ends = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["at"]))
            return let(ends, lambda at: F.flatten(F.transform(blocks, lambda x, b: F.transform(x["out"], lambda s: F.struct(
                (s["start"] + F.get(at, b)).alias("start"), (s["end"] + F.get(at, b)).alias("end"), s["value"].alias("value"))))))

        last = F.floor((F.size(m) - 1) / _BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), block), shifted)

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), located)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array<struct<start, end, value>> of the base patterns; the value is the secret itself.

    ``access`` and ``hex`` runs are maximal, so asking for their least length in
    the pattern finds what dropping the shorter matches leaves.
    """
    return {
        "assign": F.filter(_found(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6),
        "access": _found(text, ACCESS),
        "hex": _found(text, HEX),
    }


@dataclass(frozen=True)
class Chains:
    """Log-likelihood ratio of each transition, row by row: random over ordinary."""

    ratios: tuple[float, ...]

    def score(self, value: Column) -> Column:
        """Sum over the transitions of ``value``; 0 for fewer than two characters."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        lower = F.lower(value)
        symbols = F.transform(F.sequence(F.lit(1), F.length(lower)), lambda i: F.instr(F.lit(ALPHABET), F.substr(lower, i, F.lit(1))))
        return F.when(F.length(value) < 2, 0.0).otherwise(let(symbols, lambda s: F.aggregate(
            F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(s, i - 1) * SYMBOLS + F.get(s, i)))))


def transitions(values: DataFrame) -> dict[tuple[int, int], int]:
    """How often each symbol follows each in column ``value``; at most 37 x 37 rows reach the driver."""
    lower = F.lower("value")
    pairs = values.filter(F.length("value") >= 2).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length(lower) - 1), lambda i: F.substr(lower, i, F.lit(2)))).alias("pair"))
    code = [F.instr(F.lit(ALPHABET), F.substr("pair", F.lit(k), F.lit(1))) for k in (1, 2)]
    rows = pairs.groupBy("pair").count().groupBy(code[0].alias("a"), code[1].alias("b")).agg(F.sum("count").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def train(random: DataFrame, ordinary: DataFrame) -> Chains:
    """Chains of two labelled samples (column ``value``). Empty samples leave a uniform model."""
    logs = []
    for sample, uniform in ((random, UNIFORM), (ordinary, 0.0)):
        n = transitions(sample)
        row = [sum(n.get((a, b), 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
        logs.append([math.log(uniform / SYMBOLS + (1 - uniform) * (n.get((a, b), 0) + 0.5) / (row[a] + 0.5 * SYMBOLS))
                     for a in range(SYMBOLS) for b in range(SYMBOLS)])
    return Chains(tuple(r - o for r, o in zip(*logs, strict=True)))


def _sample(docs: DataFrame, expected: int, total: int) -> DataFrame:
    """Texts drawn by a hash of themselves: ``expected`` of ``total`` rows on average, all when there are fewer."""
    texts = docs.select(whole_text().alias("text"))
    if total <= expected:
        return texts
    return texts.filter(F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1 << 40)) < int((1 << 40) * expected / total))


def train_on(docs: DataFrame) -> Chains:
    """Chains from bounded samples of ``docs``: values of base spans, and words without digits inside such values."""
    total = docs.count()
    base = base_spans(F.col("text"))
    values = F.concat(*[F.transform(c, lambda x: x["value"]) for c in base.values()])
    random = _sample(docs, RANDOM_DOCS, total).select(F.explode(F.array_distinct(values)).alias("value"))
    words = _sample(docs, ORDINARY_DOCS, total).select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    # What a base pattern would call a value isn't an ordinary word.
    return train(random, words.filter(~F.col("value").rlike(f"^(?:{ACCESS}|{HEX})$") & ~F.col("value").rlike("[0-9].*[0-9].*[0-9]")))


def scan(docs: DataFrame, chains: Chains, ratio: float = RATIO) -> DataFrame:
    """``docs`` with arrays of (start, end) in columns assign, access, hex and markov added.

    Places are code points of the whole text, end exclusive; a null text is
    empty. Columns of ``docs`` with these four names are replaced, all others pass through, whatever they are called.
    """
    kept = docs.drop(*KINDS)
    return _scanned(kept, chains, ratio).select(*unboxed(kept, "row"), *KINDS)


def _scanned(docs: DataFrame, chains: Chains, ratio: float) -> DataFrame:
    """row (all of a row of ``docs``), whole (its whole text) and the four kinds of spans."""
    d = docs.select(boxed(docs).alias("row"), whole_text().alias("whole"))
    d = d.select("row", "whole", *[c.alias(f"in_{n}") for n, c in base_spans(F.col("whole")).items()])
    taken = F.concat("in_assign", "in_access", "in_hex")
    candidates = _found(F.col("whole"), RUN)
    markov = F.filter(candidates, lambda c: ~F.exists(taken, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"]))
                      & (chains.score(c["value"]) >= ratio))
    d = d.withColumn("in_markov", markov)
    bare = {n: F.transform(f"in_{n}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for n in KINDS}
    return d.select("row", "whole", *[c.alias(n) for n, c in bare.items()])


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def tagged(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    spans = F.sort_array(F.concat(*[tagged(n, k) for n, k in enumerate(kinds)]))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per document; repeated rows stay, an empty table gives none."""
    found = scan(docs.select("doc_id", "text"), train_on(docs))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(listing(KINDS[:3]), 256).alias("base_sha256"), listing(KINDS).alias("spans"))


def redact(docs: DataFrame, chains: Chains, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` in ``text`` (overlapping spans by one); texts without spans and all other columns stay as they are."""
    found = _scanned(docs, chains, RATIO)
    spans = F.sort_array(F.concat(*KINDS))
    text = F.col("whole")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.when((s["start"] >= a["at"]) & ((s["start"] > a["at"]) | (a["at"] == 0)), F.array(
            F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], fresh).alias("out"))

    masked = let(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    old = F.col(f"row.c{docs.columns.index('text')}")
    return found.select(*unboxed(docs, "row", text=F.when(F.size(spans) > 0, masked).otherwise(old)))

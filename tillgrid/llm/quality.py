"""Quality of documents by weak supervision: rules vote, their accuracies are learned.

DataFrame functions only. Each rule looks at one aspect and votes for good (1),
for bad (-1) or abstains (0). Documents with the same votes are counted, and
expectation-maximisation over these counts estimates the share of good documents and
how often each rule votes either way, or abstains, on good and on bad ones: the
expected truth of every pattern of votes gives the rates, these give the expected
truth again. How right a vote is follows from its two rates, so a vote that most documents of
both kinds get says little, however often it is right. The rates start from a first guess
that weighs as much as a fixed number of documents, which any larger table outvotes; rules that share no
document are told apart by it alone until then. Rules keep their direction: a bad vote never speaks for good, a
good vote or an abstention never for bad. A document is kept when its posterior
probability of being good reaches a threshold and the base test holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import BLANKS, boxed, let, settle, unboxed, whole_text

SYMBOLS = "#*$%&|<>"
#: Steps of expectation-maximisation; first guess of the share of good documents and, for each outcome of a rule,
#: of its rate on bad and on good documents; how many documents of each class the guess counts for.
STEPS = 100
SHARE = 0.9
GUESS = {-1: (0.2, 0.01), 0: (0.5, 0.59), 1: (0.3, 0.4)}
PRIOR = 20.0
KEEP = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words lying in a three-word window that the text holds twice or more.

    Sorting (window, place) puts equal windows side by side; the places of those
    with an equal neighbour, sorted again, cover min(3, distance to the next) words each.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(
            " ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(t: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(t.alias("t"), F.sequence(F.lit(1), F.size(t)).alias("i")))

        def places(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(
                F.transform(s, lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(x["t"] == F.get(s, k - 1)["t"], F.lit(False))
                     | F.coalesce(x["t"] == F.get(s, k + 1)["t"], F.lit(False))).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"]))

        def cover(p: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda n, k: n + F.coalesce(
                F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)), F.lit(3)))

        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(
            let(placed, lambda s: let(places(s), lambda p: F.when(F.size(p) > 0, cover(p)).otherwise(0))))

    return F.when(F.size(words) < 4, 0).otherwise(let(windows(words), covered))


def measures(docs: DataFrame, carry: Sequence[Column] = ()) -> DataFrame:
    """doc_id and the measures of the whole text (null: no words), one row per document.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the base test
    uses them, and for the rules: upper (A-Z), letters (A-Z, a-z and beyond ASCII),
    shouts (exclamation marks), n_lines (lines with a word), short_lines (those of at most two words), distinct_words.
    Other columns, whatever their names, are not read, but for what ``carry`` adds; repeated rows stay.
    """
    text = F.col("_text")
    kept = F.regexp_replace(text, BLANKS, "")
    d = docs.select("doc_id", whole_text().alias("_text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    d = d.select("doc_id", "_carry", "_text", words_of(text).alias("_words"),
                 F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "").alias("_lines"))
    w, lines = F.col("_words"), F.col("_lines")
    plain = F.translate(text, SYMBOLS, "")
    upper = F.regexp_replace(text, "[A-Z]+", "")
    return d.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(kept).cast("long").alias("word_chars"),
        (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        let(w, _repeated).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(upper)).cast("long").alias("upper"),
        F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long").alias("letters"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("shouts"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), BLANKS)) <= 2)).cast("long").alias("short_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("distinct_words"),
        "_carry",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Name -> vote. Each compares whole numbers, so that no rounding decides a vote."""
    c = F.col
    return {
        "symbols": _vote(10 * c("n_symbols") > 3 * c("n_words")),
        "symbol_share": _vote(25 * c("n_symbols") > c("word_chars")),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * c("n_words")),
        "duplicate_lines": _vote((c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines"))),
        "capitals": _vote(2 * c("upper") > c("letters")),
        "shouts": _vote(2 * c("shouts") > c("n_words")),
        "letters": _vote(10 * c("letters") < 6 * c("word_chars")),
        "list": _vote((c("n_lines") >= 10) & (10 * c("short_lines") > 7 * c("n_lines"))),
        "word_length": _vote((c("n_words") == 0) | (c("word_chars") > 15 * c("n_words")) | (2 * c("word_chars") < 5 * c("n_words"))),
        # Longer texts repeat more words by nature: from 2,000 words on, fewer than 400 different ones are a poor vocabulary.
        "vocabulary": _vote((c("n_words") >= 50) & (5 * c("distinct_words") < F.least(c("n_words"), F.lit(2000))),
                            (c("n_words") > 0) & (5 * c("distinct_words") >= 2 * c("n_words"))),
        "prose": _vote(c("n_lines") == 0, 4 * c("short_lines") <= c("n_lines")),
    }


def fit(patterns: Sequence[tuple[Sequence[int], int]], steps: int = STEPS, prior: float = PRIOR) -> tuple[float, list[dict[int, float]]]:
    """The log-odds of good before any vote, and per rule what each outcome adds to them.

    ``patterns``: votes and how many documents cast them (at most 3^rules).
    """
    m = len(patterns[0][0]) if patterns else 0
    share, rates = SHARE, [dict(GUESS) for _ in range(m)]

    def evidence() -> tuple[float, list[dict[int, float]]]:
        ratio = [{v: math.log(good / bad) for v, (bad, good) in r.items()} for r in rates]
        return math.log(share / (1 - share)), [{v: min(0.0, w) if v < 0 else max(0.0, w) for v, w in r.items()} for r in ratio]

    for _ in range(steps):
        start, odds = evidence()
        total, cast = [0.0, 0.0], [{v: [0.0, 0.0] for v in GUESS} for _ in range(m)]
        for votes, n in patterns:
            good = 1 / (1 + math.exp(-start - sum(w[v] for w, v in zip(odds, votes, strict=True))))
            for k, weight in enumerate((n * (1 - good), n * good)):
                total[k] += weight
                for tally, v in zip(cast, votes, strict=True):
                    tally[v][k] += weight
        share = (total[1] + prior * SHARE) / (sum(total) + prior)
        rates = [{v: tuple((t[v][k] + prior * GUESS[v][k]) / (total[k] + prior) for k in (0, 1)) for v in GUESS} for t in cast]
    return evidence()


def judge(docs: DataFrame, keep: float = KEEP, carry: Sequence[Column] = ()) -> DataFrame:
    """doc_id, the measures, votes, base_failed, quality (posterior) and kept per document.

    An empty table gives no rows. A null or empty text has no words and fails the
    base test.
    """
    votes = rules()
    # Measured once: the rows are read for the counts and again for the verdicts.
    voted = settle(measures(docs, carry).select("*", *[v.cast("int").alias(f"vote_{n}") for n, v in votes.items()]), "votes")
    names = [f"vote_{n}" for n in votes]
    counted = voted.groupBy(*names).count().collect()  # at most 3^rules rows
    start, odds = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    z = F.lit(start)
    for n, w in zip(names, odds, strict=False):
        z = z + F.when(F.col(n) < 0, w[-1]).when(F.col(n) > 0, w[1]).otherwise(w[0])
    return (voted.withColumn("base_failed", base_failed())
                 .withColumn("quality", 1 / (1 + F.exp(-z)))
                 .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    judged = judge(docs, carry=[boxed(docs).alias("row")])
    return judged.filter("kept").select(*unboxed(docs, "_carry.row"))

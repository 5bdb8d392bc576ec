"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders all shingles; a text's sketch is its k smallest hash
values. Texts with equal shingle sets are one node from the start. Inverted
lists of sketch values find pairs with an overlap, the sketch of a pair's union estimates its similarity and
drops what is clearly below the threshold, and the full sets decide.

Which values a node is listed under: two sketches that agree in c of k values
share one of the k - c + 1 values that come first in any order both follow. The
order here is from the rarest value to the most frequent, so a passage that very many
documents share lists only the documents that consist of little else.

Short lists are paired off. In a long list every node meets the list's most
central one, which links a group of copies in a linear number of pairs. What is still apart in a long list is joined on full sets,
without pairing off the list: shingles held by few of these nodes make short lists
again, and two nodes that share none of those can only overlap in the frequent ones. Nodes with the same frequent shingles
therefore form a class in which the smallest node stands for all (whoever has a link of this
kind has one with it), and the classes' sets are joined in the same way, with a higher frequency bound, until no shingle is
frequent any more. So a passage that very many documents share costs one class, not a pair for every two of them. No list, component
or neighbourhood is ever gathered in one place. Of pairs that meet in a short list only and have a text beyond the sketch
size, the estimate loses a true link with a stated chance (``MISS``) at most; no other value, partner or candidate is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import boxed, settle, unboxed
from tillgrid.llm.components import components

WORDS = 5
SKETCH = 96
#: Chance at most that the sketch estimate misses a link at the threshold, by the exact binomial tail
#: (values of a sketch are drawn without replacement, which makes the tail lighter).
MISS = 1 / 3_000_000
#: Lists up to this size are paired off; nodes of a longer one that meet its hub in one task.
SHORT_LIST = 32
HUB_ROWS = 1024

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one shingle, none are none.

    Words are what ASCII white space leaves, A-Z lower-cased.
    """
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for j in range(WORDS):
        out = (out ^ (h[j:j + n] * _MIX[j])) * _MIX[0]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _mark(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text; only exact repeats share both."""
    row = [F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text")]
    return F.xxhash64(*row), F.xxhash64(F.lit(1), *reversed(row))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark, mark2, n_shingles, key (digest of the set, null when empty), sketch; one row per row of ``docs``."""
    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(3)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], ["doc_id", "mark", "mark2", "n_shingles", "key", "sketch"])

    mark, mark2 = _mark(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), mark2.alias("mark2"), "text").mapInArrow(
        sketch, "doc_id long, mark long, mark2 long, n_shingles long, key binary, sketch array<long>")


def least_estimate(percent: int) -> float:
    """The largest share of a sketch that fewer values fall below, at the threshold, with a chance of at most ``MISS``."""
    t, tail = percent / 100, 0.0
    for c in range(SKETCH + 1):
        tail += math.comb(SKETCH, c) * t ** c * (1 - t) ** (SKETCH - c)
        if tail > MISS:
            return c / SKETCH
    return 1.0


def _index(nodes: DataFrame, percent: int) -> DataFrame:
    """value, node, n, lone (sketch values nobody shares), size (of the value's list), for lists of two or more."""
    rows = nodes.select("node", "n", F.size("sketch").alias("a"), F.explode("sketch").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.select("value", "node", "n", "a").join(often, "value")
    # A node and all its partners with untruncated sketches need the exact overlap only.
    share = F.when(100 * F.col("n") <= (percent - 5) * SKETCH, percent / 100).otherwise(least_estimate(percent))
    by_node = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("a").alias("a"),
                                         F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))  # at most SKETCH
    lone = F.col("a") - F.size("values")
    slots = F.col("a") - F.ceil(share * F.col("a") - 1e-9).cast("int") + 1 - lone
    listed = settle(by_node.withColumn("lone", lone).withColumn("slots", slots).filter("slots > 0")
                    .select("node", "n", "lone", F.explode(F.slice("values", 1, F.col("slots"))).alias("v"))
                    .select(F.col("v.value").alias("value"), "node", "n", "lone"), "lists")
    sizes = listed.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1")
    return settle(listed.join(sizes, "value"), "index")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(index: DataFrame, percent: int) -> DataFrame:
    """Candidates (a < b): all pairs of short lists, and each long list's most central node with the others."""
    x = index.select("value", F.col("node").alias("a"), F.col("n").alias("na"), "size")
    y = index.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), "size")
    short = x.filter(F.col("size") <= SHORT_LIST).drop("size").join(y.filter(F.col("size") <= SHORT_LIST).drop("size"), "value").filter("a < b")
    # A long list is dealt into parts of bounded size, each with a copy of the hub.
    parts = F.ceil(F.col("size") / HUB_ROWS).cast("int")
    long = y.filter(F.col("size") > SHORT_LIST).withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("size")
    hubs = (index.filter(F.col("size") > SHORT_LIST).groupBy("value")
                 .agg(F.min(F.struct("lone", "node", "n")).alias("h"), F.first("size").alias("size"))
                 .select("value", F.col("h.node").alias("a"), F.col("h.n").alias("na"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
    star = hubs.join(long, ["value", "part"]).drop("part").filter("a <> b")
    fit = short.unionByName(star).filter(_sizes_fit(F.col("na"), F.col("nb"), percent))
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union's sketch doesn't show them below the threshold."""
    side = nodes.select("node", "n", "sketch")
    both = (pairs.join(side.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a")
                 .join(side.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b").select("a", "b", "na", "nb", "sa", "sb"))
    lax, exact = least_estimate(percent), percent / 100

    def estimate(batches: Iterator) -> Iterator:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            sa, sb = _Lists(batch.column(4)), _Lists(batch.column(5))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = sa[i], sb[i]
                union = np.union1d(u, v)
                cut = max(na[i], nb[i]) > SKETCH
                if cut:
                    union = union[:SKETCH]  # each sketch holds all its values that are among the union's least
                common = np.intersect1d(u, v, assume_unique=True)
                shared = int(np.searchsorted(common, union[-1], "right"))
                keep[i] = shared >= (lax if cut else exact) * len(union) - 1e-9
            yield batch.select(["a", "b"]).filter(_mask(keep))

    return both.mapInArrow(estimate, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a")
                 .join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b").select("a", "b", "sa", "sb"))

    def confirm(batches: Iterator) -> Iterator:
        for batch in batches:
            sa, sb = _Lists(batch.column(2)), _Lists(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                common = len(np.intersect1d(sa[i], sb[i], assume_unique=True))
                keep[i] = 100 * common >= percent * (len(sa[i]) + len(sb[i]) - common)
            yield batch.select(["a", "b"]).filter(_mask(keep))

    return both.mapInArrow(confirm, "a long, b long")


class _Lists:
    """Rows of an Arrow list column as numpy arrays, without copies."""

    def __init__(self, column):
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.at[i]:self.at[i + 1]]


def _mask(keep: np.ndarray):
    import pyarrow as pa
    return pa.array(keep)


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with na, nb and ``common``, the shingles that ``sets`` (node, n, hot) of both hold."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hot").alias("sa")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hot").alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            sa, sb = _Lists(batch.column(4)), _Lists(batch.column(5))
            n = [len(np.intersect1d(sa[i], sb[i], assume_unique=True)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(n, pa.int64())], ["a", "b", "na", "nb", "common"])

    return both.mapInArrow(count, "a long, b long, na long, nb long, common long")


#: Width of a size band in lists of full sets.
BAND = math.log(1.02)
#: How much longer the lists of each round may be than the round before.
GROWTH = 16
#: Columns of 64 parities each that stand for a node's shared shingles in its list rows.
ODD = [f"odd{i}" for i in range(4)]


def _parities() -> list[Column]:
    """Aggregates of ``token``: for each of the bits that tokens are dealt to, whether it got an odd number of them.

    Sets that differ in d tokens differ in d of these bits at most.
    """
    word, bit = F.expr(f"pmod(shiftright(token, 6), {len(ODD)})"), F.expr("shiftleft(1L, cast(token & 63 as int))")
    return [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")).alias(c) for i, c in enumerate(ODD)]


def _list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of list rows (token, node, n, lo, hi, h, parities, left) that can be links.

    ``left``: how many shared shingles a node has from this one on in the lists' order, so a pair whose first common one this is
    overlaps in the smaller ``left`` at most. The smaller node of a pair must be almost complete in its list, the larger one
    looks into the size bands alone where its own ``left`` leaves a partner possible. Nodes of the component that most of a band's nodes
    belong to don't meet each other. Two nodes with ``h`` shared shingles each differ in no fewer of them than in parities, which bounds
    their overlap from above: a pair that can't reach the threshold makes no row.
    """
    def band(n: Column) -> Column:
        return F.floor(F.log(n) / BAND).cast("int")
    least = F.ceil(F.col("n") * percent / 100 - 1e-9)
    most = F.least(F.col("n"), F.floor(100 * F.col("left") / percent + 1e-9) + F.col("left") - F.col("n"))
    root = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    small = (lists.filter((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
                  .select("token", band(F.col("n")).alias("band"), F.col("node").alias("s"), F.col("n").alias("ns"), F.col("left").alias("ls"), root.alias("rs"),
                          F.col("h").alias("hs"), *[F.col(c).alias(f"s{c}") for c in ODD]))
    large = (lists.filter(least <= most).withColumn("band", F.explode(F.sequence(band(least), band(most))))
                  .select("token", "band", F.col("node").alias("l"), F.col("n").alias("nl"), F.col("left").alias("ll"), root.alias("rl"),
                          F.col("h").alias("hl"), *[F.col(c).alias(f"l{c}") for c in ODD]))
    main = (small.filter("rs is not null").groupBy("token", "band", "rs").agg(F.count("*").alias("c"))
                 .groupBy("token", "band").agg(F.max_by("rs", F.struct("c", "rs")).alias("main")))
    small = small.join(main, ["token", "band"], "left").withColumn("side", F.coalesce(F.col("rs") == F.col("main"), F.lit(False))).drop("main")
    large = large.join(main, ["token", "band"], "left").withColumn("side", F.explode(F.when(
        F.coalesce(F.col("rl") == F.col("main"), F.lit(False)), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("main")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"s{c}").bitwiseXOR(F.col(f"l{c}"))) for c in ODD])
    fit = ((F.col("s") != F.col("l")) & (F.col("ns") <= F.col("nl")) & F.coalesce(F.col("rs") != F.col("rl"), F.lit(True))
           & ((100 + percent) * F.least("ls", "ll") >= percent * (F.col("ns") + F.col("nl")))
           & ((100 + percent) * (F.col("hs") + F.col("hl") - apart) >= 2 * percent * (F.col("ns") + F.col("nl"))))
    return small.join(large, ["token", "band", "side"]).filter(fit).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def _long_links(index: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) of nodes that stand in one long list but not yet in one component; None where there are no such lists.

    Round r joins the representatives' sets of shingles that were frequent in all rounds before. Their rarest ones, as many
    as a link can't do without, make lists: those up to ``most`` are joined within. A pair that shares no rarer shingle has
    its whole overlap in the frequent ones, so for the next round a representative's set is its frequent shingles, and representatives
    with equal sets are one class under the smallest. A node x of a class is linked, over the class's
    representative, where n(x) is at most the class's reach: common * (1 + 100 / percent) - n(partner), for its best partner.
    Representatives whose reach ends below every other holder of their shingles are done, and so are all once they are one component.
    """
    long = (index.filter(F.col("size") > SHORT_LIST).join(labels, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root")))
    apart = long.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("value")
    nodes = long.join(apart, "value").select("node", "root").distinct()
    reps = settle(nodes.join(sets, "node").select("node", F.col("root").alias("lo"), F.col("root").alias("hi"), F.size("set").cast("long").alias("n"),
                                                  F.col("set").alias("hot")), "apart")
    least = F.ceil(F.col("n") * percent / 100 - 1e-9).cast("long")

    def reach(common: Column, partner: Column) -> Column:
        return F.floor(100 * common / percent + 1e-9).cast("long") + common - partner
    members = reps.select("node", "n", F.col("node").alias("rep"))
    links: list[DataFrame] = []
    most = SHORT_LIST
    while True:
        roots = reps.agg(F.min("lo"), F.max("hi")).first()
        if roots[0] == roots[1]:  # none, or all of one component
            return reduce(DataFrame.unionByName, links) if links else None
        tokens = reps.select("node", "n", F.explode("hot").alias("token"))
        often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("n").alias("low")).filter("df > 1")
        shared = (tokens.select("node", "token").join(often, "token").groupBy("node")
                        .agg(F.sort_array(F.collect_list(F.struct("df", "token", "low"))).alias("shared"), *_parities()))
        ranked = settle(reps.join(shared, "node").withColumn("h", F.size("shared").cast("long")).filter(F.col("h") >= least)
                            .withColumn("slots", (F.col("h") - least + 1).cast("int"))
                            .select("node", "n", "lo", "hi", "hot", "h", *ODD,
                                    F.expr(f"filter(transform(slice(shared, 1, slots), (x, i) -> struct(x.df, x.token, h - i as left)), x -> x.df <= {most})").alias("rare"),
                                    F.expr(f"filter(shared, x -> x.df > {most})").alias("frequent")), "ranked")
        lists = ranked.select("node", "n", "lo", "hi", "h", *ODD, F.explode("rare").alias("x")).select("x.token", "node", "n", "lo", "hi", "h", *ODD, "x.left")
        found = settle(_common(_list_pairs(lists, percent), ranked)
                       .filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))), "overlaps")
        each = found.select(F.col("a").alias("rep"), reach(F.col("common"), F.col("nb")).alias("reach")).unionByName(
            found.select(F.col("b").alias("rep"), reach(F.col("common"), F.col("na")).alias("reach"))).unionByName(
            reps.select(F.col("node").alias("rep"), reach(F.size("hot").cast("long"), F.col("n")).alias("reach")))
        best = each.groupBy("rep").agg(F.max("reach").alias("reach"))
        links += [found.select("a", "b"), members.join(best, "rep").filter("node <> rep and n <= reach").select(F.col("node").alias("a"), F.col("rep").alias("b"))]
        held = F.size("frequent").cast("long")
        alive = ranked.filter((held >= least) & (F.array_min("frequent.low") <= reach(held, F.col("n")))).select(
            "node", "n", "lo", "hi", F.array_sort("frequent.token").alias("frequent"))
        alive = alive.withColumn("h1", F.xxhash64("frequent")).withColumn("h2", F.xxhash64(F.lit(1), "frequent"))
        classes = alive.groupBy("h1", "h2").agg(F.min(F.struct("n", "node")).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("frequent").alias("hot"))
        after = settle(classes.select("h1", "h2", F.col("m.node").alias("node"), "lo", "hi", F.col("m.n").alias("n"), "hot"), "classes")
        moved = alive.select(F.col("node").alias("rep"), "h1", "h2").join(after.select("h1", "h2", F.col("node").alias("to"), F.size("hot").alias("held")), ["h1", "h2"])
        members = settle(members.join(moved, "rep").filter(100 * F.col("held") >= percent * F.col("n")).select("node", "n", F.col("to").alias("rep")), "members")
        reps, most = after.select("node", "lo", "hi", "n", "hot"), GROWTH * most


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set for ``wanted`` (mark, key, node): the full shingle sets, from the texts of those rows alone."""
    rows = docs.select(_mark(docs)[0].alias("mark"), "text").join(wanted, "mark").select("node", "key", "text")

    def full(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh128_digest
        seen: set[int] = set()  # nodes of this task: a row that stands in the table very often is read once in each
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, keys, out = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i, node in enumerate(nodes):
                    if node not in seen:
                        one = shingles(part.column(2)[i].as_py())
                        if xxh128_digest(one.tobytes()) == keys[i]:  # else another row with the same mark
                            seen.add(node)
                            out.append((node, one))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["node", "set"])

    return rows.mapInArrow(full, "node long, set array<long>")


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows' sketches (written), and key, root for every distinct shingle set: sets with the same root are one component."""
    seen = settle(sketches(docs), "sketches")
    classes = settle(seen.filter(F.col("key").isNotNull()).groupBy("key")
                     .agg(F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    index = _index(classes, percent)
    active = index.select("node").distinct()
    wanted = classes.select("node", "key", "mark", "n", "sketch").join(active, "node")
    wanted = settle(wanted, "listed")
    sets = settle(_sets(docs, wanted.select("mark", "key", "node")).dropDuplicates(["node"]), "sets")
    candidates = settle(_estimated(_pairs(index, percent), wanted, percent), "candidates")
    links = settle(_confirmed(candidates, sets, percent), "links")
    labels = components(links)
    more = _long_links(index, labels, sets, percent)
    if more is not None:
        labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return seen, classes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("root", "node").alias("root"))


def find(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    a component's id is the smallest doc_id in it. A null or empty text, or one without
    words, has no shingles and is a component of its own. Rows with the same text are one group; repeated rows
    all carry the same verdict. Rows without doc_id link like all others; a null id names a component that has no other id. Ties can't
    matter: components don't depend on order. An empty table gives no rows. Further columns are not read.
    """
    seen, rooted = _components(docs, percent)
    rooted = settle(rooted, "rooted")
    ids = seen.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    names = ids.join(rooted, "key").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(names, "root").select("key", "component_id")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (seen.select("doc_id", "n_shingles", "key").join(named, "key", "left")
                .select("doc_id", "n_shingles", component.alias("component_id"))
                .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def kept_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns, and all rows without words.

    The row with the smallest doc_id stays (null last; then the smallest hash of its text); of exact repeats of
    that row one stays. Rows that share an id but not the text are judged each by its text.
    """
    seen, rooted = _components(docs, percent)
    # One entry for each distinct row, by its two marks, and how often it stands in the table.
    rows = seen.filter(F.col("key").isNotNull()).groupBy("mark", "mark2").agg(F.first("key").alias("key"), F.first("doc_id").alias("doc_id"), F.count("*").alias("often"))
    ranked = rows.join(rooted, "key").withColumn("at", F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "mark2"))
    best = ranked.groupBy("root").agg(F.min("at").alias("best"))
    verdict = settle(ranked.join(best, "root").select("mark", "mark2", "often", (F.col("at") == F.col("best")).alias("stays")), "verdicts")
    mark, mark2 = _mark(docs)
    held = docs.select(mark.alias("mark"), mark2.alias("mark2"), boxed(docs).alias("row"))
    gone = verdict.filter((~F.col("stays")) | (F.col("often") > 1)).select("mark", "mark2")
    again = verdict.filter(F.col("stays") & (F.col("often") > 1)).select("mark", "mark2")
    one = held.join(again, ["mark", "mark2"]).groupBy("mark", "mark2").agg(F.first("row").alias("row"))
    out = held.join(gone, ["mark", "mark2"], "left_anti").select("row").unionByName(one.select("row"))
    return out.select(*unboxed(docs, "row"))


SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle AS x JOIN shingle AS y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size AS p ON p.doc_id = a JOIN size AS q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

"""Prefix trie of rebuilt conversations: every distinct beginning is a node with its members and subtree sums.

A turn is keyed by 128 bits of the SHA-256 of its role and text, so no table of
texts is joined back. Conversations are sorted as key sequences and dealt by range into
shards; a hot sequence spreads over several, because the conversation id is part of the order. Each shard numbers its keys
in sorted order and inserts its sequences, median first, into a ternary search tree whose
cells are the trie's nodes. Walks without recursion sum up members, leaves and savings.

Only nodes on the path of a shard's first or last sequence can have members in other
shards. Those few are merged by their path; every other node is finished in its shard.

Sequences are handled ``SEGMENT`` turns at a time. Conversations that agree in a whole
segment and go on form the groups of the next level, whose trees are built first and hung below the segment's
last node; a conversation alone on its path needs no tree, its further turns are its nodes. So no task ever holds a whole
long conversation, and no list of members is gathered: hashes of member lists are fed row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillgrid.llm.common import parts_for, settle

#: Turns of a sequence that one tree holds; turns per shard.
SEGMENT = 64
SHARD_TURNS = 400_000
#: Turns taken from the base conversation are fewer than this.
HEADS = 6

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("boundary boolean, g binary, path array<binary>, depth int, conv_id long, parent_conv_id long, n long, children long, "
         "leaves long, saved long, chars long, below_children long, below_leaves long, below_saved long, ends string")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), key, chars; even ranges of the whole order, so a hot conversation is no single task."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = settle(conversations.filter(F.col("conv_id").isNotNull())
                  .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
                          F.length(text).cast("long").alias("chars")), "turns")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "key"]

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            first = np.zeros(len(conv), np.int64)
            first[starts] = starts
            local = np.arange(len(conv)) - np.maximum.accumulate(first)
            if last == conv[0]:
                local[:starts[1] if len(starts) > 1 else None] += seen
            last, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), here, np.int32)), pa.array(local), b.column(2), b.column(3)],
                                             ["conv_id", "slice", "local", "key", "chars"])

    dealt = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .mapInArrow(count, "conv_id long, slice int, local long, key binary, chars long"), "places")
    # Rows of a conversation in earlier slices: one row for each slice it runs on into.
    sizes = dealt.groupBy("conv_id", "slice").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "slice", F.sum("n").over(before).alias("offset")).filter("offset > 0")
    return (dealt.join(offsets, ["conv_id", "slice"], "left")
                 .select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "key", "chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, key, chars) of the rebuilt conversations, and every conv_id with its rebuilt length."""
    heads = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    convs = settle(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", heads, base), "convs")
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = (convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
                  .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = settle(convs.select("conv_id", "base", "h", "taken", "length"), "lengths")
    own = (turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
                .select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "chars"))
    first = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    head = (first.join(convs.select("conv_id", "base", "h"), "base").filter("pos < h")
                 .select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "chars"))
    return settle(own.unionByName(head), "rebuilt"), convs.select("conv_id", "length")


class Tree:
    """Ternary search tree over numbered keys; cell 0 is the root of the trie."""

    def __init__(self) -> None:
        self.key, self.low, self.eq, self.high = [-1], [0], [0], [0]
        self.parent, self.depth = [-1], [0]

    def _cell(self, key: int, parent: int) -> int:
        self.key.append(key)
        for side in (self.low, self.eq, self.high):
            side.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.key) - 1

    def insert(self, keys: list[int]) -> list[int]:
        """The cells of a sequence, root first; new ones are made where none stand."""
        at, path = 0, [0]
        for k in keys:
            side, frm, here = self.eq, at, self.eq[at]
            while here and self.key[here] != k:
                frm, side = here, self.low if k < self.key[here] else self.high
                here = side[here]
            if not here:
                here = self._cell(k, at)
                side[frm] = here
            path.append(here)
            at = here
        return path


def medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def _grow(g: bytes, runs: list[dict], number: dict[bytes, int], edges: set[int]) -> Iterator[tuple]:
    """Node rows of one group's runs (distinct sequences in order); ``edges``: runs whose path may go on in another shard."""
    tree, n_of, least, chars, last, edge = Tree(), [0], [None], [0], {}, set()
    for i in medians(len(runs)):
        run = runs[i]
        path = tree.insert([number[k] for k in run["keys"]])
        for depth, cell in enumerate(path):
            if cell == len(n_of):
                n_of.append(0)
                least.append(None)
                chars.append(run["chars"][depth - 1])
            n_of[cell] += run["n"]
            least[cell] = run["conv"] if least[cell] is None else min(least[cell], run["conv"])
        last[path[-1]] = run
        if i in edges:
            edge.update(path)
    size = len(tree.key)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for cell in range(size - 1, -1, -1):  # a cell's parent was made before it
        run = last.get(cell)
        if cell in edge:
            if cell and tree.parent[cell] not in edge:
                raise AssertionError("the way to a shared node is shared")
            continue
        if run and run["below"]:
            children[cell] += run["below"][0]
            leaves[cell] += run["below"][1]
            saved[cell] += run["below"][2]
        elif not children[cell]:
            leaves[cell] = 1
        saved[cell] += (n_of[cell] - 1) * chars[cell]
        if cell:
            up = tree.parent[cell]
            children[up] += 1
            leaves[up] += leaves[cell]
            saved[up] += saved[cell]
    keys = {i: k for k, i in number.items()}
    paths: dict[int, list[bytes]] = {}  # of shared cells alone; a parent comes before its children
    for cell in range(size):
        up, run = tree.parent[cell], last.get(cell)
        ids = ",".join(map(str, run["ids"])) if run else ""
        if cell in edge:
            paths[cell] = paths[up] + [keys[tree.key[cell]]] if cell else []
            yield (True, g, paths[cell], tree.depth[cell], least[cell], None, n_of[cell], children[cell], leaves[cell], saved[cell], chars[cell],
                   *((run and run["below"]) or (None, None, None)), ids)
        else:
            yield (False, g, paths.get(up), tree.depth[cell], least[cell], None if up < 0 or up in edge else least[up], n_of[cell], children[cell],
                   leaves[cell], saved[cell], chars[cell], None, None, None, hashlib.sha256(ids.encode()).hexdigest())


def _shard(batches: Iterator) -> Iterator:
    """Node rows of one shard: finished nodes, and its shares of the nodes that other shards may hold too.

    Only shared nodes, and nodes right below one, carry a path (their own, or their parent's)."""
    import pyarrow as pa
    groups: list[tuple[bytes, list[dict]]] = []
    for b in batches:
        for g, keys, chars, conv, *below, more in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if not groups or groups[-1][0] != g:
                groups.append((g, []))
            runs = groups[-1][1]
            if not runs or runs[-1]["keys"] != keys:
                runs.append({"keys": keys, "chars": chars, "n": 0, "conv": conv, "ids": [], "below": None if below[0] is None else tuple(below)})
            runs[-1]["n"] += 1
            if not more:
                runs[-1]["ids"].append(conv)
            if below[0] is not None:
                runs[-1]["below"] = tuple(below)
    number = {k: i for i, k in enumerate(sorted({k for _, runs in groups for r in runs for k in r["keys"]}))}
    schema = pa.schema([("boundary", pa.bool_()), ("g", pa.binary()), ("path", pa.list_(pa.binary())), ("depth", pa.int32()),
                        *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n", "children", "leaves", "saved", "chars", "below_children",
                                                    "below_leaves", "below_saved")], ("ends", pa.string())])
    rows: list[tuple] = []
    for i, (g, runs) in enumerate(groups):
        edges = {run for run, shared in ((0, i == 0), (len(runs) - 1, i == len(groups) - 1)) if shared}
        for row in _grow(g, runs, number, edges):
            rows.append(row)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _hash_chunks(chunks: DataFrame) -> DataFrame:
    """g, path, ends_sha256 from pieces (g, path, ends) of member lists, fed to the hash by their first ids, one piece at a time."""
    def feed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        at, state, out = None, None, []
        for b in batches:
            for g, path, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != (g, path):
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (g, path), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if at:
            out.append((*at, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.list_(pa.binary()), pa.string()))],
                                         ["g", "path", "ends_sha256"])

    first = F.substring_index("ends", ",", 1).cast("long")
    return (chunks.select("g", "path", "ends", first.alias("first")).repartition("g", "path").sortWithinPartitions("g", "path", "first")
                  .mapInArrow(feed, "g binary, path array<binary>, ends_sha256 string"))


def _merged(nodes: DataFrame) -> DataFrame:
    """Finished rows (g, depth, conv_id, parent_conv_id, n, children, leaves, saved, ends) of a level from its shards' rows."""
    shared = nodes.filter("boundary")
    one = shared.groupBy("g", "path").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], *[F.max(c).alias(c) for c in ("below_children", "below_leaves", "below_saved")])
    one = settle(one.join(_hash_chunks(shared.filter("ends <> ''")), ["g", "path"], "left")
                    .withColumn("ends", F.coalesce("ends_sha256", F.lit(_EMPTY))).drop("ends_sha256"), "shared")
    up = F.slice("path", 1, F.greatest(F.col("depth") - 1, F.lit(0)))
    kids = one.filter("depth > 0").groupBy("g", up.alias("path")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("long")
    own = (one.join(kids, ["g", "path"], "left")
              .withColumn("children", F.col("children") + F.coalesce("kids", zero) + F.coalesce("below_children", zero))
              .withColumn("own_leaves", F.col("leaves") + F.coalesce("below_leaves", F.when(F.col("children") == 0, 1).otherwise(0)))
              .withColumn("own_saved", F.col("saved") + F.coalesce("below_saved", zero) + (F.col("n") - 1) * F.col("chars")))
    own = settle(own.select("g", "path", "depth", "conv_id", "n", "children", "own_leaves", "own_saved", "ends"), "shared")
    # Each shared node adds to itself and to the shared nodes above it, which are all of its beginnings.
    above = own.select("g", F.explode(F.transform(F.sequence(F.lit(0), "depth"), lambda i: F.slice("path", 1, i))).alias("path"), "own_leaves", "own_saved")
    sums = above.groupBy("g", "path").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    names = own.select("g", F.col("path").alias("parent"), F.col("conv_id").alias("named"))
    fields = ["g", "depth", "conv_id", "parent_conv_id", "n", "children", "leaves", "saved", "ends"]
    done = (own.join(sums, ["g", "path"]).withColumn("parent", F.when(F.col("depth") > 0, up))
               .join(names, ["g", "parent"], "left").withColumn("parent_conv_id", F.col("named")).select(*fields))
    inner = nodes.filter("not boundary")
    under = inner.filter("path is not null").withColumnRenamed("path", "parent").drop("parent_conv_id").join(names, ["g", "parent"], "left")
    return reduce(DataFrame.unionByName, [done, inner.filter("path is null").select(*fields),
                                          under.withColumn("parent_conv_id", F.col("named")).select(*fields)])


def _sequences(rows: DataFrame, members: DataFrame, level: int, segment: int) -> DataFrame:
    """g, keys, chars, conv_id, more: a level's part of each member's turns; ``members``: conv_id, g, length."""
    first = level * segment
    part = rows.filter((F.col("depth") > first) & (F.col("depth") <= first + segment))
    lists = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "chars"))).alias("turns"))  # a segment at most
    none = F.array().cast("array<struct<depth:bigint,key:binary,chars:bigint>>")
    return (members.join(lists, "conv_id", "left").withColumn("turns", F.coalesce("turns", none))
                   .select("g", F.col("turns.key").alias("keys"), F.col("turns.chars").alias("chars"), "conv_id", "length",
                           (F.col("length") > first + segment).alias("more")))


def trie(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The node table (``COLUMNS``) of ``conversations`` (conv_id, turn, role, text).

    Each conversation c is rebuilt first: the first h turns of conversation c - c % 100
    (all if fewer, none if absent), then its own turns after its first h; h = crc32(c as text) % 6. A node is a distinct sequence of
    first turns; its ``conv_id`` is its smallest member. Null role or text is
    empty; rows without conv_id belong to no conversation and are left out; null turns come first, equal turns are
    ordered by a digest of role and text, repeated rows are turns of their own. An empty table gives no rows. Further
    columns are not read. The result doesn't depend on ``segment`` or ``shard_turns``.
    """
    rows, lengths = rebuilt(numbered_turns(conversations))
    members, levels, tails, level = lengths.withColumn("g", F.lit(b"")), [], [], 0
    while True:
        seqs = settle(_sequences(rows, members, level, segment), "sequences")
        full = seqs.filter(F.size("keys") == segment)
        ahead = full.select("conv_id", "length", "more",
                            F.unhex(F.substring(F.sha2(F.concat("g", F.array_join(F.transform("keys", F.hex), "")), 256), 1, 32)).alias("g"))
        deep = settle(ahead.groupBy("g").agg(F.count("*").alias("n"), F.max("more").alias("more"), F.min("conv_id").alias("conv_id")).filter("more"), "groups")
        levels.append((seqs, deep))
        if deep.isEmpty():
            break
        alone = deep.filter("n = 1").select("conv_id").join(lengths, "conv_id")
        rest = rows.filter(F.col("depth") > (level + 1) * segment).join(alone, "conv_id")
        at_end = F.col("depth") == F.col("length")
        tails.append(rest.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                                 F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                                 F.lit(0).cast("long").alias("saved_tokens"),
                                 F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256")))
        # Members that end with the segment stay members of the next level's root.
        members = settle(ahead.join(deep.filter("n > 1").select("g"), "g").select("conv_id", "length", "g"), "members")
        level += 1
    out, below = list(tails), None
    for level in range(len(levels) - 1, -1, -1):
        seqs, deep = levels[level]
        if deep.isEmpty():
            hung = seqs.select("*", *[F.lit(None).cast("long").alias(f"below_{c}") for c in ("children", "leaves", "saved")])
        else:
            one = deep.filter("n = 1").select("g", *[F.lit(x).cast("long").alias(f"below_{c}") for c, x in (("children", 1), ("leaves", 1), ("saved", 0))])
            next_g = F.unhex(F.substring(F.sha2(F.concat("g", F.array_join(F.transform("keys", F.hex), "")), 256), 1, 32))
            sums = (one if below is None else one.unionByName(below)).withColumnRenamed("g", "next")
            hung = seqs.withColumn("next", F.when(F.size("keys") == segment, next_g)).join(sums, "next", "left")
        order = ["g", "keys", "conv_id"]
        hung = settle(hung.select(*order[:2], "chars", "conv_id", "below_children", "below_leaves", "below_saved", "more"), "hung")
        turns = hung.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
        least = min(int(hung.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(turns, 10_000))
        shards = max(parts_for(turns, shard_turns), least)
        nodes = settle(hung.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_shard, _NODE), "nodes")
        done = _merged(nodes)
        if level:
            done = settle(done, "level")
            below = done.filter("depth = 0").select("g", F.col("children").alias("below_children"), F.col("leaves").alias("below_leaves"),
                                                    F.col("saved").alias("below_saved"))
            done = done.filter("depth > 0")
        out.append(done.select("conv_id", (F.col("depth") + level * segment).cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                               F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                               F.col("ends").alias("ends_sha256")))
    return reduce(DataFrame.unionByName, out).select(*COLUMNS)


SQL = r"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, sha256(concat(length(role), ':', role, text)) AS k, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
told AS (
  SELECT c.conv_id, 0 AS part, pos, k, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, k, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND pos >= h),
seq AS MATERIALIZED (
  SELECT conv_id, coalesce(list(k ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ks, list(chars ORDER BY part, pos) AS cs
  FROM convs LEFT JOIN told USING (conv_id) GROUP BY conv_id),
node AS MATERIALIZED (
  SELECT ks[1:i] AS path, i AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(CASE WHEN i > 0 THEN cs[i] END), 0) AS chars,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(ks) = i), '')) AS ends_sha256
  FROM seq, unnest(range(0, len(ks) + 1)) AS t(i) GROUP BY ALL),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
known AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
sums AS (
  SELECT path[1:i] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM known, unnest(range(0, depth + 1)) AS t(i) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM known AS n JOIN sums USING (path) LEFT JOIN known AS p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""

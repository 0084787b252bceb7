"""Conversation prefix trie: how many conversations share each sequence of first turns, and what sharing them would save.

Turns (role and text) get numbers from a dictionary. Conversations, as sequences of these numbers, are sorted over all machines by
ranges; equal ones are one row before that, however many there are. Each range shard holds its sequences in ternary search
trees, built by inserting medians first, so that they are balanced; an iterative traversal sums up members, leaves and savings
from the ends to the root.

A node at the edge of a shard can lie in the next one too. Every shard therefore gets, beside its own sequences, the last one
of the shard before and the first one of the shard after, without members. By these it knows which of its nodes began earlier
(they count as a child, and lose the one member that saves nothing, in the shard where they began) and which of its ends go on
later (they are no leaves). So what shards say of a node adds up: edge nodes, two paths a shard, are merged by a sum.

Nodes are known by two 64-bit sums of hashes of (turn, depth), which belong to the sequence alone. A conversation of over
``segment`` turns is cut: a segment's trie hangs below the node at which the segment before ends. Levels of segments are
worked from the deepest up, each giving its roots' sums to the ends it hangs from; ordinary conversations need one.

Turns are ordered by turn (null first), of equal ones by role and text; null role and text are empty. Repeated rows are
turns of their own. Rows without a conversation id are left out. Texts of any length travel once, to the dictionary. Other columns
play no part, whatever their names. No conversations: no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, table, written

SHARED, FAMILY, SEGMENT, IDS = 9, 5, 4096, 1 << 14
NONE = hashlib.sha256(b"").hexdigest()
MASK = (1 << 64) - 1
NODE = (
    "root boolean, edge boolean, depth long, p1 long, p2 long, up1 long, up2 long, up_least long, n long, least long, children long, leaves long, saved long"
)


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) -> (conv, pos (from 1), tid (the turn's number in the dictionary), len (bytes of text)), and (conv, size)."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = before(rows.select("conv", "turn", "role", "text", F.lit(1).alias("one")), order, rank="one")
    ranked = written(ranked.select("conv", "rank", key.alias("key"), F.octet_length("text").cast("long").alias("len")))
    words = written(ranked.select("key").distinct().withColumn("tid", F.monotonically_increasing_id()))
    sizes = written(ranked.groupBy("conv").agg(F.min("rank").alias("first"), F.count("*").alias("size")))
    turns = ranked.join(sizes, "conv").join(words, "key").select("conv", (F.col("rank") - F.col("first") + 1).alias("pos"), "tid", "len")
    return written(turns), sizes.select("conv", "size")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation has taken the first turns of its family's first one: (conv, d, tid, len), and (conv, length)."""
    family = F.col("conv") - F.col("conv") % FAMILY
    own = sizes.select("conv", "size", family.alias("of"), shared_turns(F.col("conv")).alias("h"))
    whose = sizes.select(F.col("conv").alias("of"), F.col("size").alias("there"))
    heads = own.join(whose, "of", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    heads = written(heads.select("conv", "of", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")))
    rest = turns.join(heads.select("conv", "h", "taken"), "conv").filter("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "tid", "len")
    few = turns.filter(F.col("pos") < SHARED).select(F.col("conv").alias("of"), "pos", "tid", "len")
    start = heads.filter("taken > 0").select("conv", "of", "taken").join(few, "of").filter("pos <= taken").select("conv", F.col("pos").alias("d"), "tid", "len")
    return start.unionByName(rest), heads.select("conv", "length")


def mixed(tid: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of (turn, depth)."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        z = depth.astype(np.uint64)
        for x in (np.uint64(salt), tid.astype(np.uint64)):
            z = z + x
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        out.append(z)
    return out


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def segments(turns: DataFrame, lengths: DataFrame, size: int) -> tuple[DataFrame, int]:
    """conv, s, seq (array of turn and length), p1, p2 (of the node that the segment begins at), q1, q2 (of that where it ends), ended; and the number of levels."""
    s = F.floor((F.col("d") - 1) / size)
    rows = turns.withColumn("s", s).groupBy("conv", "s").agg(F.sort_array(F.collect_list(F.struct("d", "tid", "len"))).alias("at"))
    rows = rows.select("conv", "s", F.transform("at", lambda x: F.struct(x["tid"].alias("tid"), x["len"].alias("len"))).alias("seq"))
    bare = lengths.filter("length = 0").select("conv", F.lit(0).cast("long").alias("s"), F.array().cast("array<struct<tid:bigint,len:bigint>>").alias("seq"))

    def run(parts):
        for part in parts:
            sums = []
            for at, seq in zip(part.column(1).to_pylist(), part.column(2)):
                tid = seq.values.field("tid").to_numpy() if len(seq) else np.zeros(0, np.int64)
                sums.append([signed(int(m.sum(dtype=np.uint64))) for m in mixed(tid, at * size + 1 + np.arange(len(tid)))])
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([x[k] for x in sums], pa.int64()) for k in range(2)]], [*part.schema.names, "m1", "m2"])

    rows = rows.unionByName(bare).mapInArrow(run, "conv long, s long, seq array<struct<tid:bigint,len:bigint>>, m1 long, m2 long")
    last = F.greatest(F.floor((F.col("length") - 1) / size), F.lit(0))
    rows = written(rows.join(lengths.withColumn("last", last).select("conv", "last"), "conv"))
    levels = (rows.agg(F.max("s")).first()[0] or 0) + 1
    if levels == 1:
        rows = rows.withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long"), "q1": F.col("m1"), "q2": F.col("m2")})
    else:
        path = Window.partitionBy("conv").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
        half = F.lit(str(1 << 63)).cast("decimal(38,0)")
        wrap = lambda x: (F.pmod(x + half, F.lit(str(1 << 64)).cast("decimal(38,0)")) - half).cast("long")
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).over(path)
        rows = rows.withColumns({"t1": total("m1"), "t2": total("m2")})
        rows = rows.withColumns({"q1": wrap(F.col("t1")), "q2": wrap(F.col("t2")), "p1": wrap(F.col("t1") - F.col("m1")), "p2": wrap(F.col("t2") - F.col("m2"))})
    rows = rows.select("conv", "s", "seq", "p1", "p2", "q1", "q2", (F.col("s") == F.col("last")).alias("ended"))
    return (written(rows) if levels > 1 else rows), levels


class Trie:
    """A ternary search tree over sequences of turn numbers; each of its nodes is a node of the trie."""

    def __init__(self):
        self.tid, self.len, self.low, self.high, self.down = [-1], [0], [-1], [-1], [-1]

    def insert(self, seq: list[tuple[int, int]]) -> int:
        """The node at which the sequence ends; 0 is the root."""
        tid, low, high, down, at = self.tid, self.low, self.high, self.down, 0
        for turn, length in seq:
            links, place, here = down, at, down[at]
            while here >= 0 and tid[here] != turn:
                links, place = (low, here) if turn < tid[here] else (high, here)
                here = links[place]
            if here < 0:
                here = links[place] = len(tid)
                tid.append(turn)
                self.len.append(length)
                for x in (low, high, down):
                    x.append(-1)
            at = here
        return at

    def preorder(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes, each after its parent; and by node its parent and depth."""
        parent, depth, order, stack = [-1] * len(self.tid), [0] * len(self.tid), [0], []
        if self.down[0] >= 0:
            stack.append((self.down[0], 0))
        while stack:
            here, up = stack.pop()
            parent[here], depth[here] = up, depth[up] + 1
            order.append(here)
            stack += [(x, u) for x, u in ((self.low[here], up), (self.high[here], up), (self.down[here], here)) if x >= 0]
        return order, parent, depth


def medians(n: int):
    """0 to n - 1 in an order in which each comes after the middle of the range it lies in."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += [(a, middle), (middle + 1, b)]


def summed(rows: list[tuple], base: int, p1: int, p2: int) -> list[tuple]:
    """The nodes of one root's sequences in a shard. rows, in order: seq, side (-1: of the shard before, 1: of the one after, 0: its own), n,
    least, and children, leaves, saved of what hangs below the end."""
    trie, ends = Trie(), [0] * len(rows)
    for i in medians(len(rows)):
        ends[i] = trie.insert(rows[i][0])
    order, parent, depth = trie.preorder()
    size = len(order)
    n, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    has_child, earlier, later = [x >= 0 for x in trie.down], [False] * size, [False] * size
    for end, (_, side, count, first, below, below_leaves, below_saved) in zip(ends, rows):
        if side:
            mark = earlier if side < 0 else later
            while end >= 0 and not mark[end]:
                mark[end] = True
                end = parent[end]
        else:
            n[end], least[end], children[end], leaves[end], saved[end] = count, first, below, below_leaves, below_saved
            has_child[end] = has_child[end] or below > 0
    for v in reversed(order):
        if not n[v]:
            continue
        fresh = not earlier[v]
        leaves[v] += not has_child[v]
        saved[v] += (n[v] - fresh) * trie.len[v]
        up = parent[v]
        if up >= 0:
            n[up] += n[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            children[up] += fresh
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    sums = [[p1] * size, [p2] * size]
    for total, m in zip(sums, mixed(np.array(trie.tid, np.int64), base + np.array(depth))):
        m = m.tolist()
        for v in order[1:]:
            total[v] = signed(total[parent[v]] + m[v])
    out = []
    for v in order:
        up = parent[v]
        if n[v]:
            above = (None, None, None) if up < 0 else (sums[0][up], sums[1][up], None if earlier[up] or later[up] or (base and up == 0) else least[up])
            out.append((base > 0 and v == 0, earlier[v] or later[v] or v == 0, base + depth[v], sums[0][v], sums[1][v], *above, n[v], least[v], children[v], leaves[v], saved[v]))
    return out


def level(items: DataFrame, base: int) -> DataFrame:
    """items(p1, p2, seq, n, least, children, leaves, saved), distinct in p1, p2, seq -> nodes as the shards see them, written."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = written(items.repartitionByRange(parts, "p1", "p2", "seq").withColumn("shard", F.spark_partition_id()))
    own = F.struct("p1", "p2", "seq")
    ends = shards.groupBy("shard").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    beside = Window.orderBy("shard")  # a row a shard
    ends = ends.select("shard", F.lag("last").over(beside).alias("a"), F.lead("first").over(beside).alias("b"))
    ghosts = [ends.filter(f"{c} IS NOT NULL").select("shard", f"{c}.*", F.lit(side).alias("side")) for c, side in (("a", -1), ("b", 1))]
    rows = shards.withColumn("side", F.lit(0))
    for g in ghosts:
        rows = rows.unionByName(g, allowMissingColumns=True)
    names = ["shard", "p1", "p2", "seq", "side", "n", "least", "children", "leaves", "saved"]
    rows = rows.select(*names).repartition(parts, "shard").sortWithinPartitions("shard", "p1", "p2", "seq")
    fields = [pa.field(*x) for x in (("root", pa.bool_()), ("edge", pa.bool_()), *[(w.split()[0], pa.int64()) for w in NODE.split(", ")[2:]])]

    def made(held):
        out = summed(held[1], base, *held[0][1:]) if any(not r[1] for r in held[1]) else []
        for at in range(0, len(out), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[at : at + (1 << 15)]), fields)], schema=pa.schema(fields))

    def run(parts):
        held = None
        for part in parts:
            shard, p1, p2, seq, *rest = [c.to_pylist() for c in part.columns]
            for k, s, r in zip(zip(shard, p1, p2), seq, zip(*rest)):
                if held is None or held[0] != k:
                    if held:
                        yield from made(held)
                    held = (k, [])
                held[1].append(([(x["tid"], x["len"]) for x in s], *r))
        if held:
            yield from made(held)

    return written(rows.mapInArrow(run, NODE))


def digests(ends: DataFrame) -> DataFrame:
    """ends(q1, q2, conv) -> p1, p2, ends_sha256: of the conversations that end at a node, ascending and comma-joined.

    Ids are sorted over all machines first and come to the digest as chunks of text, a batch at a time: of a node at which a third of all
    conversations end, no task holds more than a batch.
    """

    def chunks(parts):
        for part in parts:
            q1, q2, conv = (c.to_numpy() for c in part.columns)
            starts = np.flatnonzero(np.concatenate(([True], (q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1])))) if len(q1) else []
            cuts = sorted({*starts, *range(0, len(q1), IDS)})
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(q1)])]
            yield pa.RecordBatch.from_arrays([pa.array(q1[cuts]), pa.array(q2[cuts]), pa.array(conv[cuts]), pa.array(texts, pa.string())], ["q1", "q2", "first", "ids"])

    def run(parts):
        key, digest = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["p1", "p2", "ends_sha256"])
        for part in parts:
            for q1, q2, ids in zip(*(part.column(c).to_pylist() for c in (0, 1, 3))):
                if key == (q1, q2):
                    digest.update(b",")
                else:
                    if key:
                        yield told()
                    key, digest = (q1, q2), hashlib.sha256()
                digest.update(ids.encode())
        if key:
            yield told()

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select("q1", "q2", "conv").repartitionByRange(parts, "q1", "q2", "conv").sortWithinPartitions("q1", "q2", "conv")
    rows = written(rows.mapInArrow(chunks, "q1 long, q2 long, first long, ids string"))
    return written(rows.repartition("q1", "q2").sortWithinPartitions("q1", "q2", "first").mapInArrow(run, "p1 long, p2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node."""
    rows, levels = segments(*rebuilt(*turns_of(conversations)), segment)
    zero = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    found, roots = [], None
    for s in reversed(range(levels)):
        items = rows.filter(F.col("s") == s).groupBy("p1", "p2", "seq", "q1", "q2").agg(F.count("*").alias("n"), F.min("conv").alias("least"))
        if roots is None:
            items = items.withColumns(zero)
        else:
            items = written(items).join(roots, ["q1", "q2"], "left").fillna(0, list(zero))
        seen = level(items.drop("q1", "q2"), s * segment)
        sums = [F.sum(c).alias(c) for c in ("n", *zero)]
        if s:
            roots = written(seen.filter("root").groupBy(F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(*sums[1:]))
        edges = seen.filter("edge AND NOT root").groupBy("depth", "p1", "p2").agg(F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("least").alias("least"), *sums)
        found += [seen.filter("NOT edge").drop("root"), edges.withColumns({"edge": F.lit(True), "up_least": F.lit(None).cast("long")})]
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = written(nodes)
    # The parents that a shard could not know: edges, and the ends that later segments hang from.
    joints = written(nodes.filter(F.col("edge") | (F.col("depth") % segment == 0)).select(F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("least").alias("joint")))
    known = nodes.filter("up_least IS NOT NULL OR depth = 0")
    asked = nodes.filter("up_least IS NULL AND depth > 0").join(joints, ["up1", "up2"]).withColumn("up_least", F.col("joint")).drop("joint")
    ends = digests(rows.filter("ended"))
    out = known.unionByName(asked).join(ends, ["p1", "p2"], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.col("up_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = f"""
WITH t AS (SELECT conv_id, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS tid, strlen(coalesce(text, '')) AS bytes,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, count(*) AS size, list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS codes FROM t GROUP BY conv_id),
c AS (SELECT conv_id, size, xor(4294967295, list_reduce(codes, lambda a, x:
        list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % {SHARED} AS h FROM b),
d AS (SELECT c.conv_id, c.h, least(c.h, coalesce(f.size, 0)) AS taken FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
r AS (SELECT d.conv_id, pos AS place, tid, bytes FROM d JOIN t ON t.conv_id = d.conv_id - d.conv_id % {FAMILY} AND pos <= taken
      UNION ALL SELECT conv_id, taken + pos - h, tid, bytes FROM d JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT d.conv_id, coalesce(list(tid ORDER BY place) FILTER (tid IS NOT NULL), []) AS seq FROM d LEFT JOIN r USING (conv_id) GROUP BY d.conv_id),
p AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM s),
n AS (SELECT depth, seq[1:depth] AS k, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '') AS ends FROM p GROUP BY 1, 2),
u AS (SELECT n.*, coalesce(w.bytes, 0) AS bytes, coalesce(g.many, 0) AS n_children FROM n LEFT JOIN (SELECT DISTINCT tid, bytes FROM t) w ON w.tid = n.k[n.depth]
      LEFT JOIN (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS many FROM n WHERE depth > 0 GROUP BY 1, 2) g ON g.depth = n.depth AND g.k = n.k),
a AS (SELECT up AS depth, k[1:up] AS k, sum((n_convs - 1) * bytes)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS up FROM u) GROUP BY 1, 2)
SELECT u.conv_id, u.depth, v.conv_id AS parent_conv_id, u.n_convs, u.n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN a USING (depth, k) LEFT JOIN u v ON v.depth = u.depth - 1 AND v.k = u.k[1:u.depth - 1]
"""

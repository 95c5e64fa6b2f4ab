"""Conversations that share a beginning, as a trie, with sums over subtrees by heavy-path decomposition.

A node is a sequence of turns; its members are the conversations that start with it. Its key is a sum of digests: a turn's
sha256 is hashed with its place, and the four leading 32-bit numbers are summed over the prefix, modulo 2 ** 32 each. Sums can be taken in
blocks, so that a conversation of any length is spread over tasks; two of 1e12 nodes have equal keys with odds of about 1e-15.

The child with the most members (then the smallest conv_id) is a node's heavy child; all others are light, and have at most
half of the node's members, so that log2 of the conversations bounds the light nodes above any node. A heavy path ends in a
leaf, and all its nodes are prefixes of the leaf's smallest member: the path is that conversation's array of nodes from the deepest light one on. Paths of one number of light
nodes form a level. From the last level up, sums are taken from the end of each path array, in blocks; the sum at a
path's top is attached to its parent node on a level above. There are as many rounds as levels.

Joins on a key that many rows may share (a common first turn, a parent of many children) deal rows by ranges of (key, row), and
look a key up once for each range that holds it. The conversations that end at a node are joined to text in pieces of PIECE ids, then hashed in their
order from a sorted stream, as a digest asks for; nothing holds more than a batch of pieces.

Defined results: null roles and texts become empty; rows without a conv_id (or one that is no number) are left out; turns of equal number are in
the order of their digests, and repeated rows are turns of their own; an empty table gives an empty table, without a root; columns
other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import numbered_by_ranges
from .shared import partitions_for, staged, table

#: Conversations of a family share beginnings of the family's first; fewer than HEADS turns of it.
FAMILY, HEADS = 5, 9
#: Turns of a path that are summed at once, and ids of a piece of text.
BLOCK, PIECE = 4096, 1000
_LANES, _LOW = range(4), (1 << 32) - 1


def root_key():
    return F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, event_index (place of the turn, from 0), same (digest of role and text), size (bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col("conv_id").try_cast("long").alias("conv_id"), "turn", digest.alias("same"), F.octet_length(text).cast("long").alias("size"))
    return numbered_by_ranges(rows.where("conv_id IS NOT NULL"), ("conv_id",), ("turn", "same")).drop("turn")


def looked_up(rows: DataFrame, key: str, order: str, found: DataFrame, name: str) -> DataFrame:
    """rows with the other columns of found, whose key is unique there; null where found has none. Any number of rows may share a key."""
    ranged = staged(rows.repartitionByRange(partitions_for(rows.sparkSession), key, order).withColumn("_part", F.spark_partition_id()), name)
    return ranged.join(ranged.select(key, "_part").distinct().join(found, key), [key, "_part"], "left").drop("_part")


def blocks(first, last):
    return F.explode(F.sequence(first, last)).alias("_b")


def block_of(place):
    return F.floor(place / BLOCK).alias("_b")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations with n, h, head and depth; their rebuilt turns conv_id, d from 1, same, size): the first h turns of the
    family's first conversation, then those of one's own after h; h is crc32 of the decimal conv_id modulo heads."""
    own = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", own).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    of = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(of, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = staged(convs.withColumn("depth", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).drop("n_base"), "trie-conversations")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("event_index") < heads)).withColumnRenamed("conv_id", "base")
    taken = convs.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("event_index < head")
    # places move up where the family's first conversation is shorter than h
    short = convs.where("head < h AND n > h").select("conv_id", (F.col("h") - F.col("head")).alias("less"), blocks(F.floor(F.col("h") / BLOCK), F.floor((F.col("n") - 1) / BLOCK)))
    after = turns.where(F.col("event_index") >= own).withColumn("_b", block_of(F.col("event_index"))).join(short, ["conv_id", "_b"], "left")
    place = F.col("event_index") + 1
    return convs, taken.select("conv_id", place.alias("d"), "same", "size").unionByName(
        after.select("conv_id", (place - F.coalesce("less", F.lit(0).cast("long"))).alias("d"), "same", "size"))


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, d, same, size) with node and parent: keys of the prefix that ends with the turn, and of the one before it."""
    digest = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("same")), 256)
    rows = rows.select("conv_id", "d", "size", block_of(F.col("d")), digest.alias("_m"))
    rows = rows.select("conv_id", "d", "size", "_b", *(F.conv(F.substring("_m", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_l{k}") for k in _LANES))
    upto = Window.partitionBy("conv_id", "_b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "_b").agg(*(F.sum(f"_l{k}").alias(f"_e{k}") for k in _LANES))
    carry = ends.select("conv_id", "_b", *(F.sum(f"_e{k}").over(before).alias(f"_c{k}") for k in _LANES)).where("_b > 0")
    sums = rows.select("*", *(F.sum(f"_l{k}").over(upto).alias(f"_s{k}") for k in _LANES)).join(carry, ["conv_id", "_b"], "left")
    whole = [F.col(f"_s{k}") + F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k in _LANES]

    def key(lane):
        low = [x.bitwiseAND(_LOW) for x in lane]
        return F.struct(F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("u"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("v"))

    return sums.select("conv_id", "d", "size", key(whole).alias("node"), key([w - F.col(f"_l{k}") for k, w in zip(_LANES, whole, strict=True)]).alias("parent"))


def nodes_of(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a node: node, parent, conv_id (smallest member), depth, size (of its last text), n_convs, n_children, light."""
    n = F.count(F.lit(1)).alias("n_convs")
    found = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.min("size").alias("size"), n)
    root = convs.agg(F.min("conv_id").alias("conv_id"), n).where("n_convs > 0").select(
        root_key().alias("node"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "n_convs")
    found = staged(found.unionByName(root), "trie-nodes")
    most = F.max(F.struct("n_convs", -F.col("conv_id"), F.col("node").alias("heavy")))
    below = staged(found.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), most.alias("most")).select(F.col("parent").alias("node"), "n_children", "most.heavy"), "trie-children")
    heavy = below.select(F.col("heavy").alias("node"), F.lit(True).alias("_heavy"))
    out = found.join(below.drop("heavy"), "node", "left").join(heavy, "node", "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("light", F.col("_heavy").isNull() & (F.col("depth") > 0)).drop("_heavy")


def paths_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with path (its name: the smallest member of its leaf), top (depth of the path's first node), end (of its last) and level."""
    leaves = nodes.where("n_children = 0").select("conv_id", F.col("depth").alias("end"))
    keys = leaves.select("conv_id", blocks(F.lit(0).cast("long"), block_of(F.col("end"))))
    own = rows.select("conv_id", "d", "node", block_of(F.col("d"))).join(keys, ["conv_id", "_b"], "left_semi").drop("_b")
    own = staged(looked_up(own, "node", "conv_id", nodes.where("light").select("node", F.lit(True).alias("light")), "trie-leaf-rows"), "trie-flags")
    marks = own.where("light").groupBy("conv_id").agg(F.max("d").alias("top"), F.count(F.lit(1)).alias("level"))
    zero = F.lit(0).cast("long")
    marks = staged(leaves.join(marks, "conv_id", "left").withColumn("top", F.coalesce("top", zero)).withColumn("level", F.coalesce("level", zero)), "trie-path-tops")
    spread = marks.withColumn("_b", F.explode(F.sequence(block_of(F.col("top")), block_of(F.col("end")))))
    within = own.select("conv_id", "d", "node", block_of(F.col("d"))).join(spread, ["conv_id", "_b"]).where("d >= top").drop("_b", "d")
    first = marks.where("level = 0").withColumn("node", root_key())
    both = within.unionByName(first.select(within.columns)).withColumnRenamed("conv_id", "path")
    return nodes.join(both, "node")


def subtree_sums(placed: DataFrame) -> DataFrame:
    """placed (of paths_of()) with n_leaves and saved_tokens summed over subtrees."""
    placed = staged(placed.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")), "trie-paths")
    names, levels = ("n_leaves", "saved_tokens"), placed.agg(F.max("level")).first()[0]
    done, attached = None, None
    for level in range(-1 if levels is None else levels, -1, -1):
        rows = placed.where(F.col("level") == level).withColumn("_b", block_of(F.col("depth")))
        if attached is not None:
            rows = rows.join(attached, "node", "left")
            for n in names:
                rows = rows.withColumn(n, F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).drop(f"_{n}")
        here = Window.partitionBy("path", "_b").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy("path").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        several = rows.where(F.floor(F.col("top") / BLOCK) < F.floor(F.col("end") / BLOCK)).groupBy("path", "_b").agg(*(F.sum(n).alias(n) for n in names))
        carry = several.select("path", "_b", *(F.sum(n).over(later).alias(f"_{n}") for n in names))
        sums = rows.select(*(c for c in rows.columns if c not in names), *(F.sum(n).over(here).alias(n) for n in names)).join(carry, ["path", "_b"], "left")
        sums = staged(sums.select(*placed.columns[: -len(names)], *((F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in names)), "trie-level")
        done = sums if done is None else done.unionByName(sums)
        attached = sums.where("depth = top AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(*(F.sum(n).alias(f"_{n}") for n in names))
    return placed if done is None else done


def digests(ends: DataFrame) -> DataFrame:
    """node, sha: SHA-256 of the decimal conv_ids of ends (node, conv_id), ascending, joined by commas."""
    placed = numbered_by_ranges(ends, ("node",), ("conv_id",))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = placed.groupBy("node", F.floor(F.col("event_index") / PIECE).alias("k")).agg(names.alias("ids"))
    sorted_ = pieces.select("node.u", "node.v", "k", "ids").repartition("u", "v").sortWithinPartitions("u", "v", "k")

    def run(batches):
        last, h, done = None, None, []
        for batch in batches:
            for u, v, ids in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "ids")), strict=True):
                if (u, v) != last:
                    if last is not None:
                        done.append((*last, h.hexdigest()))
                    last, h = (u, v), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if done:
                yield made(done)
                done = []
        if last is not None:
            yield made([(*last, h.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["u", "v", "sha"])

    return sorted_.mapInArrow(run, "u long, v long, sha string").select(F.struct("u", "v").alias("node"), "sha")


def trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """node, parent and the columns of the query, one row a node; parent is null for the root."""
    convs, turns = rebuilt(turns_of(conversations), family, heads)
    rows = staged(prefixes(turns), "trie-rows")
    nodes = staged(nodes_of(convs, rows), "trie-nodes")
    sums = subtree_sums(paths_of(rows, nodes))
    sums = looked_up(sums, "parent", "node", nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "trie-sums")
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("d", "node")).alias("last")).select("last.node", "conv_id").unionByName(convs.where("depth = 0").select(root_key().alias("node"), "conv_id"))
    out = sums.join(digests(ends), "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: crc32 of the conv_id goes over half bytes, as in the SQL of op11; prefixes are compared as text.
SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, hex(encode(CAST(conv_id AS VARCHAR))) AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, count(*) AS n, xor(list_reduce(list_transform(range(0, len(any_value(x))), lambda j: CAST(strpos('123456789ABCDEF', any_value(x)[CASE WHEN j % 2 = 0 THEN j + 2 ELSE j END]) AS BIGINT)),
    lambda a, b: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, b) & 15) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h FROM t GROUP BY c),
g AS (SELECT v.c, v.h, least(v.h, coalesce(b.n, 0)) AS head FROM v LEFT JOIN v b ON b.c = v.c - v.c % 5),
r AS (SELECT g.c, i + 1 AS d, role, text FROM g JOIN t ON t.c = g.c - g.c % 5 AND i < head
  UNION ALL SELECT g.c, i + 1 - (h - head), role, text FROM g JOIN t USING (c) WHERE i >= h),
p AS (SELECT c, d, strlen(text) AS size, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM g),
m AS (SELECT c, d, size, dense_rank() OVER (ORDER BY k) AS k FROM p),
q AS (SELECT c, d, size, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM m),
o AS (SELECT k, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, any_value(size) AS size, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids FROM q GROUP BY k),
y AS (SELECT up AS k, count(*) AS n_children FROM o WHERE up IS NOT NULL GROUP BY up),
z AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN y USING (k)),
w AS (SELECT DISTINCT a.k, b.k AS below FROM q a JOIN q b ON a.c = b.c AND a.d <= b.d),
s AS (SELECT w.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM w JOIN z ON z.k = w.below GROUP BY w.k)
SELECT z.conv_id, CAST(z.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM z JOIN s USING (k) LEFT JOIN o u ON u.k = z.up
"""

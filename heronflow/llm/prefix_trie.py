"""Operator 12: conversations as a prefix trie, level by level.

A node of depth d is a distinct sequence of d turns (role, text); its members
are the conversations that start with it. Level by level the live conversations
are grouped by (node, next turn); each group of two or more is a node of the next
level, named by its least conv_id. A conversation that is alone in its group
leaves the loop: all below it is a chain of its own, and is read from its turns
in one go at the end. So there are as many levels as the deepest prefix that two
conversations share, and each takes narrow rows of live conversations only. Back
from the deepest level, each level is joined with the sums of its children.

A turn is known by 128 bits of SHA-256 over role and text, taken once; turns
come along in parts of :data:`PART`, so a conversation's row stays small. No
conversation is held by one task: turns get their places by range, and joins by
conversation send the longest ones' few columns to all tasks.

``ends_sha256`` hashes a list that may be as long as the table. Its ids are sorted
by range and written in pieces of :data:`PIECE`; the pieces of a node go through
one hash in order, a batch at a time.

Cases: null roles and texts are empty; turns are ordered by turn (null first),
then role, then text, so ties and repeated rows keep a fixed order and all count;
rows without a conv_id belong to no conversation and are left out; an empty
table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import BROADCAST_ROWS, positions, spread_join, stored, table

PART, PIECE = 16, 8192
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, key, bytes and pos of every turn: key stands for role and text,
    bytes are those of the text, pos counts from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    key = F.substring(F.unhex(F.sha2(both.cast("binary"), 256)), 1, 16)
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return positions(rows, "conv_id", order, [key.alias("key"), F.octet_length("text").cast("bigint").alias("bytes")])


def _shared_levels(turns: DataFrame, sizes: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """By level: nodes of two members and more (conv_id, parent, n, bytes);
    conversations that are alone from there on (conv_id, n_turns, depth, parent);
    those that end in a shared node (depth, node, conv_id)."""
    nodes, alone, ends = [], [], []
    live = sizes.select("conv_id", "n_turns", F.lit(root).cast("bigint").alias("node"))
    depth = 0
    while True:
        ends.append(live.where(F.col("n_turns") == depth).select(F.lit(depth).cast("bigint").alias("depth"), "node", "conv_id"))
        going = live.where(F.col("n_turns") > depth)
        if depth % PART == 0:
            part = turns.where(F.col("pos").between(depth, depth + PART - 1)).groupBy("conv_id")
            going = going.drop("turns").join(part.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns")), "conv_id")
        said = F.col("turns")[depth % PART]
        ahead = going.select("conv_id", "n_turns", "node", said.key.alias("key"), said.bytes.alias("bytes"), "turns")
        groups = ahead.groupBy("node", "key").agg(F.min("conv_id").alias("kid"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
        found = stored(groups.where("n > 1"))
        n_found = found.limit(BROADCAST_ROWS + 1).count()
        # A group's rows are at most its members: of a level too large to broadcast, the largest groups still are.
        named = found.select(F.struct("node", "key").alias("at"), "kid", "n")
        rows = ahead.select("*", F.struct("node", "key").alias("at"))
        if n_found <= BROADCAST_ROWS:
            placed = rows.join(F.broadcast(named.drop("n")), "at", "left")
        else:
            inner = spread_join(rows, named, "at", "n").drop("n")
            placed = inner.unionByName(rows.join(named, "at", "left_anti").withColumn("kid", F.lit(None).cast("bigint")))
        kept = F.when(F.col("kid").isNotNull(), F.col("turns")).alias("turns")
        placed = stored(placed.select("conv_id", "n_turns", F.col("node").alias("parent"), "kid", kept))
        depth += 1
        alone.append(placed.where("kid is null").select("conv_id", "n_turns", F.lit(depth).cast("bigint").alias("depth"), "parent"))
        if n_found == 0:
            return nodes, alone, ends
        nodes.append(found.select(F.col("kid").alias("conv_id"), F.col("node").alias("parent"), "n", "bytes"))
        live = placed.where("kid is not null").select("conv_id", "n_turns", F.col("kid").alias("node"), "turns")


def _rolled_up(nodes: list[DataFrame], alone: list[DataFrame]) -> DataFrame:
    """Shared nodes of every level with the sums of what is below them."""
    done: list[DataFrame] = []
    for depth in reversed(range(len(nodes))):
        kids = alone[depth].groupBy("parent").agg(F.count("*").alias("n_children"), F.count("*").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved"))
        if done:
            kids = kids.union(done[-1].groupBy("parent").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved")))
        sums = kids.groupBy(F.col("parent").alias("conv_id")).agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")))
        saved = (F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))
        level = nodes[depth].join(sums, "conv_id", "left").select(
            "conv_id", F.lit(depth).cast("bigint").alias("depth"), "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved")
        )
        done.append(stored(level))
    out = done[0]
    for level in done[1:]:
        out = out.union(level)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, str]]:
    """(depth, node), first value and text of rows sorted by these."""
    for batch in batches:
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["depth", "node", "first", "text"]
    key, first, texts = None, 0, []
    for at, value, text in _runs(batches):
        if at != key or len(texts) == PIECE:
            if texts:
                yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, first, ",".join(texts)), strict=True))])
            key, first, texts = at, value, []
        texts.append(text)
    if texts:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, first, ",".join(texts)), strict=True))])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for at, _, text in _runs(batches):
        if at != key:
            if key:
                yield pa.RecordBatch.from_pylist([{"depth": key[0], "node": key[1], "ends": digest.hexdigest()}])
            key, digest = at, hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(text.encode())
    if key:
        yield pa.RecordBatch.from_pylist([{"depth": key[0], "node": key[1], "ends": digest.hexdigest()}])


def _ends(ends: list[DataFrame]) -> DataFrame:
    """depth, conv_id and ends of shared nodes in which conversations end."""
    rows = ends[0]
    for level in ends[1:]:
        rows = rows.union(level)
    by = ["depth", "node", "conv_id"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.col("conv_id").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces, "depth bigint, node bigint, first bigint, text string")
    sent = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return sent.mapInArrow(_hashes, "depth bigint, node bigint, ends string").withColumnRenamed("node", "conv_id")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """:data:`NODES` of ``turns`` (conv_id, pos, key, bytes; pos without gaps
    from 0) and ``sizes`` (conv_id, n_turns: 0 as well). Turn pos of
    conversation conv_id is the last one of its node of depth pos + 1. Both are
    read more than once, so they should be stored."""
    top = sizes.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if top.n == 0:
        return turns.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == NODES[-1] else 'bigint'}" for c in NODES))
    levels, alone, ends = _shared_levels(turns, sizes, top.root)
    root = turns.sparkSession.createDataFrame([(top.root, None, top.n, 0)], "conv_id bigint, parent bigint, n bigint, bytes bigint")
    shared = _rolled_up([root, *levels], alone).join(_ends(ends), ["depth", "conv_id"], "left").select("conv_id", "depth", "parent", "n", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(NOTHING)))

    chains = alone[0]
    for level in alone[1:]:
        chains = chains.union(level)
    below = spread_join(turns.select("conv_id", "pos"), chains.withColumnRenamed("depth", "since"), "conv_id", "n_turns").where(F.col("pos") + 1 >= F.col("since"))
    depth, last = F.col("pos") + 1, F.col("pos") + 1 == F.col("n_turns")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    chain = below.select(
        "conv_id", depth, F.when(depth == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")), one, F.when(last, zero).otherwise(one), one, zero,
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)),
    )
    return shared.union(chain).toDF(*NODES)


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of the rebuilt conversations: the first h turns of
    conversation c - c % 5, then those of c after its first h; h is crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    asked = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    bases = sizes.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0))).alias("lead")
    shapes = stored(asked.join(bases, "base", "left").select("conv_id", "base", "h", "n", lead))
    heads = turns.where("conv_id % 5 = 0 and pos < 8").withColumnRenamed("conv_id", "base")
    first = heads.join(shapes.select("conv_id", "base", "lead"), "base").where("pos < lead").select("conv_id", "pos", "key", "bytes")
    own = spread_join(turns.where(F.col("pos") >= h), shapes.select("conv_id", "h", "lead", "n"), "conv_id", "n")
    rest = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "key", "bytes")
    n_turns = (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")
    return stored(first.union(rest)), shapes.select("conv_id", n_turns)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*spliced(ordered_turns(table(spark, sf_dir, "conversations"))))


SQL = """
WITH bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda a, x: xor(t[xor(a, x) % 256 + 1], a // 256))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), bits
), rebuilt AS (
  SELECT c.conv_id, 0 AS half, pos, role, text FROM c JOIN own ON own.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND pos >= h
), numbered AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
    list({'r': role, 't': text}) OVER (w ROWS UNBOUNDED PRECEDING) AS said
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY half, pos)
), m AS (
  SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, said) AS node FROM numbered
  UNION ALL SELECT conv_id, 0, 0, (SELECT min(conv_id) FROM c) FROM c
), ended AS (SELECT depth, node, conv_id FROM m QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)
), hashed AS (SELECT depth, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM ended GROUP BY ALL
), nodes AS (
  SELECT m.node AS conv_id, m.depth, min(p.node) AS parent, count(*) AS n, (count(*) - 1) * any_value(m.bytes) AS own
  FROM m LEFT JOIN m AS p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1 GROUP BY ALL
), kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT a.node AS conv_id, a.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved
  FROM nodes x LEFT JOIN kids k USING (conv_id, depth) JOIN m AS a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY ALL
)
SELECT conv_id, depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) LEFT JOIN hashed ON node = nodes.conv_id AND hashed.depth = nodes.depth
"""

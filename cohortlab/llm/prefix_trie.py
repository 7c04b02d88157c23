"""Prefix trie of conversations by union-find over the longest common prefixes of sorted neighbours.

A conversation becomes a key of ``ENTRY`` bytes per turn, so sorting keys as bytes sorts conversations by
their turns, with a prefix before what continues it. Distinct keys are dealt into ranges. Within a
range the common prefix of every two neighbours is an edge; edges are taken in descending depth and
unite the components on both sides, so a component that was united at depth d is the branching node
of that depth, and the nodes between it and the node it is united into form its chain. All figures of
a node follow from running sums over the sorted keys between its first and its last one.

A range does not see what lies beyond its borders. Nodes that a border runs through, on the path to
its first or last key and no deeper than the common prefix across the border, are contracted to
partial figures, which are added up over the ranges by prefix; all other nodes are whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.llm.tables import safe_text, shuffle_partitions

#: Bytes of a turn in a key: the first half of a SHA-256 of role and text, and its code points.
ENTRY = 24
#: Bytes of keys in one range.
RANGE_BYTES = 16 << 20
#: Ids that one row lists before members of a key are put in order.
ID_BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_PATHS = "key binary, n bigint, least bigint, ends_sha256 string"
_NODES = (
    "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order (hexadecimal entries). Equal turn numbers are ordered by
    their content, null numbers come first."""
    role, text = safe_text(F.col("role")), safe_text(F.col("text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(content.cast("binary"), 256), 1, ENTRY * 2 - 16)
    entry = F.concat(digest, F.lower(F.lpad(F.hex(F.char_length(text).cast("bigint")), 16, "0")))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), entry.alias("entry")).alias("at"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return listed.select("conv_id", F.col("turns.entry").alias("turns"))


def rebuilt(conversations: DataFrame, shared: int = 6, span: int = 100) -> DataFrame:
    """``conv_id`` and ``key`` of every conversation after its first turns were replaced.

    With h = crc32(conv_id) % ``shared``, the first h turns come from the conversation at the last
    multiple of ``span`` (none if there is none), the others are its own after its first h.
    """
    own = materialize(own_turns(conversations))
    heads = own.where(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("first")
    )
    replaced = (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % shared).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(heads, "base", "left")
    lent = F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), replaced)
    rest = F.slice("turns", replaced + 1, F.greatest(F.size("turns") - replaced, F.lit(0)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(lent, rest), "")).alias("key"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from its blocks of ids, which come in order; the digest is fed block by block."""
    key, n, least, digest = None, 0, None, None

    def done(rows):
        rows.append((key, n, least, digest.hexdigest()))

    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("key", "n", "least", "ids")]
        for own, count, lowest, ids in zip(*columns):
            if digest is None or own != key:
                if digest is not None:
                    done(rows)
                key, n, least, digest = own, 0, None, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
            least = lowest if least is None else least
        yield _path_batch(rows)
    if digest is not None:
        rows = []
        done(rows)
        yield _path_batch(rows)


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, counts, least, ends = zip(*rows) if rows else ((), (), (), ())
    arrays = [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(least, pa.int64()), pa.array(ends, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "n", "least", "ends_sha256"])


def paths(sequences: DataFrame) -> DataFrame:
    """Distinct keys with the number of conversations that have exactly this key, the smallest id
    and the digest of all ids. Ids meet in blocks, then block by block, never as one list."""
    block = F.floor(F.col("conv_id") / F.lit(ID_BLOCK)).cast("bigint")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = sequences.groupBy("key", block.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    dealt = blocks.repartition(F.xxhash64("key")).sortWithinPartitions("key", F.asc_nulls_first("block"))
    return dealt.select("key", "n", "least", "ids").mapInArrow(_members, _PATHS)


def common_turns(one: bytes, other: bytes) -> int:
    """Turns at the start of both keys, found by halving."""
    low, high = 0, min(len(one), len(other)) // ENTRY
    while low < high:
        half = (low + high + 1) // 2
        if one[low * ENTRY : half * ENTRY] == other[low * ENTRY : half * ENTRY]:
            low = half
        else:
            high = half - 1
    return low


class Forest:
    """Nodes of one range of sorted distinct keys.

    ``left`` and ``right`` are the turns in common with the last key before and the first key after
    the range, -1 if there is none.
    """

    def __init__(self, keys, counts, least, ends, left: int, right: int):
        self.keys, self.ends, self.left, self.right = keys, ends, left, right
        self.count = len(keys)
        self.length = [len(k) // ENTRY for k in keys]
        #: Code points of the first d turns of a key, for every d.
        self.chars = [np.concatenate([[0], np.cumsum(np.frombuffer(k, ">u8")[2::3].astype(np.int64))]) for k in keys]
        self.lcp = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
        total = np.array([c[-1] for c in self.chars], np.int64)
        before = np.array([left if left >= 0 else 0, *self.lcp])
        fresh = np.array([c[-1] - c[d] for c, d in zip(self.chars, before)], np.int64)
        nexts = [*self.lcp, right]
        leaf = np.array([d < own for d, own in zip(nexts, self.length)], np.int64)
        counts = np.array(counts, np.int64)
        self.counts, self.texts, self.leaves, self.fresh = (
            np.concatenate([[0], np.cumsum(v)]) for v in (counts, counts * total, leaf, fresh)
        )
        # Union-find over keys; a component is (first key, last key, depth, smallest id, edges at that depth).
        self.parent = list(range(self.count))
        self.component = [(i, i, self.length[i], least[i], 0) for i in range(self.count)]
        self.rows: list[tuple] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self) -> list[tuple]:
        edges = sorted(range(self.count - 1), key=lambda i: -self.lcp[i])
        at = 0
        while at < len(edges):
            depth, merged = self.lcp[edges[at]], {}
            while at < len(edges) and self.lcp[edges[at]] == depth:
                one, other = self.find(edges[at]), self.find(edges[at] + 1)
                children = []
                for top in (one, other):
                    children += merged.pop(top, [] if self.component[top][2] == depth else [self.component[top]])
                self.join(one, other, depth)
                merged[self.find(one)] = children
                at += 1
            for top, children in merged.items():
                for child in children:
                    self.chain(child, self.component[top])
        self.chain(self.component[self.find(0)], None)
        return self.rows

    def join(self, one: int, other: int, depth: int) -> None:
        a, b = self.component[one], self.component[other]
        edges = 1 + sum(c[4] for c in (a, b) if c[2] == depth)
        lowest = min((c[3] for c in (a, b) if c[3] is not None), default=None)
        if a[1] - a[0] < b[1] - b[0]:
            one, other = other, one
        self.parent[other] = one
        self.component[one] = (a[0], b[1], depth, lowest, edges)

    def open(self, component: tuple, depth: int) -> bool:
        first, last = component[:2]
        return (first == 0 and self.left >= depth) or (last == self.count - 1 and self.right >= depth)

    def chain(self, child: tuple, above: tuple | None) -> None:
        """Nodes from a component's own depth up to the one below the node it is united into."""
        first, last, top, lowest, edges = child
        stop = above[2] if above else -1
        n = int(self.counts[last + 1] - self.counts[first])
        texts = int(self.texts[last + 1] - self.texts[first])
        leaves = int(self.leaves[last + 1] - self.leaves[first])
        later = int(self.fresh[last + 1] - self.fresh[first + 1])
        key, chars = self.keys[first], self.chars[first]
        for depth in range(top, stop, -1):
            begun = first == 0 and self.left >= depth
            skipped = int(chars[depth - 1]) if depth else 0
            # Every distinct node counts its text once: here those that no range before has counted.
            own = int(self.fresh[1] - self.fresh[0]) if begun else int(chars[-1]) - skipped
            starts = self.left == depth if begun else self.length[first] > depth
            ends = self.ends[first] if not begun and self.length[first] == depth else None
            open_ = self.open(child, depth)
            outer = child if depth - 1 > stop else above
            lifted = depth > 0 and self.open(outer, depth - 1)
            self.rows.append((
                _prefix(key, depth) if open_ else None,
                _prefix(key, depth - 1) if lifted else None,
                depth, lowest, outer[3] if depth > 0 and not lifted else None, n, (edges if depth == top else 0) + bool(starts),
                leaves, texts - n * skipped - own - later, ends if open_ else ends or EMPTY,
            ))


def _prefix(key: bytes, depth: int) -> bytes:
    """Name of a node that several ranges share."""
    return hashlib.sha256(key[: depth * ENTRY]).digest()[:16] + depth.to_bytes(8, "big")


def _build(rows: pa.Table, borders: pa.Table) -> pa.Table:
    columns = [rows.column(c).to_pylist() for c in ("key", "n", "least", "ends_sha256")]
    keys, counts, least, ends = zip(*sorted(zip(*columns), key=lambda r: r[0]))
    before, after = (borders.column(c)[0].as_py() for c in ("before", "after"))
    left = -1 if before is None else common_turns(before, keys[0])
    right = -1 if after is None else common_turns(keys[-1], after)
    nodes = Forest(keys, counts, least, ends, left, right).unite()
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [f.split()[0] for f in _NODES.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names=names)


_SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie over rows of ``conv_id`` and ``key``."""
    distinct = materialize(paths(sequences))
    total = distinct.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    ranges = max(shuffle_partitions(distinct.sparkSession), math.ceil(total / RANGE_BYTES))
    dealt = materialize(distinct.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    # One row per range, so the window that looks at neighbouring ranges stays small.
    order = Window.orderBy("range")
    borders = (
        dealt.groupBy("range")
        .agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .select("range", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    )
    pieces = materialize(dealt.groupBy("range").cogroup(borders.groupBy("range")).applyInArrow(_build, _NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = materialize(
        pieces.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums,
            F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"),
        )
    )
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = pieces.where("node IS NULL")
    inner = whole.where("parent IS NULL").select(*_SHOWN)
    edge = whole.where("parent IS NOT NULL").drop("node", "parent_conv_id").unionByName(shared.drop("node").where("parent IS NOT NULL"))
    placed = dimension_join(edge, above, ["parent"], spread_by=["conv_id", "depth"])
    root = shared.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return inner.unionByName(placed.select(*_SHOWN)).unionByName(root.select(*_SHOWN))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations, one row per node.

    ``conv_id`` is the smallest member, ``saved_tokens`` what storing every node once saves in code
    points. A null role or text counts as empty. Rows with a null id form one conversation without
    a number: it counts as a member, is the smallest only where it is the only one, and is listed
    first, as empty text. Repeated rows are repeated turns. Other columns are not read. An empty
    table gives no nodes. A conversation's turns are in one row as ``ENTRY`` bytes each.
    """
    kept = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return trie(rebuilt(kept))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, length(coalesce(text, '')) AS c
  FROM conversations
), own AS (
  SELECT conv_id, list({'h': h, 'c': c} ORDER BY turn NULLS FIRST, h) AS t FROM turns GROUP BY conv_id
), checks AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, range(0, 8 * length(conv_id::VARCHAR))::UBIGINT[]),
    lambda s, b: CASE WHEN b % 8 = 0 THEN
      CASE WHEN xor(s, ascii(substr(conv_id::VARCHAR, (b // 8)::BIGINT + 1, 1))::UBIGINT) % 2 = 1
           THEN xor(xor(s, ascii(substr(conv_id::VARCHAR, (b // 8)::BIGINT + 1, 1))::UBIGINT) // 2, 3988292384::UBIGINT)
           ELSE xor(s, ascii(substr(conv_id::VARCHAR, (b // 8)::BIGINT + 1, 1))::UBIGINT) // 2 END
      ELSE CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END END), 4294967295::UBIGINT) AS crc
  FROM own
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1:(crc % 6)::BIGINT], []), o.t[(crc % 6)::BIGINT + 1:]) AS t
  FROM own o JOIN checks USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), members AS (
  SELECT conv_id, len(t) AS total, d, list_transform(t[1:d], lambda x: x.h) AS path, coalesce(t[d].c, 0) AS chars
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN total = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY path, d
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
), kept AS (
  SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children USING (path)
), below AS (
  SELECT path[1:a] AS path, sum((k = 0)::INT)::BIGINT AS leaves, sum((n - 1) * chars)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM kept) GROUP BY 1
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children,
  leaves AS n_leaves, saved AS saved_tokens, x.ends_sha256
FROM kept x JOIN below USING (path) LEFT JOIN kept p ON x.depth > 0 AND p.path = x.path[1:x.depth - 1]
"""

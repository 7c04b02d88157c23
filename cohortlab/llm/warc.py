"""Fixity audit of WARC archives with Merkle trees.

A leaf is the digest of a whole record at its offset. Ranges of ``RANGE`` bytes hash their records in
the order of offsets, ``FANOUT`` ranges make a node of the next level, up to one root per archive. Two
replicas are compared root by root; only children of nodes that differ are compared further, and only
records of ranges that differ are read, so sound archives cost one row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.frames import materialize

RANGE_BITS = 14
FANOUT_BITS = 3
RECORDS_PER_ARCHIVE = 512
#: A record without an id goes to one of these many archives, by its length.
NAMELESS_ARCHIVES = 1024


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A response record: header lines, an empty line, the payload and two empty lines."""
    payload = F.coalesce(html, F.lit(""))
    lines = (
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(payload.cast("binary")).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )
    return F.concat(*lines)


def leaf(record: Column) -> list[Column]:
    raw = record.cast("binary")
    return [F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("digest")]


def place_records(records: DataFrame) -> DataFrame:
    """``archive`` and ``offset`` for rows with ``page_id``, ``length``, ``digest`` and ``copies``.

    Records stand in the order of id, then digest; copies of a record follow each other from its offset on. Only these narrow columns are moved. Other
    columns stay. An archive takes the ids of one block of ``RECORDS_PER_ARCHIVE`` numbers.
    """
    archive = F.coalesce(
        F.floor(F.col("page_id") / RECORDS_PER_ARCHIVE).cast("bigint"), -F.lit(1) - F.col("length") % NAMELESS_ARCHIVES
    )
    before = (
        Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    )
    return records.withColumn("archive", archive).withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))


def tree(records: DataFrame, levels: int) -> DataFrame:
    """``level``, ``archive``, ``node`` and ``digest`` of every node; the top level has the roots."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "digest", "copies")))
    line = lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["digest"], r["copies"].cast("string"))
    level = (
        records.groupBy("archive", F.shiftright("offset", RANGE_BITS).alias("node"))
        .agg(ordered.alias("held"))
        .select("archive", "node", F.sha2(F.array_join(F.transform("held", line), "\n").cast("binary"), 256).alias("digest"))
    )
    built = [level.withColumn("level", F.lit(0))]
    child = lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])
    for number in range(1, levels):
        level = (
            level.groupBy("archive", F.shiftright("node", FANOUT_BITS).alias("parent"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("held"))
            .select(
                "archive",
                F.col("parent").alias("node"),
                F.sha2(F.array_join(F.transform("held", child), "\n").cast("binary"), 256).alias("digest"),
            )
        )
        built.append(level.withColumn("level", F.lit(number)))
    return reduce(DataFrame.union, built)


def _levels(*replicas: DataFrame) -> int:
    """Levels until one node covers the largest archive."""
    tops = [r.agg(F.max("offset")).first()[0] or 0 for r in replicas]
    node, levels = max(tops) >> RANGE_BITS, 1
    while node:
        node >>= FANOUT_BITS
        levels += 1
    return levels


def _apart(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that stand on one side only."""
    other = right.select(*keys, F.col("digest").alias("_other"))
    return left.select(*keys, "digest").join(other, keys, "full").where(~F.col("digest").eqNullSafe(F.col("_other")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``archive``, ``offset``, ``status`` (``changed``,
    ``missing`` or ``extra`` on the right), ids, lengths, digests and copies of both sides.

    A replica has rows of ``archive``, ``offset``, ``length``, ``digest``, ``copies`` and ``page_id``, one per
    different record. Equal replicas, also empty ones, give no rows.
    """
    levels = _levels(left, right)
    trees = [materialize(tree(side, levels)) for side in (left, right)]
    at = lambda side, number: trees[side].where(F.col("level") == number)
    suspects = _apart(at(0, levels - 1), at(1, levels - 1), ["archive", "node"]).select("archive", "node")
    for number in range(levels - 2, -1, -1):
        above = materialize(suspects).withColumnRenamed("node", "_parent")
        below = [
            at(side, number).withColumn("_parent", F.shiftright("node", FANOUT_BITS)).join(above, ["archive", "_parent"], "left_semi")
            for side in (0, 1)
        ]
        suspects = _apart(below[0], below[1], ["archive", "node"]).select("archive", "node")
    ranges = materialize(suspects)
    held = [
        side.withColumn("node", F.shiftright("offset", RANGE_BITS)).join(ranges, ["archive", "node"], "left_semi")
        for side in (left, right)
    ]
    shown = [
        side.select("archive", "offset", *[F.col(c).alias(f"{name}_{c}") for c in ("page_id", "length", "digest", "copies")])
        for name, side in zip(("left", "right"), held)
    ]
    both = shown[0].join(shown[1], ["archive", "offset"], "full")
    status = (
        F.when(F.col("right_digest").isNull(), F.lit("missing")).when(F.col("left_digest").isNull(), F.lit("extra")).otherwise(F.lit("changed"))
    )
    apart = ~(F.col("left_digest").eqNullSafe(F.col("right_digest")) & F.col("left_copies").eqNullSafe(F.col("right_copies")))
    return both.where(apart).select(
        F.coalesce("left_page_id", "right_page_id").alias("page_id"),
        "archive",
        "offset",
        status.alias("status"),
        "left_length",
        "right_length",
        "left_digest",
        "right_digest",
        "left_copies",
        "right_copies",
    )


#: Damage of the second replica, by id modulo ``DAMAGE_EVERY``: a changed last character, a record
#: lost on the right, a payload cut to half, a record lost on the left.
DAMAGE_EVERY = 97


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archives of ``pages`` and a replica with known damage, on one layout.

    Equal pages (id, address and payload) are copies of one record, which all keep their place. A null address or payload is empty; a
    record without an id is undamaged. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    kind = F.coalesce(F.pmod(F.col("page_id"), F.lit(DAMAGE_EVERY)), F.lit(DAMAGE_EVERY))
    chars = F.char_length(html)
    damaged = (
        F.when(kind == 0, F.concat(F.substring(html, F.lit(1), F.greatest(chars - 1, F.lit(0))), F.lit("#")))
        .when(kind == 2, F.substring(html, F.lit(1), (chars / 2).cast("int")))
        .otherwise(html)
    )
    whole = record_text(F.col("page_id"), F.col("url"), html)
    other = leaf(record_text(F.col("page_id"), F.col("url"), damaged))
    narrow = pages.select("page_id", kind.alias("kind"), *leaf(whole), other[0].alias("other_length"), other[1].alias("other_digest"))
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("copies"))
    placed = materialize(place_records(counted))
    left = placed.where("kind <> 3").select("archive", "offset", "length", "digest", "copies", "page_id")
    right = placed.where("kind <> 1").select(
        "archive", "offset", F.col("other_length").alias("length"), F.col("other_digest").alias("digest"), "copies", "page_id"
    )
    return left, right


#: The same replicas compared record by record, for DuckDB.
ORACLE = """
WITH texts AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         coalesce(((page_id % 97) + 97) % 97, 97) AS kind
  FROM pages
), damaged AS (
  SELECT *, CASE kind WHEN 0 THEN left(html, greatest(length(html) - 1, 0)) || '#'
                      WHEN 2 THEN left(html, length(html) // 2) ELSE html END AS other
  FROM texts
), records AS (
  SELECT page_id, kind,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
           || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
           || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, other
  FROM damaged
), leaves AS (
  SELECT page_id, kind, strlen(a) AS length, sha256(a) AS digest, strlen(b) AS other_length, sha256(b) AS other_digest, count(*) AS copies
  FROM (SELECT page_id, kind, head || strlen(html)::VARCHAR || gap || html || gap AS a,
               head || strlen(other)::VARCHAR || gap || other || gap AS b FROM records)
  GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT *, coalesce(floor(page_id / 512)::BIGINT, -1 - length % 1024) AS archive FROM leaves)
)
SELECT page_id, archive, "offset",
       CASE kind WHEN 1 THEN 'missing' WHEN 3 THEN 'extra' ELSE 'changed' END AS status,
       CASE WHEN kind <> 3 THEN length END AS left_length, CASE WHEN kind <> 1 THEN other_length END AS right_length,
       CASE WHEN kind <> 3 THEN digest END AS left_digest, CASE WHEN kind <> 1 THEN other_digest END AS right_digest,
       CASE WHEN kind <> 3 THEN copies END AS left_copies, CASE WHEN kind <> 1 THEN copies END AS right_copies
FROM placed
WHERE kind IN (1, 3) OR digest <> other_digest
"""

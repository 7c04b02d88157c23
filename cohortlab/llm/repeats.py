"""Passages that repeat word for word, in or between documents, by seed and extend.

Seeds are winnowed anchors: of every ``LEAST`` words in a row, the run of ``SEED`` words with the
smallest hash is an anchor, so two equal passages of that length have an equal anchor at the same
place. Documents are joined on anchors. Each anchor that occurs twice is extended to the left and to
the right, to all extents of ``LEAST`` words for which it is the anchor; two occurrences match over
an extent if its hash is equal as well. Longer matches are unions of such extents, and the maximal
stretches of them are the repeats.

No pairs are formed: occurrences of an anchor meet in one place as hashes and are counted by extent.
Texts travel once, in buckets of about ``BUCKET_BYTES``; a bucket sends each of its anchors and extents
once, packed by part of the hash space, and gets back which of them other buckets have too. So an
anchor that stands in every document is one entry per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.llm.tables import safe_text
from cohortlab.llm.words import run_hashes, row_slices, runs, text_buffer, word_table

LEAST, SEED = 35, 20
#: Anchors are the least of this many runs.
CHOICES = LEAST - SEED + 1
BUCKET_BYTES = 4 << 20
#: Bytes of text whose hashes one task compares, and the least number of such parts. Both follow from
#: the texts alone, so the number of packed rows does too.
PART_BYTES = 32 << 20
LEAST_PARTS = 64
_KEY = 0x51ED270B
_MASKS = "part int, b int, anchors binary"
_EXTENTS = "part int, b int, anchors binary, sizes binary, extents binary"
_FOUND = "b int, part int, anchors binary, bits binary"
_TEXTS = (
    "h1 bigint, h2 bigint, n_words bigint, n_removed bigint, "
    "spans array<struct<start:bigint,end:bigint>>, kept string"
)


def _slide(values: np.ndarray, pick) -> np.ndarray:
    """``pick`` (a minimum or maximum) over every ``CHOICES`` values in a row."""
    width = 1
    while width * 2 <= CHOICES:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = CHOICES - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Bucket:
    """Anchors and extents of the distinct texts of one bucket."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        # The same text can come from several tasks; one of each is enough.
        _, first = np.unique(keys, axis=0, return_index=True) if len(keys) else (None, np.zeros(0, np.int64))
        table = table.take(np.sort(first))
        self.keys = keys[np.sort(first)]
        self.texts = table.column("text").combine_chunks() if len(first) else pa.array([], pa.string())
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks)
        _, places = text_buffer(self.texts)
        self.slices = []
        seeds = [np.zeros(0, np.uint64)]
        for low, high in row_slices(places):
            words = word_table(self.texts.slice(low, high - low), folded=False)
            grams = run_hashes(words.hashes, SEED)
            if len(words.hashes) < LEAST:
                empty = np.zeros(0, np.uint64)
                self.slices.append((low, high, words.offsets, np.zeros(0, np.int64), empty, empty))
                continue
            anchors = _slide(grams, np.minimum)
            extents = run_hashes(words.hashes, LEAST)
            ends = np.repeat(words.offsets[1:], words.counts)[: len(extents)]
            inside = np.arange(len(extents)) + LEAST <= ends
            # A run is an anchor if it is the least one of any extent that holds it.
            highest = np.concatenate([np.zeros(CHOICES - 1, np.uint64), np.where(inside, anchors, np.uint64(0)), np.zeros(CHOICES - 1, np.uint64)])
            seeds.append(grams[_slide(highest, np.maximum) == grams])
            at = np.flatnonzero(inside)
            self.slices.append((low, high, words.offsets, at, anchors[at], extents[at]))
        self.seeds, self.seed_counts = np.unique(np.concatenate(seeds), return_counts=True)

    def pairs(self, elsewhere: np.ndarray, parts: int):
        """Distinct (anchor, extent) pairs at anchors that occur twice, by part, then by hash, with
        their number of places here, and for every place its pair (-1: none)."""
        twice = np.union1d(self.seeds[self.seed_counts > 1], elsewhere)
        anchors = np.concatenate([np.zeros(0, np.uint64), *[s[4] for s in self.slices]])
        extents = np.concatenate([np.zeros(0, np.uint64), *[s[5] for s in self.slices]])
        pair = np.full(len(anchors), -1, np.int64)
        held = np.flatnonzero(_among(anchors, twice))
        anchors, extents = anchors[held], extents[held]
        part = (anchors % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((extents, anchors, part))
        anchors, extents, part = anchors[order], extents[order], part[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (extents[1:] != extents[:-1])
        pair[held[order]] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        return part[starts], anchors[starts], extents[starts], np.diff(np.append(starts, len(order))), pair


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _uint64(values: pa.Array | list) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in (values.to_pylist() if not isinstance(values, list) else values)]


def _anchors(parts: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("b")[0].as_py()
        seeds = Bucket(table).seeds
        part = (seeds % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, seeds = part[order], seeds[order]
        cuts = np.append(runs(part), len(part))
        rows = [(int(part[a]), bucket, seeds[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return _table(rows, [("part", pa.int32()), ("b", pa.int32()), ("anchors", pa.binary())])

    return run


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _recurring_anchors(table: pa.Table) -> pa.Table:
    """Of one part: for each bucket the anchors that another bucket has too."""
    buckets, held = table.column("b").to_pylist(), _uint64(table.column("anchors"))
    every = np.concatenate(held)
    values, counts = np.unique(every, return_counts=True)
    known = values[counts > 1]
    rows = [(b, own[_among(own, known)]) for b, own in zip(buckets, held)]
    part = table.column("part")[0].as_py()
    rows = [(part, b, own.tobytes()) for b, own in rows if len(own)]
    return _table(rows, [("part", pa.int32()), ("b", pa.int32()), ("anchors", pa.binary())])


def _extents(parts: int):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        fields = [("part", pa.int32()), ("b", pa.int32()), ("anchors", pa.binary()), ("sizes", pa.binary()), ("extents", pa.binary())]
        if not texts.num_rows:
            return _table([], fields)
        bucket = texts.column("b")[0].as_py()
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *_uint64(marks.column("anchors"))]))
        part, anchors, extents, _, _ = Bucket(texts).pairs(known, parts)
        cuts = np.append(runs(part), len(part))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = np.append(runs(anchors[a:b]), b - a)
            rows.append((int(part[a]), bucket, anchors[a:b][heads[:-1]].tobytes(), np.diff(heads).astype(np.uint32).tobytes(), extents[a:b].tobytes()))
        return _table(rows, fields)

    return run


def _recurring_extents(table: pa.Table) -> pa.Table:
    """Of one part: for each bucket, one bit per pair, set if another bucket has the pair too."""
    part = table.column("part")[0].as_py()
    packed = table.column("anchors").to_pylist()
    heads, extents = _uint64(packed), _uint64(table.column("extents"))
    sizes = [np.frombuffer(s, np.uint32) for s in table.column("sizes").to_pylist()]
    anchors = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes)])
    every = np.concatenate(extents)
    order = np.lexsort((every, anchors))
    a, e = anchors[order], every[order]
    same = (a[1:] == a[:-1]) & (e[1:] == e[:-1])
    again = np.zeros(len(order), bool)
    again[1:] = same
    again[:-1] |= same
    shared = np.empty(len(order), bool)
    shared[order] = again
    rows, at = [], 0
    for b, head, own in zip(table.column("b").to_pylist(), packed, extents):
        bits = shared[at : at + len(own)]
        at += len(own)
        if bits.any():
            rows.append((b, part, head, np.packbits(bits).tobytes()))
    return _table(rows, [("b", pa.int32()), ("part", pa.int32()), ("anchors", pa.binary()), ("bits", pa.binary())])


def _cut(parts: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        fields = [
            ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()),
        ]
        if not texts.num_rows:
            return _table([], fields)
        bucket = Bucket(texts)
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *_uint64(found.column("anchors"))]))
        part, anchors, _, places, pair = bucket.pairs(known, parts)
        repeated = places > 1
        for number, head, bits in zip(found.column("part").to_pylist(), found.column("anchors").to_pylist(), found.column("bits").to_pylist()):
            # The pairs that were sent for this part, in the order in which they were sent.
            sent = np.arange(*np.searchsorted(part, [number, number + 1]))
            sent = sent[_among(anchors[sent], np.frombuffer(head, np.uint64))]
            repeated[sent] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(sent)).astype(bool)
        hit = (pair >= 0) & np.append(repeated, False)[pair]
        rows, at = [], 0
        for low, high, offsets, starts, _, _ in bucket.slices:
            begins = starts[hit[at : at + len(starts)]]
            at += len(starts)
            edges = np.zeros(offsets[-1] + 1, np.int64)
            np.add.at(edges, begins, 1)
            np.add.at(edges, begins + LEAST, -1)
            gone = np.cumsum(edges)[:-1] > 0
            for i in range(low, high):
                own = gone[offsets[i - low] : offsets[i - low + 1]]
                words = (bucket.texts[i].as_py() or "").encode().split()
                kept = words if not own.any() else compress(words, ~own)
                rows.append((int(bucket.keys[i, 0]), int(bucket.keys[i, 1]), len(own), int(own.sum()), _spans(own), b" ".join(kept).decode()))
        return _table(rows, fields)

    return run


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those whose text the task has passed on before."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist()))
        new = []
        for key in keys:
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def _keyed(docs: DataFrame) -> DataFrame:
    text = safe_text(F.col("text"))
    return docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(_KEY), text).alias("h2"), text.alias("text"))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (``doc_id``, ``h1``, ``h2``: two hashes of the text), and one row per distinct text:
    its hashes, ``n_words``, ``n_removed``, ``spans`` (maximal stretches of repeated words, end
    exclusive) and the ``kept`` words joined by one space.

    A text that several rows have repeats as a whole if it has ``LEAST`` words; shorter ones cannot
    repeat. A null text counts as empty and has no words. Windows do not cross texts. A repeat may
    overlap itself. Texts are told apart by 128 bits, extents by 128 bits (anchor and extent).
    Other columns are not read. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    rows = materialize(keyed.select("doc_id", "h1", "h2", F.octet_length("text").alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    parts = max(LEAST_PARTS, math.ceil(total / PART_BYTES))
    bucket = F.pmod(F.col("h1"), F.lit(buckets)).cast("int").alias("b")
    texts = keyed.select("h1", "h2", bucket, "text").mapInArrow(_first_in_task, "h1 bigint, h2 bigint, b int, text string")
    by_bucket = texts.groupBy("b")
    sent = by_bucket.applyInArrow(_anchors(parts), _MASKS)
    marks = sent.groupBy("part").applyInArrow(_recurring_anchors, _MASKS)
    extents = by_bucket.cogroup(marks.groupBy("b")).applyInArrow(_extents(parts), _EXTENTS)
    found = extents.groupBy("part").applyInArrow(_recurring_extents, _FOUND)
    cut = by_bucket.cogroup(found.groupBy("b")).applyInArrow(_cut(parts), _TEXTS)
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= LEAST)
    span = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    results = cut.join(copies, ["h1", "h2"]).select(
        "h1",
        "h2",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, span).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return rows.select("doc_id", "h1", "h2"), results


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` and the ``kept`` text of every row."""
    rows, results = find_repeats(docs)
    return dimension_join(rows, materialize(results), ["h1", "h2"], spread_by=["doc_id"]).drop("h1", "h2")


def digest_documents(docs: DataFrame) -> DataFrame:
    """What is removed from every document, with SHA-256 of the words that stay."""
    rows, results = find_repeats(docs)
    digests = materialize(results.select("h1", "h2", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
    return dimension_join(rows, digests, ["h1", "h2"], spread_by=["doc_id"]).drop("h1", "h2")


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM texts WHERE len(w) >= 35
), windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY sha256(array_to_string(w[p:p + 34], ' '))) AS copies FROM places
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM windows WHERE copies > 1
), lost AS (
  SELECT r, list(i) AS gone, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(gone, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' '), '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (r)
"""

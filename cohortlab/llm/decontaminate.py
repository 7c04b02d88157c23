"""Benchmark decontamination with spaced seeds.

Fixed masks over windows of words ignore some positions, so a window still meets its copy when words
at those positions were substituted. Hashes of the masked windows of the test items are joined with
those of the documents, and around every hit the two texts are compared word by word on that diagonal:
a stretch counts that has at least ``MIN_WORDS`` words (or the whole item, if it is shorter) of which
at least ``MIN_SAME`` of 100 agree. Every such stretch has a masked window without a substitution.

Test items are taken in blocks of at most ``BLOCK_BYTES`` of text, one scan of the documents per
block, so what is broadcast has a fixed bound and a test set of any size is handled. Documents are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.words import mix, slices_of, word_table

SPAN = 10
#: Positions that are compared; the others may differ. Any two substitutions in twelve words leave a
#: window that one of the masks accepts.
MASKS = ("1100010111", "1001100111", "1101101001", "1010011101")
#: With these, any 3 substitutions in 12 words do, any 4 in 16 and any 5 in 20. Each longer stretch that
#: agrees enough holds one of these, or falls into two of which one agrees enough.
MORE_MASKS = ("11111001", "110101000011", "1110001011", "1001011011", "110000101011")
#: By length, masks over whole items below ``MIN_WORDS``. Of up to three words none may differ, of up to
#: seven one and of up to eleven two.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("0111", "1011", "1101", "1110"),
    5: ("00111", "11001", "01110"),
    6: ("001111", "110011", "111100"),
    7: ("0011111", "1100111", "1111001", "0111110"),
    8: ("00001111", "01110001", "10010110", "11101000", "10011001", "01100110"),
    9: ("000011111", "011100011", "101101100", "110010101", "110011010", "001110110", "001111001", "010001111"),
    10: (
        "0000111111", "0111000111", "0111111000", "1001011011", "1001101101", "1001110110", "1110001110", "1110110001", "1111001001",
    ),
    11: (
        "00000111111", "01111000011", "10011011100", "11100100101", "11100011010", "10011100011", "01111100100", "00011111001",
    ),
}
MIN_WORDS = 12
MIN_SAME = 75
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22
_KEYS = mix(np.arange(1, MIN_WORDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def masked_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the compared positions of every window, by window start."""
    n = len(hashes) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, kept in enumerate(mask):
            if kept == "1":
                total += hashes[k : k + n] * _KEYS[k]
    return mix(total ^ np.uint64(len(mask)))


@dataclass
class Seeds:
    """Hashes of one block of test items: sorted seeds by mask, with item and position."""

    ids: list
    words: list[np.ndarray]
    masks: list[str]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    at: list[np.ndarray]
    present: list[np.ndarray]


def item_seeds(ids: list, texts: list[str | None]) -> Seeds:
    table = word_table(pa.array([text or "" for text in texts], pa.string()))
    words = [table.hashes[a:b] for a, b in zip(table.offsets, table.offsets[1:])]
    # Items below the least stretch are compared whole, by masks of their own length (0: all others).
    by_length: dict[int, list[int]] = {}
    for i, own in enumerate(words):
        if len(own):
            by_length.setdefault(len(own) if len(own) < MIN_WORDS else 0, []).append(i)
    pairs = [(mask, fits) for n, fits in sorted(by_length.items()) for mask in (SHORT_MASKS[n] if n else (*MASKS, *MORE_MASKS))]
    seeds = Seeds(ids, words, [mask for mask, _ in pairs], [], [], [], [])
    for mask, fits in pairs:
        parts = [masked_hashes(words[i], mask) for i in fits]
        item = np.repeat(np.array(fits, np.int32), [len(p) for p in parts])
        at = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(p), dtype=np.int32) for p in parts]])
        hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        seeds.hashes.append(hashes[order])
        seeds.items.append(item[order])
        seeds.at.append(at[order])
        seeds.present.append(present)
    return seeds


def longest_stretch(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest stretch of at least ``least`` words that agrees enough, if there is one, without
    differing words at its ends as far as ``least`` allows."""
    if len(same) < least:
        return None
    # A difference costs as much as ``MIN_SAME`` allows for, so a stretch agrees enough if its total is not negative.
    total = np.concatenate(([0], np.cumsum(np.where(same, 100 - MIN_SAME, -MIN_SAME))))
    # The first place with a total no higher than that at the end is where the running minimum gets there.
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    start = int(first[end])
    if end - start < least:
        return None
    while end - start > least and not same[end - 1]:
        end -= 1
    while end - start > least and not same[start]:
        start += 1
    return start, end


def overlaps_in(words: np.ndarray, hits: set[tuple[int, int]], seeds: Seeds) -> list[tuple]:
    """Verified stretches of one document: per item, of the longest on each hit diagonal the one with
    most words that agree."""
    best: dict[int, tuple] = {}
    for item, shift in sorted(hits):
        theirs = seeds.words[item]
        low, high = max(0, -shift), min(len(theirs), len(words) - shift)
        same = words[low + shift : high + shift] == theirs[low:high]
        found = longest_stretch(same, min(MIN_WORDS, len(theirs)))
        if found is None:
            continue
        start, end = found
        equal = int(same[start:end].sum())
        if item not in best or equal > best[item][3]:
            best[item] = (low + start + shift, low + start, end - start, equal)
    return [(seeds.ids[item], *best[item]) for item in sorted(best)]


def scan(column: pa.Array, seeds: Seeds) -> list[list[tuple]]:
    """Overlaps of each text of a slice."""
    table = word_table(column)
    hits: dict[int, set[tuple[int, int]]] = {}
    for mask, hashes, items, at, present in zip(seeds.masks, seeds.hashes, seeds.items, seeds.at, seeds.present):
        windows = masked_hashes(table.hashes, mask)
        maybe = np.flatnonzero(present[(windows & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        low = np.searchsorted(hashes, windows[maybe], "left")
        high = np.searchsorted(hashes, windows[maybe], "right")
        owner = np.searchsorted(table.offsets, maybe, "right") - 1
        inside = (high > low) & (maybe + len(mask) <= table.offsets[owner + 1])
        for place, own, a, b in zip(maybe[inside], owner[inside], low[inside], high[inside]):
            start = int(place - table.offsets[own])
            hits.setdefault(int(own), set()).update((int(items[k]), start - int(at[k])) for k in range(a, b))
    found: list[list[tuple]] = [[] for _ in range(len(table.offsets) - 1)]
    for own, places in hits.items():
        found[own] = overlaps_in(table.hashes[table.offsets[own] : table.offsets[own + 1]], places, seeds)
    return found


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """Test items in blocks of bounded size; only one block at a time is on the driver."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        share = items if count == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == block)
        rows = share.distinct().collect()
        if rows:
            yield item_seeds([r[0] for r in rows], [r[1] for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that overlap: places and length in words, words that
    agree. Words are lower-cased (A-Z) runs other than white space.

    Null and empty texts, of documents or items, overlap with nothing; equal items are one item
    each under their own id; a repeated document row gives its rows again; other columns are not
    read. An empty test set gives no rows.
    """
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_word bigint, item_word bigint, n_words bigint, n_same bigint"
    scans = []
    for seeds in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(seeds)

        def scan_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices_of(batch, "text"):
                    found = scan(part.column(1), shared.value)
                    rows = [i for i, own in enumerate(found) for _ in own]
                    flat = [o for own in found for o in own]
                    columns = [pa.array([o[k] for o in flat]) for k in range(1, 5)] if flat else []
                    if flat:
                        ids = part.column(0).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([o[0] for o in flat]), *columns],
                            names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"],
                        )

        scans.append(docs.select("doc_id", "text").mapInArrow(scan_batches, schema))
    return reduce(DataFrame.union, scans) if scans else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, all columns kept; one scan per block, no shuffle."""
    spark, names = docs.sparkSession, docs.columns
    at = names.index("text")
    for seeds in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(seeds)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices_of(batch, "text"):
                    clean = [not found for found in scan(part.column(at), shared.value)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The trie holds the byte contexts of up to ``ORDER`` bytes of the training texts (A-Z as a-z), each text
led by ``ORDER`` start marks and closed by an end mark. A symbol is predicted in the longest context
that occurred; where it did not follow, the model escapes (method C: as many escapes as distinct
symbols) to the next shorter context, without the symbols of the context it left (exclusion), and at
last to a uniform choice. The score is the log10 probability of a text with its end mark.

Every node is kept. Those of orders up to ``SHARED`` are broadcast: they number at most 256 to the power
of ``SHARED`` + 1, whatever the size of the corpus. The others are dealt by the hash of the last bytes of
their context. The distinct grams of each group of slices of texts meet them there, packed, and go back
to the group's texts with their log probabilities. ``NODES`` can leave out nodes below 1 / ``NODES`` of the training
bytes; what a context loses in this way counts as escapes from it.

The base counts words, and its words travel as the grams do: counts are summed in the same table, each group
asks for its distinct words once, whatever number of its texts hold them, and adds up its texts itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import materialize
from cohortlab.llm.tables import fold, shuffle_partitions
from cohortlab.llm.words import mix, runs, slices_of, sum_by_row, text_buffer, word_table

FOLDS, HELD_OUT = 5, 1
ORDER = 5
#: Highest order whose nodes are broadcast; longer contexts are dealt by one byte more.
SHARED = 2
#: None keeps all nodes.
NODES: int | None = None
#: Marks that do not occur in UTF-8.
START, END = 0xFE, 0xFF
SYMBOLS = 255
#: The end of a text as a word, and the kinds of what is counted.
END_WORD, GRAM, WORD = np.uint64(0), 0, 1
FLUSH_GRAMS = 1 << 19
#: Slices of texts whose grams are looked up together, and the level at which texts are compressed.
GROUP, LEVEL = 8, 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and for its end mark the byte and the ``ORDER`` before it, as one
    number (the byte lowest), and the offsets of the texts."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    lead = ORDER + 1
    padded = np.empty(len(data) + n * lead + ORDER, np.uint8)
    starts = offsets[:-1] + np.arange(n) * lead
    inside = np.ones(len(padded), bool)
    for k in range(ORDER):
        padded[starts + k] = START
        inside[starts + k] = False
    ends = offsets[1:] + np.arange(n) * lead + ORDER
    padded[ends] = END
    inside[ends] = False
    inside[len(data) + n * lead :] = False
    padded[inside] = _LOWER[data]
    inside[ends] = True
    at = np.flatnonzero(inside)
    grams = np.zeros(len(at), np.uint64)
    for k in range(ORDER, -1, -1):
        grams = (grams << np.uint64(8)) | padded[at - k]
    return grams, offsets + np.arange(n + 1)


def _count_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams (kind ``GRAM``) and of words (kind ``WORD``) per task, merged before they leave it."""

    def shown(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(keys), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "gram", "n"])

    held = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for kind in (GRAM, WORD)}
    for batch in batches:
        for part in slices_of(batch, "text"):
            for kind, own in ((GRAM, byte_grams(part.column(0))[0]), (WORD, _words(part.column(0))[0])):
                own = np.sort(own)
                heads = runs(own)
                keys, counts = held[kind]
                number = np.diff(np.append(heads, len(own)))
                held[kind] = _merged(np.concatenate((keys, own[heads])), np.concatenate((counts, number)))
                if len(held[kind][0]) >= FLUSH_GRAMS:
                    yield shown(kind, *held[kind])
                    held[kind] = keys[:0], counts[:0]
    for kind, (keys, counts) in held.items():
        if len(keys):
            yield shown(kind, keys, counts)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each text's closed by its end, and the offsets of the texts."""
    table = word_table(column)
    n = len(table.offsets) - 1
    offsets = table.offsets + np.arange(n + 1)
    hashes = np.full(offsets[-1], END_WORD, np.uint64)
    inside = np.ones(len(hashes), bool)
    inside[offsets[1:] - 1] = False
    hashes[inside] = table.hashes
    return hashes, offsets


@dataclass
class Trie:
    """By order: sorted contexts with totals, distinct symbols and what their longer contexts
    exclude; sorted (context, symbol) nodes with counts."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    nodes: list[np.ndarray]
    counts: list[np.ndarray]
    #: Count in the next shorter context of the symbols that follow this context.
    excluded: list[np.ndarray]
    #: Occurrences of the context followed by a symbol that was left out.
    pruned: list[np.ndarray]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def build_trie(nodes: list[np.ndarray], counts: list[np.ndarray], total: int, limit: int | None) -> Trie:
    """``nodes[k]``: sorted context (k bytes) and symbol in one number; ``counts[k]``: how often."""
    trie = Trie([], [], [], [], [], [], [])
    for k, (own, number) in enumerate(zip(nodes, counts)):
        every = runs(own >> np.uint64(8))
        before = np.add.reduceat(number, every) if len(every) else number[:0]
        before = np.repeat(before, np.diff(np.append(every, len(own))))
        if limit is not None:
            kept = number * limit >= total
            own, number, before = own[kept], number[kept], before[kept]
        trie.nodes.append(own)
        trie.counts.append(number)
        context = own >> np.uint64(8)
        heads = runs(context)
        trie.contexts.append(context[heads])
        trie.totals.append(np.add.reduceat(number, heads) if len(heads) else number[:0])
        trie.distinct.append(np.diff(np.append(heads, len(own))))
        if k:
            at, seen = _found(trie.nodes[k - 1], own & np.uint64((1 << (8 * k)) - 1))
            below = np.where(seen, trie.counts[k - 1][at] if len(trie.counts[k - 1]) else 0, 0)
            trie.excluded.append(np.add.reduceat(below, heads) if len(heads) else below[:0])
        else:
            trie.excluded.append(np.zeros(len(heads), np.int64))
        # Start marks are no symbols, so a context that ends with one has no count of its own.
        marked = (trie.contexts[k] & np.uint64(0xFF)) == START
        trie.pruned.append(np.where(marked, 0, before[heads] - trie.totals[k]))
    return trie


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = runs(keys)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


@dataclass
class Low:
    """Nodes and counts of the orders up to ``SHARED``, the training bytes and the limit of nodes."""

    nodes: list[np.ndarray]
    counts: list[np.ndarray]
    total: int
    limit: int | None


def train(texts: DataFrame) -> tuple[DataFrame, Low]:
    """Counts of all grams and words of the training texts (column ``text``) as a written table, and low
    orders."""
    both = texts.select("text").mapInArrow(_count_both, "kind int, gram bigint, n bigint")
    counted = materialize(both.groupBy("kind", "gram").agg(F.sum("n").alias("n")))
    grams = counted.where(F.col("kind") == GRAM)
    total = grams.agg(F.sum("n")).first()[0] or 0
    low = Low([], [], total, NODES)
    for k in range(SHARED + 1):
        node = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        own = grams.groupBy(node.alias("node")).agg(F.sum("n").alias("n")).toPandas()
        keys, counts = _merged(own["node"].to_numpy(np.int64).astype(np.uint64), own["n"].to_numpy(np.int64))
        low.nodes.append(keys)
        low.counts.append(counts)
    return counted, low


def part_trie(keys: np.ndarray, counts: np.ndarray, low: Low) -> Trie:
    """Trie of the low orders and of all longer contexts that were dealt to one part."""
    nodes, numbers = list(low.nodes), list(low.counts)
    for k in range(SHARED + 1, ORDER + 1):
        own, number = _merged(keys & np.uint64((1 << (8 * (k + 1))) - 1), counts)
        nodes.append(own)
        numbers.append(number)
    return build_trie(nodes, numbers, low.total, low.limit)


def gram_parts(grams: np.ndarray, parts: int) -> np.ndarray:
    """Part of each gram, by the last bytes of its context."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * (SHARED + 1))) - 1)
    return (mix(context) % np.uint64(parts)).astype(np.int64)


def word_parts(words: np.ndarray, parts: int) -> np.ndarray:
    return (words % np.uint64(parts)).astype(np.int64)


def by_part(place: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """A stable order by part, and part, start and end of each part in it."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    edges = np.append(runs(place), len(place))
    return order, ((int(place[a]), int(a), int(b)) for a, b in zip(edges, edges[1:]))


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, led by how many there are."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def gram_log10(grams: np.ndarray, trie: Trie) -> np.ndarray:
    """log10 probability of each gram's last byte after the bytes before it."""
    n = len(grams)
    result, done = np.zeros(n), np.zeros(n, bool)
    # Of the context left last: distinct symbols, and their count one order below.
    gone, gone_count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(ORDER, -1, -1):
        key = grams & np.uint64((1 << (8 * (k + 1))) - 1)
        at, known = _found(trie.contexts[k], key >> np.uint64(8))
        open_ = known & ~done
        if not open_.any():
            continue
        at = at[open_]
        total = trie.totals[k][at] - gone_count[open_]
        distinct = trie.distinct[k][at] - gone[open_]
        place, hit = _found(trie.nodes[k], key[open_])
        escapes = distinct + trie.pruned[k][at]
        whole = total + escapes
        some = whole > 0
        count = np.where(hit, trie.counts[k][place], escapes)
        step = np.where(some, np.log10(np.maximum(count, 1) / np.maximum(whole, 1)), 0.0)
        result[open_] += step
        hits = np.flatnonzero(open_)[hit]
        done[hits] = True
        gone[open_] = trie.distinct[k][at]
        gone_count[open_] = trie.excluded[k][at]
    rest = ~done
    result[rest] -= np.log10(np.maximum(SYMBOLS - gone[rest], 1))
    return result


def text_log10(column: pa.Array, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Score of each text of a slice from sorted grams, all of the slice's among them, and their log
    probabilities."""
    grams, offsets = byte_grams(column)
    order = np.argsort(grams)
    ordered = grams[order]
    heads = runs(ordered)
    each = np.empty(len(grams))
    each[order] = np.repeat(values[np.searchsorted(known, ordered[heads])], np.diff(np.append(heads, len(ordered))))
    return sum_by_row(each, offsets)


#: Rows that meet: texts of a slice, what a group asks for, and counts.
TEXTS, ASKED, COUNTS = 0, 2, 4
PACKED = "part int, slice bigint, kind int, a binary, b binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "slice", "kind", "a", "b"])


_PARTS = {GRAM: gram_parts, WORD: word_parts}


def _pack_counts(parts: int):
    """Rows of kind ``COUNTS`` plus what is counted: grams or words of one part with their counts."""

    def shown(kind: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        known, number = _merged(np.concatenate(keys), np.concatenate(counts))
        order, spans = by_part(_PARTS[kind](known, parts))
        return _packed([(part, -1, COUNTS + kind, squeezed(known[order[a:b]]), squeezed(number[order[a:b]])) for part, a, b in spans])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: ([], [], []) for kind in _PARTS}
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for kind, (keys, counts, sizes) in held.items():
                own = np.flatnonzero(kinds == kind)
                if not len(own):
                    continue
                keys.append(batch.column(1).to_numpy()[own].view(np.uint64))
                counts.append(batch.column(2).to_numpy()[own])
                sizes.append(len(own))
                if sum(sizes) >= FLUSH_GRAMS:
                    yield shown(kind, keys, counts)
                    held[kind] = ([], [], [])
        for kind, (keys, counts, _) in held.items():
            if keys:
                yield shown(kind, keys, counts)

    return pack


def _pack_texts(parts: int):
    """Per slice of texts: one row of kind ``TEXTS`` with the texts and their own columns. Per group of
    slices: one row of kind ``ASKED`` plus what is asked for per part, with the distinct grams or words. Texts
    are numbered and all rows named by group."""

    def asked(known: dict[int, np.ndarray], name: int) -> pa.RecordBatch:
        out = []
        for kind, own in known.items():
            order, spans = by_part(_PARTS[kind](own, parts))
            out += [(p, name, ASKED + kind, squeezed(own[order[a:b]]), b"") for p, a, b in spans]
        return _packed(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = {kind: np.zeros(0, np.uint64) for kind in _PARTS}
        task, number, first, known = TaskContext.get().partitionId(), 0, 0, dict(nothing)
        for batch in batches:
            for part in slices_of(batch, "text"):
                name = task << 32 | number // GROUP
                info = pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(1)], names=["doc_id", "held_out", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
                    writer.write_batch(info)
                yield _packed([(name % parts, name, TEXTS, sink.getvalue().to_pybytes(), first.to_bytes(8, "little"))])
                for kind, own in ((GRAM, byte_grams(part.column(1))[0]), (WORD, _words(part.column(1))[0])):
                    own.sort()
                    known[kind] = np.union1d(known[kind], own[runs(own)])
                number, first = number + 1, first + part.num_rows
                if number % GROUP == 0:
                    yield asked(known, name)
                    first, known = 0, dict(nothing)
        if first:
            yield asked(known, name)

    return pack


def _weighed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["slice", "kind", "a", "b"])


def _weigh(shared):
    """What is asked for meets the counts of its part. Log probabilities of grams and counts of words go back
    with what was asked; texts go through."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {kind: [] for kind in _PARTS}
        keys = {kind: [np.zeros(0, np.uint64)] for kind in _PARTS}
        counts = {kind: [np.zeros(0, np.int64)] for kind in _PARTS}
        for batch in batches:
            for _, name, kind, a, b in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if kind == TEXTS:
                    yield _weighed([(name, TEXTS, a, b)])
                elif kind < COUNTS:
                    asked[kind - ASKED].append((name, unsqueezed(a, np.uint64)))
                else:
                    keys[kind - COUNTS].append(unsqueezed(a, np.uint64))
                    counts[kind - COUNTS].append(unsqueezed(b, np.int64))
        for kind in _PARTS:
            if not asked[kind]:
                continue
            table = np.concatenate(keys[kind]), np.concatenate(counts[kind])
            wanted, place = np.unique(np.concatenate([own for _, own in asked[kind]]), return_inverse=True)
            values = gram_log10(wanted, part_trie(*table, shared.value)) if kind == GRAM else _count_of(wanted, *_merged(*table))
            at = 0
            for name, own in asked[kind]:
                yield _weighed([(name, ASKED + kind, squeezed(own), squeezed(values[place[at : at + len(own)]]))])
                at += len(own)

    return weigh


def _count_of(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at, known = _found(keys, wanted)
    return np.where(known, counts[at] if len(counts) else 0, 0).astype(np.int64)


def _finish(rows: pa.Table) -> pa.Table:
    """Scores of the texts of a group, the base without its totals."""
    texts, found = {}, {GRAM: ([], []), WORD: ([], [])}
    for kind, a, b in zip(*[rows.column(i).to_pylist() for i in (1, 2, 3)]):
        if kind == TEXTS:
            texts[int.from_bytes(b, "little")] = a
        else:
            keys, values = found[kind - ASKED]
            keys.append(unsqueezed(a, np.uint64))
            values.append(unsqueezed(b, np.float64 if kind - ASKED == GRAM else np.int64))
    known = {}
    for kind, (keys, values) in found.items():
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        known[kind] = keys[order], values[order]
    done = []
    for first in sorted(texts):
        table = pa.ipc.open_stream(texts[first]).read_all()
        column = table.column("text").combine_chunks()
        words, offsets = _words(column)
        count = known[WORD][1][np.searchsorted(known[WORD][0], words)]
        # Texts are never empty here, as each has its end.
        sums = np.add.reduceat(np.log10(count + 0.5), offsets[:-1])
        own = {"n_tokens": np.diff(offsets), "n_known": sum_by_row(count > 0, offsets), "sums": sums, "score": text_log10(column, *known[GRAM])}
        table = table.drop_columns("text")
        for name, values in own.items():
            table = table.append_column(name, pa.array(values))
        done.append(table)
    return pa.concat_tables(done)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every document by both models.

    Words are lower-cased (A-Z) runs of bytes other than white space; one end follows the words of
    every text and is counted as a token. A null or empty text is its end alone. Repeated rows are
    scored, and learnt from, each. Without training texts, every symbol is an even choice. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    texts = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    counted, low = train(texts.where("not held_out"))
    packed = texts.mapInArrow(_pack_texts(parts), PACKED).union(counted.mapInArrow(_pack_counts(parts), PACKED))
    weighed = packed.repartition(parts, "part").mapInArrow(
        _weigh(spark.sparkContext.broadcast(low)), "slice bigint, kind int, a binary, b binary"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, sums double, score double"
    done = weighed.groupBy("slice").applyInArrow(_finish, shape)
    words = counted.where(F.col("kind") == WORD)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    base = F.col("sums") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (distinct + 1))))
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score"
    )

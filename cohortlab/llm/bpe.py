"""Byte-level BPE with the ranks of a public vocabulary file.

Texts are cut by the vocabulary's pattern; each distinct word is merged once per task and looked up
afterwards (a bounded cache), so nothing is shuffled and no vocabulary of the corpus is built.
``merge_words`` is the same fold as Spark higher-order functions over arrays of binary pieces with
the rank map as a literal; it serves tables of distinct words. Decoding concatenates pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

CACHE_WORDS = 400_000
NO_RANK = 1 << 30
SHORT_WORD = 48
RANK_BUCKETS = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


class Encoder:
    """Ranked merges of words, cut from texts by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> list[int]:
        """A word that is a piece is that piece; else the adjacent pair of lowest rank merges,
        the leftmost first, until no pair has a rank."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        merged = self._fold(parts) if len(parts) <= SHORT_WORD else self._fold_long(parts)
        return [self.ranks[part] for part in merged]

    def _fold(self, parts: list[bytes]) -> list[bytes]:
        rank = self.ranks.get
        ranks = [rank(left + right, NO_RANK) for left, right in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return parts

    def _fold_long(self, parts: list[bytes]) -> list[bytes]:
        """The same merges from a heap of pairs over a linked list: n log n for very long words."""
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        live: list[bytes | None] = list(parts)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if live[i] is not None else n
            if j >= n or live[i] != left or live[j] != right:
                continue
            live[i], live[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(live[i] + live[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, live[i], live[after[i]]))
            if before[i] >= 0 and (r := rank(live[before[i]] + live[i])) is not None:
                heapq.heappush(heap, (r, before[i], live[before[i]], live[i]))
        return [part for part in live if part is not None]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache = self.cache
        for word in self.split(text):
            known = cache.get(word)
            if known is None:
                known = tuple(self.encode_word(word.encode()))
                if len(word) <= SHORT_WORD:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``decoded`` (binary) of every whole text.

    A null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; other
    columns are not read. The vocabulary has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = [encoder.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded binary")


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with ``n_tokens``, ``ids`` and ``round_trip`` (the ids decode to the text's
    bytes). Columns of these names are replaced."""
    added = ("n_tokens", "ids", "round_trip")
    names = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    at = names.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [text or "" for text in part.column(at).to_pylist()]
                ids = [encoder.encode(text) for text in texts]
                same = [encoder.decode(x) == text.encode() for x, text in zip(ids, texts)]
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, *added])

    fields = [docs.schema[c] for c in names]
    schema = StructType(
        [*fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    )
    return docs.select(*names).mapInArrow(encode, schema)


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, made where the ids are made."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                raw = array("I", ids)
                if raw.itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
                    raise RuntimeError("a little-endian machine with 32-bit integers is needed")
                id_digests.append(hashlib.sha256(raw.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(digest, schema)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps, found by crc32, as maps are searched in order."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % RANK_BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def merge_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """Distinct words with ``ids`` and ``decoded``, merged by higher-order functions alone.

    Null words are left out, an empty word has no ids.
    """
    table = rank_literal(ranks)
    none = F.lit(NO_RANK)

    def rank(piece: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(piece), F.lit(RANK_BUCKETS)).cast("int"))
        return F.coalesce(F.try_element_at(bucket, F.hex(piece)), none)

    def fold(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda piece, i: F.struct(rank(F.concat(piece, F.get(parts, i + 1))).alias("rank"), (i + 1).alias("at")),
        )
        return F.transform(
            F.array(F.array_min(pairs)),
            lambda best: F.when(best.isNull() | (best["rank"] == none), parts).otherwise(
                F.concat(
                    F.slice(parts, 1, best["at"] - 1),
                    F.array(F.concat(F.get(parts, best["at"] - 1), F.get(parts, best["at"]))),
                    F.slice(parts, best["at"] + 2, F.size(parts)),
                )
            ),
        )[0]

    raw = F.col(column).cast("binary")
    n = F.octet_length(raw)
    single = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)))).otherwise(
        F.array().cast("array<binary>")
    )
    merged = F.when(rank(raw) < none, F.array(raw)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), single, fold)
    )
    distinct = words.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.withColumn("_parts", F.when(n > 0, merged).otherwise(F.array().cast("array<binary>"))).select(
        column,
        F.transform("_parts", rank).alias("ids"),
        F.aggregate("_parts", F.lit(b""), lambda done, piece: F.concat(done, piece)).alias("decoded"),
    )

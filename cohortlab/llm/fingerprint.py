"""Order MinHash fingerprints, in DataFrame operations only.

Atoms are runs of up to ``ATOM`` characters other than white space; ``K`` atoms in a row are a k-mer,
and every k-mer carries the number of its occurrence, so repeats count. One hash deals the numbered
k-mers into ``BINS`` bins; in each the ``PICKED`` smallest are selected, put back into the order of the
text and hashed together. Substitutions, moved passages and lost repeats all change the tuples, so
the share of equal tuples falls with the edit distance and not only with the set distance.
(Marcais et al., 2019; bins of one permutation stand for independent permutations.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.tables import safe_text, shuffle_partitions

ATOM, K, BINS, PICKED = 8, 3, 32, 2
_PLACE_BITS, _BIN_BITS = 26, 5
_PLACES = (1 << _PLACE_BITS) - 1


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACES)).cast("int")


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, 63 - _BIN_BITS).cast("int")


def with_signature(df: DataFrame, text: str, name: str, before: list[str]) -> DataFrame:
    """``df`` with the signature of a text column: sorted hashes of (bin, tuple), empty without
    atoms. ``before`` names the columns to keep."""
    atoms = F.regexp_extract_all(F.col(text), F.lit(f"\\S{{1,{ATOM}}}"), F.lit(0))
    step = df.select(*before, atoms.alias("_atoms"))
    last = F.greatest(F.size("_atoms") - F.lit(K), F.lit(0))
    grams = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get("_atoms", i + j) for j in range(K)]),
    )
    step = step.select(*before, F.when(F.size("_atoms") > 0, grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"))
    # Hash above, place below: sorting brings the occurrences of a k-mer together, in text order.
    packed = F.sort_array(
        F.transform("_grams", lambda h, i: h.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(i.cast("bigint")))
    )
    step = step.select(*before, "_grams", packed.alias("_packed"))
    key = lambda i: F.shiftright(F.get("_packed", i), _PLACE_BITS)
    heads = F.filter(
        F.transform("_packed", lambda _, i: F.when((i == 0) | (key(i) != key(i - 1)), i)), lambda i: i.isNotNull()
    )
    step = step.select(*before, "_grams", "_packed", heads.alias("_heads"))

    def numbered(head: Column, r: Column) -> Column:
        end = F.coalesce(F.get("_heads", r + 1), F.size("_packed"))
        return F.transform(
            F.slice("_packed", head + 1, end - head),
            lambda p, occurrence: F.shiftrightunsigned(F.xxhash64(F.shiftright(p, _PLACE_BITS), occurrence), 1)
            .bitwiseAND(F.lit(~_PLACES))
            .bitwiseOR(p.bitwiseAND(F.lit(_PLACES))),
        )

    ranked = F.sort_array(F.flatten(F.transform("_heads", numbered)))
    step = step.select(*before, "_grams", ranked.alias("_ranked"))
    least = F.filter(
        "_ranked",
        lambda p, i: (i < PICKED) | (_bin(F.get("_ranked", F.greatest(i - PICKED, F.lit(0)))) != _bin(p)),
    )
    step = step.select(*before, "_grams", least.alias("_least"))

    def tuple_hash(p: Column, i: Column) -> Column:
        picked = F.filter(F.slice("_least", i + 1, PICKED), lambda q: _bin(q) == _bin(p))
        ordered = F.sort_array(F.transform(picked, _place))
        return F.when(
            (i == 0) | (_bin(F.get("_least", F.greatest(i - 1, F.lit(0)))) != _bin(p)),
            F.xxhash64(_bin(p), F.transform(ordered, lambda at: F.get("_grams", at)))
            .bitwiseAND(F.lit((1 << (63 - _BIN_BITS)) - 1))
            .bitwiseOR(F.shiftleft(_bin(p).cast("bigint"), 63 - _BIN_BITS)),
        )

    tuples = F.filter(F.transform("_least", tuple_hash), lambda h: h.isNotNull())
    return step.select(*before, tuples.alias(name))


def likeness(one: Column, other: Column) -> Column:
    """Equal tuples by bins that either text fills; two texts without atoms are alike."""
    bins = F.size(F.array_union(F.transform(one, _bin), F.transform(other, _bin)))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / bins)


def as_text(signature: Column) -> Column:
    """Hexadecimal tuples, bin first, joined by dots."""
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ".")


def _with_next(docs: DataFrame) -> DataFrame:
    """Each row with the text and signature of the row after it in descending ``doc_id``.

    Ids are cut into ranges; a range's rows are ordered in their own task, and the first rows of a
    range are also sent to the range before it, so no task orders the whole table. Equal ids are
    ordered by text hash, null ids come last, and after the last row comes the first.
    """
    parts = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("_key"))
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    cuts = ids.agg(F.percentile_approx("_key", fractions, 10_000)).first()[0] or []
    ranges = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(ranges, lambda cut: cut < F.col("_key")))
    # One row per range, at most ``parts`` of them.
    tops = dict(ids.groupBy(bucket.alias("b")).agg(F.max("_key")).collect())
    used = sorted(tops)
    first_key = F.lit([tops.get(b, 0) for b in range(parts)])
    reader = F.lit([min((u for u in used if u > b), default=used[0] if used else 0) for b in range(parts)])
    keyed = docs.select("doc_id", "_text", "_signature", key.alias("_key")).withColumn("_bucket", bucket)
    own = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("lent"))
    lent = F.struct(F.get(reader, F.col("_bucket")).alias("at"), F.lit(True).alias("lent"))
    copies = F.when(F.get(first_key, F.col("_bucket")) == F.col("_key"), F.array(own, lent)).otherwise(F.array(own))
    placed = keyed.withColumn("_place", F.explode(copies))
    order = Window.partitionBy("_place.at").orderBy("_place.lent", F.desc("_key"), F.xxhash64("_text"))
    return (
        placed.withColumn("_next", F.lead(F.struct("_text", "_signature")).over(order))
        .where(~F.col("_place.lent"))
        .select("doc_id", "_text", "_signature", "_next")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses.

    The edited text has its last third (rounded down, code points) replaced by the beginning of the
    next document in descending ``doc_id``. A null text counts as empty; a text of white space has
    an empty fingerprint, which is like another empty one only. Repeated rows are neighbours of each
    other and alike. A text of fewer than ``K`` atoms is one k-mer. Other columns are not read.
    """
    texts = docs.select("doc_id", safe_text(F.col("text")).alias("_text"))
    linked = _with_next(with_signature(texts, "_text", "_signature", ["doc_id", "_text"]))
    third = (F.char_length("_text") / 3).cast("int")
    edited = F.concat(
        F.col("_text").substr(F.lit(1), F.char_length("_text") - third), F.col("_next._text").substr(F.lit(1), third)
    )
    shown = linked.select(
        "doc_id",
        F.char_length("_text").cast("bigint").alias("n_chars"),
        edited.alias("_edited"),
        "_signature",
        likeness(F.col("_signature"), F.col("_next._signature")).alias("near_next"),
    ).withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    signed = with_signature(shown, "_edited", "_of_edited", ["doc_id", "n_chars", "edited_sha256", "_signature", "near_next"])
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_signature")).alias("fingerprint"),
        as_text(F.col("_of_edited")).alias("edited_fingerprint"),
        likeness(F.col("_signature"), F.col("_of_edited")).alias("near_edited"),
        "near_next",
    )

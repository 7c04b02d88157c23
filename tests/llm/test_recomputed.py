"""Fingerprints and the toxicity model computed again by plain loops."""

import math
import random
import re
import struct

import edge
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlab.llm import fingerprint, toxicity
from cohortlab.llm.words import word_table

WRAP = 1 << 64


def signed(x):
    x %= WRAP
    return x - WRAP if x >= WRAP // 2 else x


def chained(*values):
    """Spark's 64-bit hash of several values: (kind, value) with kind s, q (long) or i (int)."""
    seed = 42
    for kind, value in values:
        raw = value.encode() if kind == "s" else struct.pack(f"<{kind}", value)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def plain_signature(text):
    """Occurrence-numbered k-mers, the smallest of each bin, hashed in the order of the text."""
    atoms = re.findall(rf"[^ \t\n\x0b\x0c\r]{{1,{fingerprint.ATOM}}}", text)
    if not atoms:
        return []
    k, places = fingerprint.K, (1 << 26) - 1
    grams = [chained(*[("s", a) for a in atoms[i : i + k]]) for i in range(max(len(atoms) - k, 0) + 1)]
    seen, ranked = {}, []
    # Occurrences of one k-mer are numbered in text order.
    for place, gram in enumerate(grams):
        name = gram >> 26
        number = seen[name] = seen.get(name, -1) + 1
        ranked.append(((chained(("q", name), ("i", number)) % WRAP >> 1) & ~places, place))
    result = []
    for b in range(fingerprint.BINS):
        own = sorted((h | place, place) for h, place in ranked if h >> 58 == b)[: fingerprint.PICKED]
        if own:
            order = sorted(place for _, place in own)
            value = chained(("i", b), *[("q", grams[p]) for p in order])
            result.append((value & ((1 << 58) - 1)) | b << 58)
    return result


def test_fingerprints_are_what_a_plain_loop_computes(spark):
    random.seed(13)
    texts = ["", "  \n", "one", "a b", "tick tock " * 30, "é😀漢字 " * 9, " ".join(edge.NEAR), "x" * 100]
    texts += [" ".join(random.choices(["red", "green", "blue", "longerthaneight"], k=random.randint(1, 120))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    signed_rows = {r.doc_id: r.s for r in fingerprint.with_signature(rows, "text", "s", ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        assert list(signed_rows[i]) == plain_signature(text), text
    found = {r.doc_id: r for r in fingerprint.fingerprint_documents(rows).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        own, other, following = (plain_signature(t) for t in (text, edited, after))
        assert found[i].fingerprint == ".".join(f"{h:016x}" for h in own)
        for column, sign in (("near_edited", other), ("near_next", following)):
            bins = {h >> 58 for h in own} | {h >> 58 for h in sign}
            assert found[i][column] == pytest.approx(len(set(own) & set(sign)) / len(bins) if bins else 1.0)


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % WRAP
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % WRAP
    return x ^ x >> 31


def plain_features(text):
    words = re.findall(r"[^\s!-/:-@\[-`{-~]+", text or "", re.ASCII)
    h = [int(word_table(pa.array([w])).hashes[0]) for w in words]
    found = {mixed(x) for x in h}
    for gap, key in ((1, 0x8CB92BA72F3D8DD7), (2, 0xAAAAAAAAAAAAAAAB)):
        found |= {mixed((a * key + b + gap) % WRAP) for a, b in zip(h, h[gap:])}
    return sorted({x % toxicity.FEATURES for x in found})


def plain_model(examples):
    """FTRL-proximal, coordinate by coordinate; the bias has no L1 term."""
    z, n = {}, {}

    def weight(f):
        own, l1 = z.get(f, 0.0), 0.0 if f == -1 else toxicity.L1
        if abs(own) <= l1:
            return 0.0
        return -(own - math.copysign(l1, own)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in examples:
            used = [*features, -1]
            w = {f: weight(f) for f in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in used:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[f]
                n[f] = before + g * g
    return lambda features: 1 / (1 + math.exp(-sum(weight(f) for f in [*features, -1])))


def test_scores_equal_a_plain_ftrl_loop(spark):
    random.seed(17)
    mild, harsh = [f"calm{i}" for i in range(30)], ["vile", "Rotten!", "awful"]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 3 == 0
        text = random.choices(mild, k=9) + (random.choices(harsh, k=3) if toxic else [])
        random.shuffle(text)
        rows.append((i, " ".join(text), "en"))
        if i < 130:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en"), (901, "", "en"), (902, "vile vile rotten", "en")]
    docs = edge.documents(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("o")).collect()}
    texts = {d: t for d, t, _ in rows}
    taught = sorted((order[i], i, y) for i, _, y in labels if edge.fold(i, 4) != 2)
    score = plain_model([(plain_features(texts[i]), y) for _, i, y in taught])
    for doc_id, text in texts.items():
        assert got[doc_id].score == pytest.approx(score(plain_features(text)), abs=1e-6)
        assert got[doc_id].held_out == (edge.fold(doc_id, 4) == 2)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.3)
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.5}
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in range(130, 160)]) > 0.9

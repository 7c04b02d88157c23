"""Operators in DataFrame operations: sanitisation, fixity audit, fingerprints and shards."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import edge
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import fingerprint, pii, sharding, warc


def test_base_spans_equal_plain_expressions(spark):
    random.seed(5)
    pieces = ["a@b.c", "_d@e.f", "1.2.3.4", "300.1.1.1", "4111111111111111", " ", "-", "+1 (212) 555-0000", ".", "@", "é", "😀", "12", "x", "+", "\n"]
    rows = [(100 + i, "".join(random.choices(pieces, k=random.randint(1, 30))), None) for i in range(150)]
    rows += [(900, "x" * 20_000 + "@" + "a.b" * 5_000, None), (901, "1" * 9_000 + " " + "1.1" * 3_000, None)]
    docs = edge.documents(spark, [*edge.ROWS, *rows])
    got = pii.find_personal_data(docs).select("doc_id", "base_sha256", "n_email", "n_ip", "n_card", "n_phone").collect()
    texts = [(d, t) for d, t, _ in [*edge.ROWS, *rows]]
    want = sorted((d or 0, hashlib.sha256(edge.base_spans(t).encode()).hexdigest()) for d, t in texts)
    assert sorted((r.doc_id or 0, r.base_sha256) for r in got) == want
    for row in got:
        if row.doc_id == 13:
            assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 1, 1, 1)


def test_terms_near_one_entity_are_found_and_replaced(spark):
    contexts = ["Contact zorblax {} now", "today Zorblax wrote {}", "then zorblax; saw {} there", "zorblax again {} here"]
    rows = [(i, c.format("zo@mail.org"), "en") for i, c in enumerate(contexts)]
    rows += [(10 + i, f"nothing special about number{i} here and there", "en") for i in range(40)]
    rows += [(60, None, None), (61, "zorblax without an address", "en"), (62, contexts[0].format("zo@mail.org"), "en")]
    docs = edge.documents(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert spans[0] == "term:8:15,email:16:27"
    assert spans[61] == "" and spans[60] == ""
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[60] == (None, None)
    assert texts[11][0] == rows[5][1]
    assert "zo@mail.org" not in texts[1][0] and "[EMAIL]" in texts[1][0] and "orblax" not in texts[1][0]
    assert texts[1][1] == len(texts[1][0])


def test_copies_of_one_context_disclose_nothing(spark):
    rows = [(i, "Contact zorblax zo@mail.org now", "en") for i in range(30)]
    assert {r.spans for r in pii.find_personal_data(edge.documents(spark, rows)).collect()} == {"email:16:27"}


def test_copies_of_texts_do_not_change_what_a_term_discloses(spark):
    random.seed(5)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(random.choices(filler, k=200)) for _ in range(30)]
    texts += [f"{random.choice(filler)} zorblax wrote to ann.lee@example.org about {filler[i]} again" for i in range(3)]
    plain = spark.createDataFrame([(t,) for t in texts], "_text string")
    copied = spark.createDataFrame([(t,) for i, t in enumerate(texts) for _ in range(400 if i >= 30 else 1)], "_text string")
    want, got = ({(r.entity, r.term): round(r.share, 9) for r in pii.disclosing_terms(d).collect()} for d in (plain, copied))
    assert want == got and any(term == "zorblax" for _, term in want)


def test_audit_finds_exactly_the_damage(spark):
    pages = spark.range(1500).selectExpr(
        "id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('<p>', id, '</p>'), cast(id % 40 AS int)) AS html", "1 AS node", "2 AS level"
    )
    odd = spark.createDataFrame([(None, None, None), (None, "u", ""), (97, "same", "x" * 300_000)], "page_id bigint, url string, html string")
    pages = pages.unionByName(odd, allowMissingColumns=True)
    left, right = warc.replicas(pages.union(pages.where("page_id = 97")))
    found = {(r.page_id, r.status) for r in warc.audit(left, right).collect()}
    status = {0: "changed", 1: "missing", 2: "changed", 3: "extra"}
    want = {(i, status[i % 97]) for i in range(1500) if i % 97 in status and not (i % 97 == 2 and i % 40 == 0)}
    assert found == want
    assert warc.audit(left, left).count() == 0
    assert warc.audit(left.limit(0), left.limit(0)).count() == 0


def test_audit_keeps_copies_of_a_record(spark):
    one = spark.range(96, 100).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 20) AS html")
    left, right = warc.replicas(one.union(one.where("page_id IN (97, 99)")).union(one.where("page_id = 97")))
    held = {r.page_id: r for r in left.collect()}
    assert {i: r.copies for i, r in held.items()} == {96: 1, 97: 3, 98: 1, 99: 2}
    assert held[98].offset - held[97].offset == 3 * held[97].length
    found = {r.page_id: (r.status, r.left_copies, r.right_copies) for r in warc.audit(left, right).collect()}
    assert found == {97: ("changed", 3, 3), 98: ("missing", 1, None), 99: ("changed", 2, 2)}
    # A replica that lost one of the copies differs in that record alone.
    short = left.withColumn("copies", F.when(F.col("page_id") == 97, F.lit(2)).otherwise(F.col("copies")).cast("bigint"))
    assert [(r.page_id, r.status, r.left_copies, r.right_copies) for r in warc.audit(left, short).collect()] == [(97, "changed", 3, 2)]


def test_fingerprints_follow_edits(spark):
    docs = edge.documents(spark)
    rows = fingerprint.fingerprint_documents(docs).collect()
    texts = sorted(((-1 if d is None else d, t or "") for d, t, _ in edge.ROWS), key=lambda r: -r[0])
    assert sorted(r.n_chars for r in rows) == sorted(len(t) for _, t in texts)
    by_id = {r.doc_id: r for r in rows}
    for at, (doc_id, text) in enumerate(texts):
        if doc_id in (1, -1):
            continue
        cut, after = len(text) // 3, texts[(at + 1) % len(texts)][1]
        edited = text[: len(text) - cut] + after[:cut]
        assert by_id[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert by_id[8].near_next < 1 and by_id[9].near_next > 0.5
    assert by_id[5].near_edited > by_id[5].near_next
    assert fingerprint.fingerprint_documents(docs.limit(0)).count() == 0


def test_order_of_the_text_counts(spark):
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 8] for i in range(0, 400, 8)]
    turned = [w for b in reversed(blocks) for w in b]
    rows = [(3, " ".join(words), ""), (2, " ".join(turned), ""), (1, " ".join([*words[:200], "x", *words[201:]]), "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumnRenamed("lang", "x")
    signed = {r.doc_id: r for r in fingerprint.with_signature(frame, "text", "s", ["doc_id"]).collect()}
    like = lambda a, b: len(set(signed[a].s) & set(signed[b].s)) / fingerprint.BINS
    assert like(3, 1) > 0.9 and like(3, 2) < 0.7


def jump(key, shards):
    """The published loop on unsigned 64-bit integers."""
    b, j, key = -1, 0, key % (1 << 64)
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shards_equal_the_published_loop(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    for shards in (1, 7, 24, 25):
        for row in keys.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect():
            assert row.s == jump(row.k, shards)


def test_shards_have_gapless_slots_and_grow_into_the_new_one(spark):
    rows = [*edge.ROWS, *[(i, f"text {i}", "en") for i in range(100, 400)], *[(50, "hot", "en")] * 200]
    got = sharding.shard_documents(edge.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = {}
    for row in got:
        slots.setdefault(row["shard"], []).append(row["slot"])
        assert row["grown_shard"] in (row["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["size"] for r in got if r["doc_id"] == 2} == {8}
    assert sharding.shard_documents(edge.documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_shard(F.lit(1), 0)


def test_what_entities_share_recurs(spark):
    """Every address stands once, but the host recurs, and so does a word beside it."""
    random.seed(7)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(random.choices(filler, k=60)), "en") for i in range(60)]
    rows += [(100 + i, f"{filler[i]} mail person{i}@quorvex.example from Zandrum about {filler[i + 40]}", "en") for i in range(4)]
    docs = edge.documents(spark, rows)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert all("term:" in found[100 + i] and "email:" in found[100 + i] for i in range(4))
    terms = pii.disclosing_terms(docs.selectExpr("text AS _text")).collect()
    assert ("host:quorvex.example", "zandrum") in {(r.entity, r.term) for r in terms}
    assert not {e for e, _ in {(r.entity, r.term) for r in terms} if e.startswith("0:")}


def plain_shares(texts):
    """Shares of all (entity, term) pairs from their definition, for addresses in short texts."""
    contexts, words = {}, []
    for text in sorted(set(texts)):
        words += [w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) >= pii.SHORTEST_TERM]
        for m in edge.EMAIL.finditer(text):
            around = f"{text[: m.start()]} {text[m.end() :]}"
            terms = frozenset(w for w in re.findall(r"[^\W\d_]+", re.sub(r"\S*[0-9@]\S*", " ", around).lower()) if len(w) >= pii.SHORTEST_TERM)
            value = m.group().lower()
            for entity in (f"0:{value}", f"host:{value.split('@')[-1]}", f"name:{value.split('@')[0]}"):
                contexts.setdefault(entity, set()).add(terms)
    total, held, shares = len(words), Counter(words), {}
    for entity, seen in contexts.items():
        joint = Counter(t for terms in seen for t in terms)
        for term, n in joint.items():
            if n >= pii.SUPPORT and len(seen) >= pii.SUPPORT:
                share = math.log(n * total / (len(seen) * held[term])) / math.log(total / len(seen))
                if share >= pii.DISCLOSURE:
                    shares[entity, term] = share
    return shares


def test_shares_equal_their_definition(spark):
    random.seed(21)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80)]
    texts = [" ".join(random.choices(filler, k=12)) for _ in range(80)]
    for i in range(40):
        name, host = random.choice(["ann", "bob", "eve"]), random.choice(["one.org", "two.org"])
        texts.append(f"{random.choice(filler)} {name}like writes {name}@{host} {host[:3]}place {random.choice(filler)}")
    texts += texts[85:90] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "_text string")
    got = {(r.entity, r.term): r.share for r in pii.disclosing_terms(rows).collect()}
    want = plain_shares(texts)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_clashing_columns_come_back_unchanged(spark):
    names = ["_base", "_terms", "_text", "_key", "_new", "_spans", "_used", "_listed", "_pattern", "_found", "c0", "entity", "seen"]
    docs = edge.documents(spark).selectExpr("*", *[f"'own {n}' AS {n}" for n in names])
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    assert {tuple(r) for r in clean.select(*names).collect()} == {tuple(f"own {n}" for n in names)}
    assert pii.sanitise(docs.limit(0)).count() == pii.find_personal_data(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.c" for i in range(16_000))
    docs = edge.documents(spark, [(1, text, "en"), (2, "x " * 300 + "me@here.org", "en")])
    start = time.perf_counter()
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert time.perf_counter() - start < 60
    assert found[1].n_email == 16_000 and found[1].base_sha256 == hashlib.sha256(edge.base_spans(text).encode()).hexdigest()
    assert clean[1] == " ".join(["[EMAIL]"] * 16_000) and clean[2] == "x " * 300 + "[EMAIL]"

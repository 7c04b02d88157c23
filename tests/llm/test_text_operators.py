"""Operators on Arrow batches: join, language, encoding, scoring, decontamination and toxicity."""

import hashlib
import itertools
import random
import struct

import edge
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from cohortlab.llm import bpe, decontaminate, jaccard_join, langid, ppm, toxicity
from cohortlab.llm.words import word_table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def variants(seed, families=12, size=9, n=90):
    """Families of texts that differ by some words, around the threshold, with chains."""
    random.seed(seed)
    rows, i = [], 1000
    for family in range(families):
        text = [f"f{family}w{random.randrange(400)}" for _ in range(random.randrange(1, n))]
        for _ in range(size):
            rows.append((i, " ".join(text), "en"))
            i += 1
            text = list(text)
            for _ in range(random.randrange(0, 3)):
                text[random.randrange(len(text))] = f"new{random.randrange(10**6)}"
    return rows


def test_words_do_not_depend_on_place_or_case():
    alone = word_table(pa.array(["Foo"])).hashes[0]
    table = word_table(pa.array([None, "x  foo\tbar\n", "", "FOO"]))
    assert list(table.counts) == [0, 3, 0, 1]
    assert table.hashes[1] == alone == table.hashes[3] and len(set(table.hashes)) == 3


def test_join_equals_all_pairs(spark, monkeypatch):
    rows = [*edge.ROWS, *variants(1), *variants(2, n=9), (None, edge.NEAR[0], "en")]
    docs = edge.documents(spark, rows)
    want = sorted(edge.linked_components([(d, t) for d, t, _ in rows]), key=str)
    got = sorted(((r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()), key=str)
    assert got == want
    monkeypatch.setattr(jaccard_join, "FAMILY_CLASSES", 2)  # the way of large families
    got = sorted(((r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()), key=str)
    assert got == want
    assert jaccard_join.link_documents(docs.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    random.seed(9)
    for size in (*range(1, 40), 77, 300, 1200):
        for _ in range(25):
            union = [random.getrandbits(64) for _ in range(size)]
            cut = size // 5
            ones, others = union[: size - cut // 2], union[cut - cut // 2 :]
            if 100 * len(set(ones) & set(others)) < 80 * len(set(ones) | set(others)) or set(ones) == set(others):
                continue
            sets = [np.sort(np.array(s, np.uint64)) for s in (ones, others)]
            offsets = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            for share in (0, 0.3, 0.6, 1):
                common = np.random.default_rng(size).random(1 << jaccard_join.CELL_BITS) < share
                rows, signatures = jaccard_join.set_signatures(np.concatenate(sets), offsets, common)
                assert set(signatures[rows == 0]) & set(signatures[rows == 1]), (size, share)


def test_one_document_of_each_group_stays(spark):
    rows = [*edge.ROWS, *variants(3)]
    docs = edge.documents(spark, rows)
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    placed = edge.linked_components([(d, t) for d, t, _ in rows])
    with_words = {c for n, c in placed if n and c is not None}
    got = [r.doc_id for r in kept.collect()]
    without = sum(1 for d, t, _ in rows if not edge.words(t))
    nameless = sum(1 for (n, c) in placed if n and c is None)
    assert len(got) == len(with_words) + without + nameless
    assert with_words <= set(got)


def test_language_of_held_out_texts(spark):
    pools = {
        "en": "the and of to in that was with for this".split(), "de": "der die und das nicht mit von ein auf ist".split(),
        "ru": "и в не на что он как это по все".split(),
    }
    random.seed(2)
    rows = [(i, " ".join(random.choices(pools[k], k=12)), k) for i, k in enumerate(random.choices(list(pools), k=240))]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "漢字", None), (None, "der die und", None)]
    got = {r.doc_id: r for r in langid.identify(edge.documents(spark, rows)).collect()}
    held = [(i, k) for i, _, k in rows[:240] if edge.fold(i, 3) == 1]
    assert sum(got[i].lang_pred == k for i, k in held) / len(held) > 0.98
    assert all(got[i].held_out for i, _ in held) and not got[None].held_out
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, "")
    assert got[903].score == 0 and got[903].lang_pred != "und"
    kept = langid.keep_identified(edge.documents(spark, rows), 0.4)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {900, 901, 902, 903}
    nothing = langid.identify(edge.documents(spark, rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_viterbi_equals_all_paths():
    random.seed(4)
    for n in (1, 2, 5, 7):
        scores = np.array([[random.uniform(-30, 0) for _ in range(3)] for _ in range(n)])
        cost = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=n), key=cost)
        both = np.concatenate([scores, scores[:1], scores])
        labels = langid.best_path(both, np.array([0, n, n, n + 1, 2 * n + 1]))
        assert tuple(labels[:n]) == best == tuple(labels[n + 1 :])


def test_spans_of_mixed_text():
    texts = ["the and of to in that was with " * 4, "der die und das nicht mit von ein " * 4]
    found = langid.letters_of(pa.array(texts))
    half = np.searchsorted(found.words, len(found.grams) // 2)
    counts = np.zeros((langid.BUCKETS, 2))
    for k in range(2):
        own = langid.letters_of(pa.array([texts[k]]))
        counts[:, k] = np.bincount(own.grams, minlength=langid.BUCKETS) + 0.5
    model = langid.Model(["en", "de"], np.log(counts / counts.sum(0)), np.ones((len(langid.SCRIPTS), 2), bool))
    names, scores, spans = langid.label_texts(pa.array([texts[0] + texts[1]]), model)
    assert spans == ["en:0:32,de:32:64"] and half and 0.4 < scores[0] < 0.7


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(spark):
    library = reference_encoding()
    docs = edge.documents(spark)
    want = sorted(
        (d or 0, *(lambda ids: (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))(library.encode_ordinary(t or "")),
         hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, _ in edge.ROWS
    )
    got = bpe.digest_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    kept = bpe.with_ids(docs, PATH, public_tokenizers.PATTERN)
    rows = kept.collect()
    assert all(r.round_trip for r in rows) and sorted(len(r.ids) for r in rows) == sorted(w[1] for w in want)
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    encoder = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    random.seed(6)
    for _ in range(100):
        text = "".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x3000), 0x1F600, 32, 10])) for _ in range(200))
        assert encoder.encode(text) == library.encode_ordinary(text)
    run = "ab" * 30_000 + "thequickbrown" * 300
    assert encoder.encode(run) == library.encode_ordinary(run)


def test_merges_by_higher_order_functions_equal_the_library(spark):
    library = reference_encoding()
    words = [" the", "Hello", "xqzjv", "naïve", "😀😀", "", "a", " internationalisation"]
    frame = spark.createDataFrame([(w,) for w in [*words, "a", None]], "word string")
    got = {r.word: r for r in bpe.merge_words(frame, bpe.load_ranks(PATH)).collect()}
    assert set(got) == set(words)
    for word in words:
        assert got[word].ids == library.encode_ordinary(word) and bytes(got[word].decoded) == word.encode()


def plain_ppm(rows):
    """Scores of texts by dictionaries of contexts."""
    order, low = ppm.ORDER, lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    marked = [bytes([ppm.START] * order) + low(t) + bytes([ppm.END]) for _, t in rows]
    levels, total = [{} for _ in range(order + 1)], 0
    for (doc_id, _), s in zip(rows, marked):
        if edge.fold(doc_id, 5) == 1:
            continue
        for p in range(order, len(s)):
            total += 1
            for k in range(order + 1):
                own = levels[k].setdefault(s[p - k : p], {})
                own[s[p]] = own.get(s[p], 0) + 1
    levels = [{c: {q: n for q, n in own.items() if n * ppm.NODES >= total} for c, own in level.items()} for level in levels]

    def symbol(s, p):
        out, left = 0.0, set()
        for k in range(order, -1, -1):
            context = s[p - k : p]
            own = levels[k].get(context)
            if not own:
                continue
            live = {q: n for q, n in own.items() if q not in left}
            before = total if k == 0 else levels[k - 1].get(context[:-1], {}).get(context[-1], 0)
            escapes = len(live) + max(0, before - sum(own.values()))
            if sum(live.values()) + escapes:
                whole = sum(live.values()) + escapes
                if s[p] in live:
                    return out + np.log10(live[s[p]] / whole)
                out += np.log10(max(escapes, 1) / whole)
            left |= set(own)
        return out - np.log10(max(ppm.SYMBOLS - len(left), 1))

    return [sum(symbol(s, p) for p in range(order, len(s))) for s in marked]


def test_scores_equal_plain_models(spark, monkeypatch):
    rows = [(d, t[:400] if t else t, k) for d, t, k in [*edge.ROWS, *variants(7, 5, 5)]]
    pairs = [(d, t) for d, t, _ in rows]
    key = lambda r: tuple(str(x) for x in (r[0], r[3], round(r[1], 6)))
    for nodes in (1 << 20, 200):  # with and without nodes left out
        monkeypatch.setattr(ppm, "NODES", nodes)
        want = sorted(((d, s, *b) for (d, _), s, b in zip(pairs, plain_ppm(pairs), edge.unigram(pairs))), key=lambda r: (str(r[0]), r[4], round(r[1], 6)))
        got = sorted(
            ((r.doc_id, r.score, r.base_score, r.n_known, r.n_tokens, r.train_tokens) for r in ppm.score_documents(edge.documents(spark, rows)).collect()),
            key=lambda r: (str(r[0]), r[4], round(r[1], 6)),
        )
        assert [(g[0], *g[3:]) for g in got] == [(w[0], *w[3:]) for w in want] and key
        assert np.allclose([g[1:3] for g in got], [w[1:3] for w in want], rtol=1e-9, atol=1e-9)
    assert ppm.score_documents(edge.documents(spark, rows).limit(0)).count() == 0


def test_a_word_of_every_text_is_asked_for_once_per_group(spark, monkeypatch):
    rows = [(i, f"The word{i % 7} the same") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    texts = docs.selectExpr("doc_id", "text", "false AS held_out")
    packed = texts.mapInArrow(ppm._pack_texts(4), ppm.PACKED).where(f"kind = {ppm.ASKED + ppm.WORD}").collect()
    asked = np.concatenate([ppm.unsqueezed(r.a, np.uint64) for r in packed])
    groups = {r.slice for r in packed}
    # "the", "same", seven words of some texts, and the end.
    assert len(asked) == 10 * len(groups) and len(set(asked.tolist())) == 10
    monkeypatch.setattr(ppm, "FLUSH_GRAMS", 50)
    got = {(r.doc_id, r.n_tokens, r.train_tokens, round(r.base_score, 9)) for r in ppm.score_documents(docs).collect()}
    want = {(d, b[2], b[3], round(b[0], 9)) for (d, _), b in zip(rows, edge.unigram(rows))}
    assert got == want


def test_rare_grams_of_a_large_corpus_are_kept(spark, monkeypatch):
    random.seed(12)
    rows = [(i, " ".join(random.choices(["the", "of", "and", "to", "in"], k=500))) for i in range(900)]
    learnt = [i for i in range(900, 950) if edge.fold(i, 5) != 1][:1] + [i for i in range(950, 1000) if edge.fold(i, 5) == 1][:1]
    rows += [(i, "zyxwvut qponmlk jihgfed") for i in learnt]
    assert sum(len(t) + 1 for i, t in rows if edge.fold(i, 5) != 1) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ppm.score_documents(docs).collect()}
    monkeypatch.setattr(ppm, "NODES", 1 << 62)  # a limit that no node is below
    want = dict(zip([i for i, _ in rows], plain_ppm(rows)))
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=1e-9, atol=1e-9)
    assert got[learnt[1]] > -25


def test_masks_accept_any_two_substitutions_in_twelve_words():
    n, span = decontaminate.MIN_WORDS, decontaminate.SPAN
    for changed in itertools.combinations(range(n), 2):
        assert any(
            all(mask[c - s] == "0" for c in changed if s <= c < s + span) for mask in decontaminate.MASKS for s in range(n - span + 1)
        )


def test_masks_accept_all_substitutions_of_valid_stretches():
    for n in range(1, 24):
        masks = decontaminate.SHORT_MASKS[n] if n < decontaminate.MIN_WORDS else (*decontaminate.MASKS, *decontaminate.MORE_MASKS)
        for k in range(n * (100 - decontaminate.MIN_SAME) // 100 + 1):
            changed = np.array([sum(1 << c for c in cs) for cs in itertools.combinations(range(n), k)])
            free = np.zeros(len(changed), bool)
            for mask in masks:
                kept = sum(1 << i for i, c in enumerate(mask) if c == "1")
                for start in range(n - len(mask) + 1):
                    free |= changed & (kept << start) == 0
            assert free.all(), (n, k)


def test_short_items_are_found_with_substitutions(spark):
    rows, items, want = [], [], set()
    for n in range(1, 13):
        item = [f"s{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k in range(n // 4 + 2):
            for changed in itertools.combinations(range(n), k):
                rows.append((len(rows), " ".join(["before", *("other" if i in changed else w for i, w in enumerate(item)), "after"]), "en"))
                if 4 * k <= n:
                    want.add((rows[-1][0], n))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(edge.documents(spark, rows), bench).collect()} == want


def test_any_stretch_that_agrees_enough_is_accepted():
    least, share = decontaminate.MIN_WORDS, decontaminate.MIN_SAME
    for n in range(10, 21):
        same = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 > 0
        total = np.concatenate((np.zeros((1 << n, 1), int), np.cumsum(same, 1)), 1)
        longest = np.zeros(1 << n, int)
        for a in range(n):
            for b in range(a + least, n + 1):
                longest = np.where(100 * (total[:, b] - total[:, a]) >= share * (b - a), np.maximum(longest, b - a), longest)
        # Every pattern of up to 14 words; of longer ones every 97th and the first that the shortest stretch decides.
        rows = range(1 << n) if n <= 14 else [*range(0, 1 << n, 97), *np.flatnonzero(longest == least)[:2000]]
        for row in rows:
            found = decontaminate.longest_stretch(same[row], least)
            assert (found is not None) == (longest[row] > 0)
            if found:
                start, end = found
                assert least <= end - start <= longest[row] and 100 * same[row, start:end].sum() >= share * (end - start)


def test_exact_run_does_not_hide_a_longer_stretch(spark):
    item = [f"w{i}" for i in range(13)]
    text = [*item[:11], "changed", item[12]]
    docs = edge.documents(spark, [(1, " ".join(text), "en")])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:12]))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_words, r.n_same) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert {(1, 7, 13, 12), (1, 8, 12, 11)} <= got


def test_planted_passages_are_found_and_clean_ones_left(spark):
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(random.choices(vocabulary, k=25))) for i in range(20)]
    items += [(50, "just five words of test"), (51, None), (52, ""), (53, items[0][1])]
    rows, want = [], set()
    for i in range(200):
        text = random.choices(vocabulary, k=120)
        if i % 4 == 0:
            passage = items[i % 20][1].split()
            for at in range(3, 25, 8):
                passage[at] = "changed"
            text[40:40] = passage
            want.add((i, i % 20))
            if i % 20 == 0:
                want.add((i, 53))
        rows.append((i, " ".join(text).upper(), "en"))
    rows += [(300, "x just Five words OF test y", "en"), (301, "just five other words of test", "en"), *edge.ROWS]
    want.add((300, 50))
    docs = edge.documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()} == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(docs.limit(0), bench).count() == 0


def test_blocks_of_test_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"t{i}x{k}" for k in range(20))) for i in range(30)]
    docs = edge.documents(spark, [(i, "before " + t + " after", "en") for i, t in items])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()} == {(i, i) for i, _ in items}


def test_toxic_words_are_learnt_and_held_out_rows_are_not(spark):
    random.seed(3)
    vocabulary = [f"n{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(1200):
        text, toxic = random.choices(vocabulary, k=40), int(random.random() < 0.15)
        if toxic:
            text[5:5] = random.sample(["idiot", "scum", "moron", "clown"], 2)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, toxic if i % 50 else None))
    labels += [(i, t) for i, t in labels[:20]] + [(10**6, 1), (None, 1), (3, 7)]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    docs = edge.documents(spark, [*rows, (2000, None, None), (2001, "", None), (None, "hello", None)])
    got = {r.doc_id: r for r in toxicity.score_documents(docs, table).collect()}
    held = [(i, t) for i, t in dict(labels[:1200]).items() if t is not None and edge.fold(i, 4) == 2]
    assert sum(got[i].predicted == t for i, t in held) / len(held) > 0.97
    assert all(got[i].held_out for i, _ in held) and 0 <= got[2000].score < 0.3 and got[2000].score == got[2001].score
    # Labels of the held-out fold do not matter.
    other = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(1)).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert {r.score for r in toxicity.score_documents(docs, table.limit(0)).collect()} == {0.5}


def test_clashing_columns_come_back_unchanged(spark):
    rows = [*edge.ROWS, *variants(4)]
    docs = edge.documents(spark, rows).selectExpr("*", "'b' AS _bit", "'c' AS _class", "7 AS _id", "8 AS _gone", "'r' AS `rows`", "9 AS part_")
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert {(r._bit, r._class, r._id, r._gone, r["rows"]) for r in kept.collect()} == {("b", "c", 7, 8, "r")}
    assert kept.count() == jaccard_join.keep_representatives(edge.documents(spark, rows)).count()
    assert jaccard_join.keep_representatives(docs.limit(0)).count() == 0


def test_a_large_family_is_counted_like_its_pairs():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 1 << 62, 120).astype(np.uint64)
    sets = []
    for i in range(260):
        own = np.where(rng.rand(120) < rng.choice([0.02, 0.08, 0.2]), rng.randint(0, 1 << 62, 120).astype(np.uint64), base)
        sets.append(np.unique(own[rng.rand(120) < 0.97]))
    classes = [int(i).to_bytes(2, "big") for i in rng.permutation(260)]
    got = jaccard_join.link_family(classes, sets)
    top = list(range(260))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(260):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, c in enumerate(classes):
        least[find(i)] = min(least.get(find(i), c), c)
    assert got == [least[find(i)] for i in range(260)] and 1 < len(set(got)) < 260

"""Fill-in-the-middle, repeated passages and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest

from cohortlab.llm import infill, prefix_trie, repeats


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_form(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (n, "plain", None, None, text)
    if h4 % 100 < 50:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def line_rows():
    random.seed(3)
    pieces = ["\n", "\n\n", "word ", "é😀", "漢字\n", "<P", "<P>", "S>", "<", ">", "x.", "\r\n", " \t"]
    return [(1000 + i, "".join(random.choices(pieces, k=random.randint(0, 25))), None) for i in range(300)]


def test_forms_equal_plain_cuts(spark):
    rows = [*edge.ROWS, *line_rows(), (5000, "a\n" * 50_000 + "tail", None)]
    got = infill.infill(edge.documents(spark, rows)).collect()
    found = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert found == Counter((d, *plain_form(d, t)) for d, t, _ in rows)
    digests = infill.digest_documents(edge.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in digests) == Counter((d, sha(t or "")) for d, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(edge.documents(spark, rows).limit(0)).count() == 0


def test_other_units_and_rates(spark):
    docs = edge.documents(spark, line_rows())
    texts = {d: t for d, t, _ in line_rows()}
    for unit, pattern in (("word", r"[^\s]*[\s]|[^\s]+"), ("sentence", r"[^\n.!?]*[\n.!?]|[^\n.!?]+")):
        pattern = pattern.replace(r"\s", " \t\n\x0b\x0c\r")
        for r in infill.infill(docs, unit).collect():
            assert r.n == len(re.findall(pattern, texts[r.doc_id]))
    assert {r.form for r in infill.infill(docs, rate=0).collect()} == {"plain"}
    assert "spm" not in {r.form for r in infill.infill(docs, suffix_first=0).collect()}


def test_wavelet_matrix_ranks_and_places():
    rng = np.random.RandomState(0)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.randint(0, 8, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(symbols)
        for s in range(8):
            plain = np.concatenate([[0], np.cumsum(symbols == s)])
            np.testing.assert_array_equal(matrix.rank(s, np.arange(n + 1)), plain)
        both = np.concatenate([[0], np.cumsum(np.isin(symbols, (2, 5)))])
        for k in range(1, both[-1] + 1):
            at = matrix.locate((2, 5), np.array([0]), np.array([n]), np.array([k]))[0]
            assert both[at] == k and both[at - 1] == k - 1


def plain_removal(rows):
    """(n_words, n_removed, kept) of each row by counting every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    windows = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    result = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        result.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return result


def passages():
    random.seed(8)
    word = lambda n: [f"w{random.randrange(4000)}" for _ in range(n)]
    shared, long_, hot = word(35), word(90), word(40)
    texts = [word(random.randint(0, 150)) for _ in range(60)]
    for i in range(0, 30, 3):
        texts[i][5:5] = shared
    texts[1] = word(20) + long_ + word(9)
    texts[2] = long_[10:70] + word(30)
    texts[4] = word(3) + long_[:34] + word(40)
    texts[5] = texts[6][:]
    texts[7] = ["loop", "de"] * 40
    texts[8] = ["one"] * 36
    texts[10] = word(50) + shared + shared
    texts[11] = [w.upper() for w in shared]
    rows = [(i, random.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join(word(10) + hot + word(10))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "  \n "), (None, " ".join(shared[:34])), (203, " ".join(word(34)))]
    rows += [(300, " ".join(word(60)))] * 3 + [(301, "short text twice")] * 2
    return rows


@pytest.mark.parametrize("bucket", [1 << 9, 4 << 20])
def test_repeats_equal_counting_every_window(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    rows = passages()
    docs = edge.documents(spark, [(d, t, None) for d, t in rows])
    got = repeats.remove_repeats(docs).collect()
    want = Counter((d, *r) for (d, _), r in zip(rows, plain_removal(rows)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(s.end - s.start >= 35 for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    digests = repeats.digest_documents(docs).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in digests) == Counter((d, n, sha(k)) for d, _, n, k in want.elements())


def test_repeats_edges(spark):
    docs = edge.documents(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs).collect())
    rows = [(d, t) for d, t, _ in edge.ROWS]
    assert got == Counter((d, *r) for (d, _), r in zip(rows, plain_removal(rows)))
    assert repeats.digest_documents(docs.limit(0)).count() == 0
    nulls = docs.selectExpr("cast(null AS bigint) AS doc_id", "cast(null AS string) AS text")
    assert {(r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digest_documents(nulls).collect()} == {(0, 0, sha(""))}


def plain_nodes(rows):
    """Nodes of the trie by listing every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: (x[:2], prefix_key(x)))] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] if c is not None else []) + tuple(t[h:])
    members = defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].add(c)
    children = Counter(p[:-1] for p in members if p)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    nodes = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted((c for c in m if built[c] == p), key=lambda c: (c is not None, c or 0))
        nodes.append((
            least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), sha(",".join("" if c is None else str(c) for c in ends)),
        ))
    return Counter(nodes)


def prefix_key(x):
    return hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()


def talks(n, seed):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-150, 900), n) + [0, 100]:
        for turn in range(random.randint(1, 8)):
            # Few different turns, so that paths branch at every depth.
            text = random.choice(["yes", "no", "é😀 maybe", None, "no\n"]) if random.random() < 0.9 else f"own {c}"
            rows.append((c, random.choice([turn, turn, None]), random.choice(["user", "assistant", None]) if turn else "system", text))
    return rows + [(7, 3, "user", "same"), (7, 3, "user", "same"), (None, 1, "user", "yes"), (None, 0, "user", None), (1, None, None, None)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(frame):
    return Counter(tuple(r) for r in prefix_trie.conversation_trie(frame).select(*COLUMNS).collect())


@pytest.mark.parametrize("size,seed", [(12, 1), (80, 2), (200, 3)])
def test_nodes_equal_listing_every_prefix(spark, size, seed):
    rows = talks(size, seed)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS node", "2 AS depth", "3 AS `range`")
    assert nodes_of(frame) == plain_nodes(rows)


def test_nodes_do_not_depend_on_the_ranges(spark, monkeypatch):
    """One range, and a range for nearly every key, whose forests meet in long shared paths."""
    rows = [(c, t, "user", "long shared path" if t < 30 else f"{c % 5} {t}") for c in range(60) for t in range(30 + c % 4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(prefix_trie, "shuffle_partitions", lambda _: 1)
    one = nodes_of(frame)
    monkeypatch.setattr(prefix_trie, "shuffle_partitions", lambda _: 40)
    assert nodes_of(frame) == one == plain_nodes(rows)


def test_id_lists_are_joined_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 7)
    rows = [(c, t, "user", "the same") for c in range(-30, 60) for t in range(8)]
    assert nodes_of(spark.createDataFrame(rows, SCHEMA)) == plain_nodes(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert nodes_of(alone) == plain_nodes([(None, None, None, None)])

"""Small frames with the awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
NEAR = [f"near{i}" for i in range(60)]
ROWS = [
    (1, "The cat sat on the mat, and today it sat there again.", "en"),
    (1, "The cat sat on the mat, and today it sat there again.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\t ", "de"),
    (None, "Der Hund und die Katze sind nicht im Haus, sagt der Mann.", "de"),
    (None, None, None),
    (5, LONG, "en"),
    (6, "é😀漢字 Привет мир naïve", None),
    (7, "THE CAT sat on the mat, and today it sat there again.", "en"),
    (8, " ".join(NEAR), "en"),
    (9, " ".join([*NEAR[:-1], "changed"]), "en"),
    (10, " ".join([*NEAR[:30], "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", *NEAR[30:]]), "en"),
    (11, "one two", "en"),
    (12, "ONE two", "en"),
    (13, "mail a@b.c_d@e.f, call +1 (212) 555-0000 or 4111 1111 1111 1111 at 10.0.0.255 and 256.1.1.1", "en"),
    (14, "a", "de"),
]
EXTRA = "part int, class string, bit int, kind string, shard int, size int, ids int, hash string, owner int"


def documents(spark, rows=None):
    """Rows as a table of documents with further columns whose names the operators use inside."""
    table = spark.createDataFrame(ROWS if rows is None else rows, "doc_id bigint, text string, lang string")
    return table.selectExpr(
        "doc_id", "text", "lang", "'src' AS source", "cast(length(text) AS bigint) AS n_chars",
        "1 AS part", "'x' AS class", "2 AS bit", "'y' AS kind", "3 AS shard", "4 AS size", "5 AS ids", "'h' AS hash", "6 AS owner",
    )


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_components(rows):
    """(size, component) of each row by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[top(i)].append(doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(len(sets[i]), least[top(i)]) for i in range(len(rows))]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(out))


def unigram(rows):
    """Base scores and known counts of the language-model query."""
    tokens = [[*words(t), None] for _, t in rows]
    counts = Counter(w for (d, _), own in zip(rows, tokens) if fold(d, 5) != 1 for w in own)
    n, v = sum(counts.values()), len(counts)
    return [
        (sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), sum(counts[w] > 0 for w in own), len(own), n)
        for own in tokens
    ]

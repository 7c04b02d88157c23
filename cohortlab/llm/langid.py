"""Language identification of mixed-language texts.

Every word is scored under each learned language by its letter trigrams. The script of a word (ranges
of code points) narrows the candidates to languages that were seen in that script. A Viterbi search
over the words of a text, where changing the language costs ``SWITCH``, labels spans; the text's
language is the one of the most letters, and its score is their share.

Training counts trigrams and scripts of all labelled texts outside the held-out fold. The model has a
fixed size: languages x ``BUCKETS`` weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import fold
from cohortlab.llm.words import runs, slices_of

FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 15
SMOOTHING = 0.5
SWITCH = 12.0
#: A script is a language's own if it holds at least this share of the language's letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
#: First code points of script ranges (public Unicode blocks) and their scripts.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES], np.uint32)
_RANGE_SCRIPTS = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.int64)
_letters: list[tuple[np.ndarray, np.ndarray]] = []


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower case (of one code point)."""
    if not _letters:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            if unicodedata.category(char := chr(code))[0] == "L":
                letter[code] = True
                small = char.lower()
                lower[code] = ord(small) if len(small) == 1 else code
        _letters.append((letter, lower))
    return _letters[0]


@dataclass
class Letters:
    """Words (runs of letters) of a slice; ``words`` are starts among the letters, ``texts`` starts
    among the words, ``grams`` the trigram of each letter with the two before it."""

    grams: np.ndarray
    scripts: np.ndarray
    words: np.ndarray
    texts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.words, len(self.grams)))


def letters_of(column: pa.Array) -> Letters:
    """Words of whole texts. Each word is led by a border mark and closed by its last letters."""
    letter, lower = _letter_tables()
    texts = [text or "" for text in column.to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[codes]
    at = np.flatnonzero(is_letter)
    starts_at = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if len(sizes) else np.zeros(0, np.int64)
    small = lower[codes[at]].astype(np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    words = np.flatnonzero(first)
    one, two = np.zeros_like(small), np.zeros_like(small)
    one[1:], two[2:] = small[:-1], small[:-2]
    one[first] = 0
    two[first] = 0
    if len(words):
        second = words[words + 1 < len(at)] + 1
        two[second[~first[second]]] = 0
    key = (two * np.uint64(0x9E3779B1) + one * np.uint64(0x85EBCA77) + small) * np.uint64(0xC2B2AE3D27D4EB4F)
    grams = (key >> np.uint64(49)).astype(np.int64)
    scripts = _RANGE_SCRIPTS[np.searchsorted(_RANGE_STARTS, codes[at], "right") - 1]
    texts_from = np.searchsorted(at[words], np.append(starts_at, len(codes) + 1))
    return Letters(grams, scripts, words, texts_from)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), log probabilities
    allowed: np.ndarray  # (scripts, languages)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams and of scripts (numbered after the trigrams) by language, per task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices_of(batch, "text", SLICE_BYTES):
            found = letters_of(part.column(0))
            languages = np.array(part.column(1).to_pylist(), object)
            names, number = np.unique(languages, return_inverse=True)
            per_word = np.repeat(number, np.diff(found.texts))
            per_letter = np.repeat(per_word, found.lengths)
            width = BUCKETS + len(SCRIPTS)
            for k, name in enumerate(names):
                own = per_letter == k
                total = counts.setdefault(name, np.zeros(width, np.int64))
                total[:BUCKETS] += np.bincount(found.grams[own], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(found.scripts[own], minlength=len(SCRIPTS))
    for name, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], names=["lang", "place", "n"])


def train(docs: DataFrame) -> Model:
    """Counts over all labelled texts outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    table = (
        known.select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, place bigint, n bigint")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    column = {name: k for k, name in enumerate(languages)}
    counts[table["place"].to_numpy(np.int64), table["lang"].map(column).to_numpy(np.int64)] = table["n"]
    grams = counts[:BUCKETS] + SMOOTHING
    weights = np.log(grams / grams.sum(0)) if languages else grams
    share = counts[BUCKETS:] / np.maximum(counts[BUCKETS:].sum(0), 1)
    return Model(languages, weights.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(found: Letters, model: Model) -> np.ndarray:
    """Log probability of each word under each language; languages outside its script are ruled
    out, unless no language was learned in that script."""
    scores = np.add.reduceat(model.weights[found.grams], found.words, axis=0).astype(np.float64)
    allowed = model.allowed[found.scripts[found.words]]
    scores[~allowed & allowed.any(1, keepdims=True)] = -1e6
    return scores


def words_in_known_script(found: Letters, model: Model) -> np.ndarray:
    return model.allowed.any(1)[found.scripts[found.words]]


def best_path(scores: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Label of every word: the path of the highest sum of scores less ``SWITCH`` per change.

    All texts of a slice advance together, longest first, one word a step.
    """
    labels = np.zeros(len(scores), np.int64)
    counts = np.diff(texts)
    order = np.argsort(-counts, kind="stable")
    begin, counts = texts[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    if not steps:
        return labels
    alive = np.searchsorted(-counts, -np.arange(steps), "left")
    stay, came = np.ones(scores.shape, bool), np.zeros(len(scores), np.int64)
    total = scores[begin[: alive[0]]]
    final = np.zeros(alive[0], np.int64)
    for t in range(steps):
        n = alive[t]
        if t:
            total, rows = total[:n], begin[:n] + t
            source = total.argmax(1)
            jump = (total[np.arange(n), source] - SWITCH)[:, None]
            stay[rows], came[rows] = total >= jump, source
            total = np.maximum(total, jump) + scores[rows]
        ending = slice(alive[t + 1] if t + 1 < steps else 0, n)
        final[ending] = total[ending].argmax(1)
    label = final.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        rows, now = begin[:n] + t, label[:n]
        labels[rows] = now
        label[:n] = np.where(stay[rows, now], now, came[rows])
    return labels


def _spans(labels: np.ndarray, found: Letters, at: int, languages: list[str]) -> str:
    """Spans of one text as language:first word:last word (exclusive)."""
    own = labels[found.texts[at] : found.texts[at + 1]]
    edges = np.append(runs(own), len(own))
    return ",".join(f"{languages[own[a]]}:{a}:{b}" for a, b in zip(edges, edges[1:]))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``spans`` of every document.

    Words are runs of letters. ``spans`` numbers them from 0. Words in a script that no language was
    learned in are letters without evidence: they lower the score, to 0 if there are no others. A null text, one without a letter, and
    every text if nothing was learned, is ``und`` with score 0 and no spans; ties go to the
    language first in order. Repeated rows are labelled each; other columns are not read.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                names, scores, spans = label_texts(part.column(1), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores), pa.array(spans, pa.string())],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"],
                )

    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans string"
    return docs.select("doc_id", "text", held_out).mapInArrow(label, schema)


def label_texts(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[str]]:
    """Language, score and spans of each text of a slice."""
    n, kinds = len(column), len(model.languages)
    found = letters_of(column)
    if not kinds or not len(found.words):
        return [UNKNOWN] * n, np.zeros(n), [""] * n
    labels = best_path(word_scores(found, model), found.texts)
    owner = np.repeat(np.arange(n), np.diff(found.texts))
    letters = found.lengths
    evidence = letters * words_in_known_script(found, model)
    votes = np.bincount(owner * kinds + labels, evidence, n * kinds).reshape(n, kinds)
    total = np.bincount(owner, letters, n)
    best = votes.argmax(1)
    scores = np.where(total > 0, votes[np.arange(n), best] / np.maximum(total, 1), 0.0)
    names = [model.languages[k] if t else UNKNOWN for k, t in zip(best, total)]
    return names, scores, [_spans(labels, found, i, model.languages) if total[i] else "" for i in range(n)]


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The documents with a language whose score is at least ``least_score``; all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                names, scores, _ = label_texts(part.column(at), shared.value)
                yield part.filter(pa.array([name != UNKNOWN and score >= least_score for name, score in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""Fill-in-the-middle forms of whole texts, cut at units that a wavelet matrix counts and finds.

Every byte of a text has one of eight classes (line end, other space, digit, letter, full stop, other
mark, first and further bytes of longer code points). A wavelet matrix over the classes of a slice
of texts answers how often a class stands before a place. A unit ends with a byte of some classes, so
ranks of those classes add up to the number of units, bisection on the sum finds the end of the
k-th one, and the rank of further bytes turns places into code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import safe_text
from cohortlab.llm.words import slices_of, text_buffer

LINE_END, SPACE, DIGIT, LETTER, STOP, MARK, FIRST, FURTHER = range(8)
LEVELS = 3
#: Classes whose bytes end a unit; what follows the last of them is a unit too.
UNITS = {"line": (LINE_END,), "sentence": (LINE_END, STOP), "word": (LINE_END, SPACE)}
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7


def _class_table() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[[9, 11, 12, 13, 32]] = SPACE
    table[10] = LINE_END
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    table[[33, 46, 63]] = STOP
    table[0x80:0xC0] = FURTHER
    table[0xC0:] = FIRST
    return table


CLASSES = _class_table()


class WaveletMatrix:
    """Ranks in a sequence of small symbols: one bit vector per bit of the symbol, from the highest;
    each level holds zeros before ones, in the order of the level above."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for bit in reversed(range(levels)):
            ones = ((symbols >> bit) & 1).astype(bool)
            # One spare word, so that the rank of the whole length needs no special case.
            packed = np.zeros((len(symbols) // 64 + 1) * 8, np.uint8)
            bits = np.packbits(ones, bitorder="little")
            packed[: len(bits)] = bits
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self.levels.append((bit, words, before, len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at`` symbols."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bit, words, before, zeros in self.levels:
            ones_low, ones_high = self._ones(words, before, low), self._ones(words, before, high)
            if symbol >> bit & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def locate(self, symbols: tuple[int, ...], low: np.ndarray, high: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Shortest place in ``[low, high]`` with ``count`` of the symbols before it (since the start
        of the sequence), by bisection on the ranks; ``high`` if there are fewer."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            half = (low + high) >> 1
            enough = self.ranks(symbols, half) >= count
            open_ = low < high
            high = np.where(open_ & enough, half, high)
            low = np.where(open_ & ~enough, half + 1, low)
        return high


def cut_places(data: np.ndarray, offsets: np.ndarray, ends: tuple[int, ...], draws: np.ndarray):
    """Number of units of each text, its two cuts (ascending byte places in ``data``) and the code
    points of the parts before and between them. ``draws`` holds two numbers per text."""
    matrix = WaveletMatrix(CLASSES[data])
    start, stop = offsets[:-1], offsets[1:]
    before = matrix.ranks(ends, start)
    units = matrix.ranks(ends, stop) - before
    closed = np.isin(CLASSES[data[np.maximum(stop - 1, 0)]], ends) if len(data) else np.ones(len(start), bool)
    units = units + ((stop > start) & ~closed)
    wanted = np.sort(draws % (units[:, None] + 1), axis=1)
    cuts = [
        np.where(k == units, stop, np.where(k == 0, start, matrix.locate(ends, start, stop, before + k)))
        for k in wanted.T
    ]
    further = [matrix.rank(FURTHER, at) for at in (start, *cuts)]
    prefix = cuts[0] - start - (further[1] - further[0])
    middle = cuts[1] - cuts[0] - (further[2] - further[1])
    return units, cuts, prefix, middle


_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def infill(docs: DataFrame, unit: str = "line", rate: int = 100, suffix_first: int = 50, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, code points of prefix and middle, and the ``output`` text.

    Four numbers of 32 bits come from the SHA-256 of ``seed:doc_id``. The first two, modulo one more
    than the units, are the numbers of units before the cuts. A text is left ``plain`` if it is empty,
    holds a marker or the third number modulo 100 is not below ``rate``; otherwise it becomes ``spm``
    (suffix first) if the fourth modulo 100 is below ``suffix_first``, else ``psm``.

    A null text counts as empty, a null id as empty text in the draw. Repeated rows give repeated
    rows. Nothing is shuffled; other columns are not read. Memory is bounded by a slice of 2 MB of
    text or by one longer text. An empty table gives no rows.
    """
    ends = UNITS[unit]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", safe_text(F.col("text")).alias("text"), *numbers)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_of(whole, "text"):
                data, offsets = text_buffer(batch.column("text"))
                h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))
                units, (one, two), prefix, middle = cut_places(data, offsets, ends, np.stack([h1, h2], axis=1))
                raw = data.tobytes()
                forms, outputs = [], []
                for i in range(batch.num_rows):
                    low, high = offsets[i], offsets[i + 1]
                    text = raw[low:high]
                    if not text or h3[i] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    head, body, tail = raw[low : one[i]], raw[one[i] : two[i]], raw[two[i] : high]
                    first_suffix = h4[i] % 100 < suffix_first
                    forms.append("spm" if first_suffix else "psm")
                    parts = (SUFFIX, tail, PREFIX, head) if first_suffix else (PREFIX, head, SUFFIX, tail)
                    outputs.append(b"".join((*parts, MIDDLE, body)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(units, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(prefix, pa.int64(), mask=plain),
                        pa.array(middle, pa.int64(), mask=plain),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(shape, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A marker starts with its only ``<`` and ends with its
    only ``>``, so a text without markers cannot form another one with its neighbours."""
    parts = F.split(output, "<[PSM]>", -1)
    suffix_first = form == "spm"
    prefix = F.when(suffix_first, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    suffix = F.when(suffix_first, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digest_documents(docs: DataFrame) -> DataFrame:
    """Forms of all documents with SHA-256 of the output and of the text restored from it."""
    return infill(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM texts
), cuts AS (
  SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
    greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM drawn
), parts AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m,
    array_to_string(lines[b + 1:n], '') AS s
  FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

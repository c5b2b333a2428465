"""Quality rules: how far a document's distributions are from those of its language.

Per document two histograms are counted over the whole text: character classes (lower and upper
case letters, digits, line ends, other white space, sentence punctuation, symbols, the rest) and
common words of its language with one cell for all other words. The reference of a language is the
mean of the normalised histograms of all its documents of at least ``MIN_WORDS`` words, so a long
document counts no more than a short one. A document's divergence is the Jensen-Shannon distance
(base 2, between 0 and 1) of each histogram to its reference.

A document is kept unless the base rules reject it or a distance is above its limit. Distances
judge a document only from ``MIN_WORDS`` words on, and only where its language has at least
``MIN_REFERENCE`` documents; short documents get a wider limit, because their histograms scatter:
``limit + slack / sqrt(words)``.

A language without a list of common words is compared by character classes alone. Defined results:
a null or empty text has no words and fails the base rules; a null lang is a language of its own;
repeated rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, table, written

WINDOW = 8
MIN_WORDS = 50
MIN_REFERENCE = 100
CHAR_LIMIT, CHAR_SLACK = 0.14, 0.9
WORD_LIMIT, WORD_SLACK = 0.2, 1.2
SYMBOLS = "#*$%&|<>"

#: Frequent words of the languages (fixed values).
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with be as by this are at from or an not".split(),
    "de": "der die das und in den von zu mit ist im auf für nicht eine ein als sich des dem auch".split(),
    "fr": "le la les de des et un une en du est que qui dans pour par pas sur au avec on".split(),
    "es": "el la los las de que y en un una por con no se del al es su para lo como".split(),
}
CELLS = 1 + max(map(len, COMMON_WORDS.values()))

#: The class of each ASCII character.
_PLACES = np.zeros(256, dtype=np.uint8)
_LOWER, _UPPER, _DIGIT, _LINE, _BLANK, _PUNCT, _SYMBOL, _REST = range(8)
_PLACES[:] = _REST
_PLACES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = _LOWER
_PLACES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _UPPER
_PLACES[[ord(c) for c in "0123456789"]] = _DIGIT
_PLACES[[10, 13]] = _LINE
_PLACES[[9, 11, 12, 32]] = _BLANK
_PLACES[[ord(c) for c in ".,;:!?'\"()-"]] = _PUNCT
_PLACES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL


def char_classes(text: str) -> np.ndarray:
    """Counts of the eight classes. Letters beyond ASCII are told apart by case conversion."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_ = points[points < 128].astype(np.uint8)
    out = np.bincount(_PLACES[ascii_], minlength=8)
    if len(ascii_) < len(points):
        for point, n in zip(*np.unique(points[points >= 128], return_counts=True)):
            c = chr(point)
            out[_LOWER if c.islower() else _UPPER if c.isupper() else _REST] += n
    return out


def repeated_words(words: list[str]) -> int:
    """Words in windows of eight words that occur twice or more, the first occurrence included.

    Windows are compared as rows of word numbers; equal sums of multiples point to equal rows, and
    rows with equal sums are told apart exactly.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    if len(seen) == len(words):
        return 0
    total = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (ids[i:i + n] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    several = np.zeros(n, dtype=bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    rows = np.flatnonzero(several)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[rows]
    _, back, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = rows[count[back.ravel()] > 1]
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """The words, and word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = [w for w in _SPLIT.split(text) if w]
    lines = Counter(line for line in text.split("\n") if _HAS_WORD.search(line))
    return (words, sum(map(len, words)), sum(map(text.count, SYMBOLS)),
            sum(lines.values()) - len(lines), repeated_words(words))


COUNTED = (
    "doc_id string, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, chars array<double>, common array<double>"
)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        rows = []
        for doc_id, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"]):
            if not text:
                rows.append((doc_id, lang, 0, 0, 0, 0, 0, None, None))
                continue
            words, *counts = base_counts(text)
            chars = char_classes(text)
            common = None
            if lang in COMMON_WORDS and words:
                found = Counter(words)
                cells = [found[w] for w in COMMON_WORDS[lang]]
                cells += [0] * (CELLS - 1 - len(cells)) + [len(words) - sum(cells)]
                common = [c / len(words) for c in cells]
            rows.append((doc_id, lang, len(words), *counts, (chars / chars.sum()).tolist(), common))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTED.split(", ")])


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string"), "lang", "text").mapInPandas(_counted, COUNTED)


def _means(column: str, size: int) -> Column:
    """The mean of each place of an array column."""
    return F.array(*(F.avg(F.col(column)[i]) for i in range(size)))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two distributions in arrays of one length."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    each = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def rate_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance) for every document; distances are null without a reference."""
    counted = written(count_documents(docs), "counted")
    reference = counted.where(F.col("n_words") >= MIN_WORDS).groupBy("lang").agg(
        F.count("*").alias("documents"), _means("chars", 8).alias("char_reference"),
        _means("common", CELLS).alias("word_reference"),
    ).where(F.col("documents") >= MIN_REFERENCE).withColumnRenamed("lang", "of")
    compared = counted.join(reference, F.col("lang").eqNullSafe(F.col("of")), "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = compared.select(
        F.col("doc_id").cast("long"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.when(F.col("chars").isNotNull() & F.col("documents").isNotNull(),
               distance("chars", "char_reference")).alias("char_distance"),
        F.when(F.col("common").isNotNull() & F.col("word_reference")[0].isNotNull(),
               distance("common", "word_reference")).alias("word_distance"),
    )
    scatter = F.sqrt(F.col("n_words").cast("double"))
    far = (F.coalesce(F.col("char_distance") > CHAR_LIMIT + CHAR_SLACK / scatter, F.lit(False))
           | F.coalesce(F.col("word_distance") > WORD_LIMIT + WORD_SLACK / scatter, F.lit(False)))
    return rated.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= MIN_WORDS) & far))


@query("op3_distribution_divergence")
def op3(spark, sf_dir):
    return rate_documents(table(spark, sf_dir, "documents"))

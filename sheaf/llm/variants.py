"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

*Vocabulary*: runs of letters of all texts, counted per task and then by word. Which runs of which
documents lose a letter is given by a checksum of document and run.

*Neighbourhoods*: every word's deletions and replacements are generated and probed in Bloom filters of
the vocabulary, one for each length of words, of blocks of 512 bits, so that a probe reads one place
of memory. A pair is generated once: from its longer word, or from the one with the smaller letter. The
hash of a word is a sum over its places, so that the hash of an edit follows from those of the word's
beginning and end, and a task computes those of all edits of many words at once. Only edits that a
filter holds leave the task; a join with the vocabulary drops false positives.

*Bound*: filters of at most ``FILTER_BYTES`` are broadcast in one pass. A larger vocabulary takes more
passes, each with some lengths, or with the words of one length that share a part of the hash space;
an edit is probed in the pass of its own length and part. So every edit is probed once.

*Roots*: a form has at least twice its word's occurrences, so chains of forms have no more links than
the logarithm of the largest count. They are followed from their ends, level by level; a word has a
bounded number of near words, so no key of these joins is frequent.

Defined results: null and empty texts have no runs; a null id changes no run; repeated rows count as
often as they occur; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs of a document loses a letter.
CHANGED = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form occurs at least this many times as often as its word.
FORM_RATIO = 2
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 200_000
BITS_PER_WORD, PROBES, BLOCK_BITS = 16, 6, 512
#: What one pass broadcasts at most.
FILTER_BYTES = 32 << 20
#: Words of this length and longer share a filter.
LONGEST = 48
#: Letters whose edits a task holds at once.
CHUNK_LETTERS = 8192


def _changed(run: str, start: int) -> str:
    """The run, without one letter where its checksum, continued from that of `<doc_id>:`, says so."""
    h = zlib.crc32(run.encode(), start)
    return run if h % CHANGED else run[: h % len(run)] + run[h % len(run) + 1:]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            if not text:
                continue
            # Bytes are lower-cased in ASCII only.
            lowered = text.encode().lower().decode()
            start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(m[0] for m in RUN.finditer(lowered)).items():
                counts[run if start is None else _changed(run, start)] += n
            if len(counts) > COUNTED_WORDS:
                yield pd.DataFrame(counts.items(), columns=["word", "n"])
                counts.clear()
    yield pd.DataFrame(counts.items(), columns=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    runs = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_counted, "word string, n long")
    return runs.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= LEAST_COUNT)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _factors(n: int) -> np.ndarray:
    """An odd factor for each place of a word."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """Many words as one row of letters, with the sums that give the hashes of words and edits."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.letter = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.uint64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.letter)) - self.first[self.word]
        factors = _factors(int(self.size.max(initial=0)) + 1)
        self.factor = factors[self.place]
        own = self.letter * self.factor
        #: As if the letter stood one place further left, for what follows a deletion.
        left = self.letter * factors[np.maximum(self.place - 1, 0)]
        self.before, self.behind = (np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(v))) for v in (own, left))
        self.end = self.first + self.size
        self.sum = self.before[self.end] - self.before[self.first]

    def hashes(self) -> np.ndarray:
        return _mixed(self.sum)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the letter, hash): one of equal letters in a row stands for them all."""
        at = np.flatnonzero((self.place == 0) | (self.letter != np.roll(self.letter, 1)))
        word = self.word[at]
        rest = self.before[at] - self.before[self.first[word]] + self.behind[self.end[word]] - self.behind[at + 1]
        return at, _mixed(rest)

    def replacements(self, alphabet: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the letter, new letter, hash) for larger letters of the alphabet, in a range of letters."""
        letter = self.letter[start:stop, None]
        at, new = np.nonzero(alphabet[None, :] > letter)
        at, new = at + start, alphabet[new]
        return at, new, _mixed(self.sum[self.word[at]] + (new - self.letter[at]) * self.factor[at])


def shard_of(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, LONGEST)


class Filters:
    """Where the filters of a pass lie. ``shards`` has (shard, words, parts, part): the words of a shard
    are dealt into parts by hash, and a pass holds some of the parts."""

    def __init__(self, shards: list[tuple[int, int, int, int]]):
        n = LONGEST + 1
        self.parts, self.part, self.blocks = np.ones(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for shard, words, parts, part in shards:
            self.parts[shard], self.part[shard], self.blocks[shard] = parts, part, _blocks(words, parts)
        self.offset = np.cumsum(self.blocks) - self.blocks
        self.cells = int(self.blocks.sum()) * (BLOCK_BITS // 64)

    def places(self, shard: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes belong to this pass, and their first cells."""
        mine = (self.blocks[shard] > 0) & ((h & np.uint64(0xFFFF)) % self.parts[shard] == self.part[shard])
        shard, h = shard[mine], h[mine]
        block = ((h >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)
        return np.flatnonzero(mine), ((self.offset[shard] + block) * np.uint64(BLOCK_BITS // 64)).astype(np.int64)


def _blocks(words: int, parts: int) -> int:
    return -(-words * BITS_PER_WORD // (parts * BLOCK_BITS)) or 1


def _bit(h: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The i-th probe of a hash: cell in the block, bit in the cell."""
    bits = _mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(9 * i)
    return ((bits >> np.uint64(6)) & np.uint64(7)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))


def passes(sizes: dict[int, int], limit: int | None = None) -> list[list[tuple[int, int, int, int]]]:
    """Which shards and parts each pass holds, given the words of each shard."""
    limit, out, used = limit or FILTER_BYTES, [[]], 0
    for shard, words in sorted(sizes.items()):
        parts = -(-words * BITS_PER_WORD // 8 // limit) or 1
        for part in range(parts):
            need = _blocks(words, parts) * BLOCK_BITS // 8
            if out[-1] and used + need > limit:
                out.append([])
                used = 0
            out[-1].append((shard, words, parts, part))
            used += need
    return [p for p in out if p]


def build_filter(words: DataFrame, filters: Filters) -> np.ndarray:
    """The cells of the filters of a pass; tasks set bits in cells, which are then combined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = Words(frame["word"].tolist())
            h = own.hashes()
            mine, first = filters.places(shard_of(own.size), h)
            cells, bits = (np.concatenate(x) for x in zip(*(
                (first + cell, bit) for cell, bit in (_bit(h[mine], i) for i in range(PROBES)))))
            order = np.argsort(cells)
            cells, bits = cells[order], bits[order]
            firsts = np.flatnonzero(np.diff(cells, prepend=-1))
            yield pd.DataFrame({"cell": cells[firsts], "bits": (np.bitwise_or.reduceat(bits, firsts) if len(bits) else bits).view(np.int64)})

    found = words.mapInPandas(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(filters.cells, dtype=np.uint64)
    out[found["cell"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _held(cells: np.ndarray, filters: Filters, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the filters hold; most are gone after the first probe."""
    at, first = filters.places(shard, h)
    h = h[at]
    for i in range(PROBES):
        cell, bit = _bit(h, i)
        hit = np.flatnonzero(cells[first + cell] & bit)
        at, first, h = at[hit], first[hit], h[hit]
    return at


def probe_edits(words: DataFrame, filters: Filters, cells: np.ndarray, alphabet: list[int]) -> DataFrame:
    """(word, n, edit) for edits of the words that the filters of a pass hold."""
    shared = words.sparkSession.sparkContext.broadcast(cells)
    letters = np.array(sorted(alphabet), dtype=np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text, n = frame["word"].to_numpy(), frame["n"].to_numpy()
            own = Words(text.tolist())
            at, h = own.deletions()
            hit = at[_held(shared.value, filters, shard_of(own.size[own.word[at]] - 1), h)]
            found = [(own.word[hit], own.place[hit], np.full(len(hit), -1))]
            for start in range(0, len(own.letter), CHUNK_LETTERS):
                at, new, h = own.replacements(letters, start, min(start + CHUNK_LETTERS, len(own.letter)))
                hit = _held(shared.value, filters, shard_of(own.size[own.word[at]]), h)
                found.append((own.word[at[hit]], own.place[at[hit]], new[hit].astype(np.int64)))
            word, place, new = (np.concatenate(x) for x in zip(*found))
            edits = [text[w][:i] + (chr(c) if c >= 0 else "") + text[w][i + 1:] for w, i, c in zip(word.tolist(), place.tolist(), new.tolist())]
            yield pd.DataFrame({"word": text[word], "n": n[word], "edit": np.array(edits, dtype=object)})

    return words.mapInPandas(run, "word string, n long, edit string")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every two words one edit apart, once, of a written vocabulary."""
    spark = vocab.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST))
    sizes = {r[0]: r[1] for r in vocab.groupBy(shard).count().collect()}
    alphabet = [ord(r[0]) for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()]
    n = max(2 * spark.sparkContext.defaultParallelism, sum(sizes.values()) // 50_000)
    dealt, found = vocab.repartition(n, "word"), []
    for shards in passes(sizes):
        filters, own = Filters(shards), [s for s, *_ in shards]
        cells = build_filter(vocab.where(shard.isin(own)), filters)
        probed = dealt.where(shard.isin(own) | (F.length("word") - 1).isin(own) | (F.length("word") > LONGEST))
        found.append(probe_edits(probed, filters, cells, alphabet))
    positives = reduce(DataFrame.unionAll, found, spark.createDataFrame([], "word string, n long, edit string"))
    known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return positives.join(known, F.col("edit") == F.col("near")).select("word", "n", "near", "near_n")


def forms_of(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("word").alias("word"), F.col("near").alias("near"), F.col("near_n").alias("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("near_words"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocab.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    taken = F.col("best_n") >= FORM_RATIO * F.col("n")
    return joined.select("word", "n", F.coalesce("near_words", F.lit(0)).cast("long").alias("n_near"),
                         F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, of a written table."""
    links = forms.where("form is not null").select("word", "form")
    ends = forms.where("form is null").select(F.col("word").alias("form"), F.col("word").alias("root"))
    levels = []
    while True:
        level = written(links.join(ends, "form").select("word", "root"), "roots")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, levels, level)
        levels.append(level)
        ends = level.withColumnRenamed("word", "form")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocab = written(vocabulary(docs), "vocabulary")
    forms = written(forms_of(vocab, near_words(vocab)), "forms")
    return forms.join(roots_of(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_bloom_spelling_variants")
def op11(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))

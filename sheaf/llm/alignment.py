"""Alignment of two tokenizers over the same bytes: cuts, groups and links of tokens.

Both tokenizers cut one string of bytes. Where tokens of both end at the same byte is a *cut*; between
two cuts lies a *group* of tokens of A and of B, and every A token of a group is *linked* to every B
token of it.

*Lockstep merging*: a task joins many documents to one string of bytes, so that ends of tokens are
comparable numbers, and divides it into lanes that start at cuts: the starts of documents, and in long
documents further cuts some hundred tokens apart, so that no lane is much longer than the others. One
vector holds the pointers of all lanes. Each step compares the ends under the pointers, advances A
where it is behind, B where it is behind, and both where they meet, which emits a cut and with it the
links of the group that it closes; lanes that are finished leave the vector.

*Counts of pairs* are corpus-wide: in how many documents a pair of ids is linked. Tasks write each
document's distinct pairs, and each block of documents what pairs it holds in how many documents. These
are summed by pair; then each block is given the sums of its own pairs, by a join, and sums up its
documents. Texts are read and tokenized once and never shuffled.

Defined results: a null or empty text, one whose tokens do not give its bytes back (such as a text with
the mark that B writes for a space), has no tokens, zeros and an empty string of groups. Repeated rows
are documents of their own and count as such; null ids stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, table, written

A_FILE, B_FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Characters tokenized at once, and of a block, which asks for counts together.
BATCH_CHARS, BLOCK_CHARS = 1_000_000, 16_000_000
#: Tokens of A between the cuts where a long document is divided, and how many ends are tried for one.
LANE_TOKENS, LANE_TRIES = 512, 32
LONG_SPACE = re.compile(r"\s{5000}")
#: Groups with more links than this are linked by distinct ids and their numbers.
WIDE = 4096


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from code point 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE, with the bytes of each of its tokens.

    Its ids are in the order of its merges, so they serve as the ranks of a faster encoder of the same
    merges. That one gives up on very long white space; such texts go to the slower encoder.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        byte_of = _byte_of_char()
        self.bytes = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        special = {i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self.slow.encode(" " + t, add_special_tokens=False).ids if LONG_SPACE.search(t) else self.fast.encode_ordinary(" " + t)
            for t in texts
        ]


class Pieces:
    """A piece model, which adds the space before a text by itself, with the bytes of each piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tokenizer(kind: type, path: str):
    return kind(path)


class Tokens:
    """The tokens of several documents in one row: ids, ends in the documents' joined bytes, and
    where each document's tokens start."""

    def __init__(self, docs: list[list[int]], sizes: np.ndarray):
        self.ids = np.fromiter(chain.from_iterable(docs), dtype=np.int64, count=sum(map(len, docs)))
        self.ends = np.cumsum(sizes[self.ids])
        self.starts = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))


def lanes(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first A and B tokens of the lanes, in order; the last entry is the end of all."""
    firsts, lasts = a.starts[:-1], a.starts[1:]
    tries = np.concatenate([np.arange(s + LANE_TOKENS, e, LANE_TOKENS) for s, e in zip(firsts, lasts)] or [[]]).astype(np.int64)
    limit = np.repeat(lasts, np.maximum(-(-(lasts - firsts) // LANE_TOKENS) - 1, 0))
    near = tries[:, None] + np.arange(LANE_TRIES)
    inside = near < limit[:, None]
    ends = a.ends[np.where(inside, near, 0)]
    met = inside & (b.ends[np.minimum(np.searchsorted(b.ends, ends), max(len(b.ends) - 1, 0))] == ends)
    cut = near[np.flatnonzero(met.any(axis=1)), met.argmax(axis=1)[met.any(axis=1)]]
    a_starts = np.unique(np.concatenate((a.starts, cut + 1)))
    before = a.ends[a_starts[1:] - 1]
    return a_starts, np.concatenate(([0], np.searchsorted(b.ends, before) + 1)) if len(a_starts) > 1 else a_starts


def lockstep(a: Tokens, b: Tokens) -> np.ndarray:
    """The groups (first A, end A, first B, end B) of all documents, in order."""
    if not len(a.ids):
        return np.empty((0, 4), dtype=np.int64)
    a_starts, b_starts = lanes(a, b)
    at_a, at_b, stop = a_starts[:-1], b_starts[:-1], a_starts[1:]
    from_a, from_b = at_a, at_b
    cuts = []
    while len(at_a):
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        met = end_a == end_b
        cuts.append(np.stack((from_a[met], at_a[met], from_b[met], at_b[met])))
        from_a, from_b = np.where(met, at_a, from_a), np.where(met, at_b, from_b)
        live = at_a < stop
        if not live.all():
            at_a, at_b, stop, from_a, from_b = (v[live] for v in (at_a, at_b, stop, from_a, from_b))
    groups = np.concatenate(cuts, axis=1).T
    return groups[np.argsort(groups[:, 0])]


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... as many as count says, one range after the other."""
    starts = np.cumsum(count) - count
    return np.repeat(first - starts, count) + np.arange(count.sum())


def links(groups: np.ndarray, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair of ids, how often) of the links; a pair of ids is A's id * 65536 + B's."""
    n_a, n_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    slim = np.flatnonzero(n_a * n_b <= WIDE)
    row = np.repeat(slim, n_a[slim])
    a_at = _expanded(groups[slim, 0], n_a[slim])
    width = n_b[row]
    pairs = (np.repeat(a.ids[a_at], width) << 16) | b.ids[_expanded(groups[row, 2], width)]
    found = [(np.repeat(row, width), pairs, np.ones(len(pairs), dtype=np.int64))]
    for g in np.flatnonzero(n_a * n_b > WIDE):
        (ids_a, times_a), (ids_b, times_b) = (
            np.unique(t.ids[s:e], return_counts=True) for t, s, e in ((a, *groups[g, :2]), (b, *groups[g, 2:])))
        found.append((np.full(len(ids_a) * len(ids_b), g), ((ids_a[:, None] << 16) | ids_b).ravel(), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


@lru_cache(maxsize=3)
def _names_before(sign: str) -> np.ndarray:
    return np.array([f"{i}{sign}" for i in range(65536)], dtype=object)


def _written_out(groups: np.ndarray, a: Tokens, b: Tokens, doc_of_group: np.ndarray, n_docs: int) -> list[str]:
    """Each document's groups as text, `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    parts = np.empty(len(a.ids) + len(b.ids), dtype=object)
    # A group's tokens of A stand before its tokens of B, behind all of the groups before it.
    place_a = np.arange(len(a.ids)) + np.repeat(groups[:, 2], n_a)
    place_b = np.arange(len(b.ids)) + np.repeat(groups[:, 1], n_b)
    for place, ids, last, sign in ((place_a, a.ids, groups[:, 1] - 1, "|"), (place_b, b.ids, groups[:, 3] - 1, ";")):
        parts[place] = _names_before(",")[ids]
        parts[place[last]] = _names_before(sign)[ids[last]]
    ends = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(ends, doc_of_group, groups[:, 1] + groups[:, 3])
    ends = np.maximum.accumulate(ends)
    return ["".join(parts[s:e].tolist())[:-1] for s, e in zip([0, *ends], ends)]


class Aligner:
    """Aligns batches of texts under two tokenizers, given as objects with ``encode`` and ``bytes``."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b)]

    def align(self, texts: list[str]) -> tuple[np.ndarray, Tokens, Tokens, np.ndarray]:
        """Which texts have tokens, those texts' tokens of A and of B, and the groups."""
        keep, kept_a, kept_b = [], [], []
        some = [i for i, t in enumerate(texts) if t]
        given = [texts[i] for i in some]
        for i, ids_a, ids_b in zip(some, self.a.encode(given), self.b.encode(given)):
            whole = b" " + texts[i].encode()
            if b"".join(map(self.a.bytes.__getitem__, ids_a)) == whole == b"".join(map(self.b.bytes.__getitem__, ids_b)):
                keep.append(i)
                kept_a.append(ids_a)
                kept_b.append(ids_b)
        a, b = (Tokens(x, s) for x, s in zip((kept_a, kept_b), self.sizes))
        return np.array(keep, dtype=np.int64), a, b, lockstep(a, b)

    def documents(self, texts: list[str]) -> pd.DataFrame:
        """One row per text: numbers of tokens, groups and links, the digest of the groups, and the
        distinct pairs, in order, with how often each is linked."""
        keep, a, b, groups = self.align(texts)
        out = pd.DataFrame({c: np.zeros(len(texts), dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")})
        for name, nothing in (("groups_sha256", ""), ("pairs", b""), ("times", b"")):
            out[name] = np.full(len(texts), nothing, dtype=object)
        if not len(keep):
            return out
        n = len(keep)
        doc_of_group = np.searchsorted(a.starts, groups[:, 0], side="right") - 1
        group, pair, times = links(groups, a, b)
        doc = doc_of_group[group]
        key, place = np.unique((doc << 32) | pair, return_inverse=True)
        times = np.bincount(place, weights=times).astype(np.int64)
        ends = np.searchsorted(key, np.arange(1, n + 1) << 32)
        key, starts = (key & 0xFFFFFFFF).astype("<u4"), np.concatenate(([0], ends[:-1]))
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in _written_out(groups, a, b, doc_of_group, n)]
        for name, values in (
            ("n_a", np.diff(a.starts)), ("n_b", np.diff(b.starts)), ("n_groups", np.bincount(doc_of_group, minlength=n)),
            ("n_links", np.add.reduceat(times, starts)), ("groups_sha256", digests),
            ("pairs", [key[s:e].tobytes() for s, e in zip(starts, ends)]),
            ("times", [times[s:e].astype("<i4" if times.max() < 2**31 else "<i8").tobytes() for s, e in zip(starts, ends)]),
        ):
            column = np.array(out[name], dtype=object)
            column[keep] = list(values)
            out[name] = column if isinstance(values, list) else column.astype(np.int64)
        return out


ALIGNED = (
    "block string, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs of several (pair, number) arrays with their summed numbers."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0])]
    firsts = np.flatnonzero(np.concatenate((rows[0, :1] == rows[0, :1], rows[0, 1:] != rows[0, :-1])))
    return np.vstack((rows[0, firsts], np.add.reduceat(rows[1], firsts))) if len(firsts) else rows


def aligned(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """A row per document, and per block one without counts that holds the block's pairs and in how many
    of its documents each is linked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(_tokenizer(ByteLevel, a_path), _tokenizer(Pieces, b_path))
        part, block, chars, held = TaskContext.get().partitionId(), 0, 0, []

        def closed() -> pd.DataFrame:
            pairs, n = _summed(held) if held else np.empty((2, 0), dtype=np.int64)
            return pd.DataFrame([{"block": f"{part}-{block}", "pairs": pairs.astype("<u4").tobytes(), "times": n.astype("<i4").tobytes()}],
                                columns=_names(ALIGNED), dtype=object)

        for frame in slices(frames, chars=BATCH_CHARS):
            texts = [t or "" for t in frame["text"]]
            out = aligner.documents(texts)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            out.insert(0, "block", f"{part}-{block}")
            pairs = np.frombuffer(b"".join(out["pairs"]), dtype="<u4").astype(np.int64)
            held = [_summed([*held, np.vstack((pairs, np.ones_like(pairs)))])]
            chars += sum(map(len, texts))
            yield out.astype({"block": object, "groups_sha256": object, "pairs": object, "times": object})
            if chars >= BLOCK_CHARS:
                yield closed()
                block, chars, held = block + 1, 0, []
        if chars:
            yield closed()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, ALIGNED)


def _pairs_of_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block, pairs, times in zip(frame["block"], frame["pairs"], frame["times"]):
            pairs = np.frombuffer(pairs, dtype="<u4").astype(np.int64)
            yield pd.DataFrame({"block": np.full(len(pairs), block, dtype=object), "pair": pairs, "docs": np.frombuffer(times, dtype="<i4")})


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that link the pair, and whether no other pair of its A id has more."""
    counts = written(
        rows.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pairs")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 16)).join(best, "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


SUMS = (
    "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _sums(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    counts = counts.sort_values("pair")
    known, n_docs, best = (counts[c].to_numpy() for c in ("pair", "n_docs", "best"))
    n_best, total = [], []
    for pairs, times, n_links in zip(docs["pairs"], docs["times"], docs["n_links"]):
        pairs = np.frombuffer(pairs, dtype="<u4")
        times = np.frombuffer(times, dtype="<i8" if len(times) > 4 * len(pairs) else "<i4").astype(np.int64)
        at = np.searchsorted(known, pairs)
        n_best.append(int(times[best[at]].sum()))
        total.append(int((times * n_docs[at]).sum()))
    return docs.assign(n_best=n_best, count_sum=total)[_names(SUMS)]


def align_documents(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    rows = written(aligned(docs, a_path, b_path), "aligned")
    of_blocks = rows.where("n_a is null").select("block", "pairs", "times").mapInPandas(
        _pairs_of_blocks, "block string, pair long, docs long")
    answers = of_blocks.select("block", "pair").join(pair_counts(of_blocks), "pair")
    found = rows.where("n_a > 0").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        lambda docs, counts: _sums(docs, counts) if len(docs) else pd.DataFrame(columns=_names(SUMS)), SUMS)
    none = rows.where("n_a = 0").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"),
        F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    return found.unionByName(none).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op12_lockstep_alignment")
def op12(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"))

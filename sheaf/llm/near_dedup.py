"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document's set holds the distinct five-word shingles of its text with A-Z lower-cased; a shorter
text is one shingle, a text without words or a null text has no set and no links. Two documents are
linked when their sets have a Jaccard similarity of 0.75 or more, and components of links are groups.

Texts with equal word sequences are one *class*, found by a 128-bit digest, so that thousands of
exact copies are one row in all that follows. Classes that agree in one of 32 bands of four
minimum hashes are candidates: two sets at the limit of 0.75 meet in a band with probability
1 - (1 - 0.75^4)^32, about 0.999995.

Not all pairs of a band's bucket are compared. Each bucket has a *hub*, the member that shares most
places in buckets, which in a group of near copies tends to be their origin:

1. Every member is compared with its hub. Nearly all near copies are linked here.
2. Two members x, y of one hub h of which x is not linked to h can only be linked if they differ from
   h in the same shingles. With Dx the symmetric difference of x and h, a similarity of 3/4 means
   |Dx| + |Dy| - 2 |Dx & Dy| <= (|x| + |y|) / 7, while |Dx| > (|x| + |h|) / 7, so Dx and Dy share more
   than b = (7 |Dy| + |h| - |y|) / 14 shingles, and any |Dy| - floor(b) shingles of Dy hold one of
   them. Each y gives so many of its Dy and ``EXTRA`` more, those rare among its neighbours first;
   each x gives all of its Dx. Pairs in different components that meet in a shingle have their
   meetings counted, unless their sizes, or ||Dx| - |Dy|| > (|x| + |y|) / 7, rule them out. A pair
   is compared if, with all the shingles that y did not give, it could share as many as the first
   inequality demands.

So every pair that shares a bucket is compared, lies in one component, or is proven not to be a
link, and the number of comparisons does not grow with the square of a bucket.

A comparison first rules out pairs by set sizes, then reads the signatures in batches and drops a
pair as soon as the posterior probability (uniform prior) that its similarity reaches the limit falls
below the chosen miss probability; survivors are compared on their full sets of shingles.

Defined results: rows with a null doc_id get no component, are kept, and take part in nothing, as
they cannot be named; repeated rows are one node and are all kept or all dropped; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, small_side, table, written
from sheaf.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-6
#: Shingles that a member gives beyond those it must; more of them make more pairs meet.
EXTRA = 0
#: Similarity limit as a fraction, so that the exact test is in integers.
NUMERATOR, DENOMINATOR = 75, 100

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None) -> set[bytes]:
    """The set itself: distinct runs of five words, or the whole sequence if it is shorter."""
    words = words_of(text)
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def _word_hashes(joined: bytes) -> np.ndarray:
    """A 64-bit hash of each word of words joined by one blank.

    One multiplicative prefix sum over all bytes; a word's hash is the difference at its ends,
    divided by the power at its start.
    """
    raw = np.frombuffer(joined, dtype=np.uint8)
    values = _mix(np.arange(1, 257, dtype=_U))[raw]
    base = 0x2545F4914F6CDD1D
    powers = np.cumprod(np.full(len(raw), base, dtype=_U))
    backward = np.cumprod(np.full(len(raw), pow(base, -1, 1 << 64), dtype=_U))
    total = np.cumsum(values * powers)
    blank = np.flatnonzero(raw == 32)
    start = np.concatenate(([0], blank + 1))
    end = np.concatenate((blank, [len(raw)]))
    before = np.where(start > 0, total[start - 1], _U(0))
    return _mix((total[end - 1] - before) * backward[start])


def shingle_hashes(joined: bytes) -> np.ndarray:
    """Distinct shingle hashes of a non-empty text, sorted."""
    words = _word_hashes(joined)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, dtype=_U)
    for i in range(min(SHINGLE, len(words))):
        out = _mix(out * _U(0x9FB21C651E98DF25) + words[i:i + n])
    return np.unique(out)


def signature(hashes: np.ndarray, multipliers: np.ndarray, increments: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(hashes), 512):  # fits the cache
        part = hashes[at:at + 512, None] * multipliers + increments
        np.minimum(low, (part ^ (part >> _U(29))).min(axis=0), out=low)
    return low


SIGNED = "doc_id string, seq binary, n_shingles long, sig binary, bands array<long>"


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    multipliers, increments = _odd(BANDS * ROWS, 1), _odd(BANDS * ROWS, 2)
    band_seed = _odd(BANDS, 3)
    for frame in frames:
        out = []
        done: dict[bytes, tuple] = {}
        for text in frame["text"]:
            words = words_of(text)
            if not words:
                out.append((None, 0, None, None))
                continue
            joined = b" ".join(words)
            seq = hashlib.blake2b(joined, digest_size=16).digest()
            if seq not in done:
                hashes = shingle_hashes(joined)
                low = _mix(signature(hashes, multipliers, increments))
                keys = band_seed.copy()
                for column in low.reshape(BANDS, ROWS).T:
                    keys = _mix(keys * _U(0x9FB21C651E98DF25) + column)
                done[seq] = (seq, len(hashes), low.astype(np.uint16).tobytes(), keys.astype(np.int64))
            out.append(done[seq])
        made = pd.DataFrame(out, columns=["seq", "n_shingles", "sig", "bands"])
        made.insert(0, "doc_id", frame["doc_id"].values)
        yield made


def sign_documents(docs: DataFrame) -> DataFrame:
    """One row per document: class digest, set size, 16 bits of each minimum hash, band keys."""
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        lambda frames: _signed(slices(frames)), SIGNED
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def least_matches(threshold: float, miss: float, total: int, batch: int) -> list[int]:
    """By batch, the fewest matches whose posterior probability of reaching the threshold is at
    least ``miss``. With a uniform prior, m of n matches leave Beta(m + 1, n - m + 1), whose upper
    tail is a sum of n + 1 binomial terms."""
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _likely(miss: float):
    limit = NUMERATOR / DENOMINATOR
    needed = least_matches(limit, miss, BANDS * ROWS, BATCH)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            a = np.frombuffer(b"".join(frame["sig_a"]), dtype=np.uint16).reshape(len(frame), -1)
            b = np.frombuffer(b"".join(frame["sig_b"]), dtype=np.uint16).reshape(len(frame), -1)
            left, matches = np.arange(len(frame)), np.zeros(len(frame), dtype=np.int64)
            for i, least in enumerate(needed):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches = matches + (a[left, part] == b[left, part]).sum(axis=1)
                left, matches = left[matches >= least], matches[matches >= least]
            yield frame[["a", "b"]].iloc[left]

    return run


def _similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, own = None, set()
    for frame in frames:
        keep = []
        for a, ta, tb in zip(frame["a"], frame["text_a"], frame["text_b"]):
            if last is None or last[0] != a or last[1] != ta:
                last, own = (a, ta), shingles_of(ta)
            other = shingles_of(tb)
            common = len(own & other)
            keep.append(DENOMINATOR * common >= NUMERATOR * (len(own) + len(other) - common))
        yield frame.loc[keep, ["a", "b"]]


def _texts(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return written(own.join(small_side(written(wanted, f"{name}-ids")), "doc_id", "left_semi"), name)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, miss: float, name: str) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    sig = nodes.select("node", "sig")
    likely = (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b").distinct()
        .join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        .mapInPandas(_likely(miss), "a long, b long")
    )
    likely = written(likely.distinct(), f"{name}-likely")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = _texts(docs, wanted, f"{name}-texts")
    sure = (
        likely.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
        .select("a", "text_a", "b", "text_b")
        .mapInPandas(_similar, "a long, b long")
    )
    return written(sure.distinct(), f"{name}-links")


def _possible(n: str, other: str) -> str:
    """Sets whose sizes differ too much cannot reach the limit."""
    return f"{DENOMINATOR} * least({n}, {other}) >= {NUMERATOR} * greatest({n}, {other})"


def _rare_first(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Each array in the order of how many of the arrays have an element."""
    together = np.concatenate(parts)
    _, back, count = np.unique(together, return_inverse=True, return_counts=True)
    often = count[back.ravel()]
    out, at = [], 0
    for part in parts:
        out.append(part[np.argsort(often[at:at + len(part)], kind="stable")])
        at += len(part)
    return out


def _differences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles in which a member and its hub differ, keyed with the hub, with set size ``n``, number
    of differences ``d``, and how many of them are ``given`` for the role of y (0 on the others).
    Members that are linked to their hub give no others; ``whole`` marks those that are not.

    Which shingles are given is free, only their number is not, so rarity need not be exact: it is
    counted over the members of a hub that a frame holds, of a few hundred at a time.
    """
    for frame in frames:
        for (hub, hub_text), family in frame.groupby(["hub", "hub_text"], sort=False):
            hub_set = shingle_hashes(b" ".join(words_of(hub_text)))
            mark = _mix(np.array([hub], dtype=np.int64).view(_U))
            for at in range(0, len(family), 500):
                some = family.iloc[at:at + 500]
                sets = [shingle_hashes(b" ".join(words_of(t))) for t in some["text"]]
                differ = _rare_first([np.setxor1d(s, hub_set, assume_unique=True) for s in sets])
                bounds = [(7 * len(d) + len(hub_set) - len(s)) // 14 for d, s in zip(differ, sets)]
                given = [len(d) - max(0, b - EXTRA) for d, b in zip(differ, bounds)]
                sizes = [g if linked else len(d) for d, g, linked in zip(differ, given, some["linked"])]
                spread = lambda values: np.repeat(np.asarray(values, dtype=np.int64), sizes)  # noqa: B023, E731
                first = np.concatenate([np.arange(n) < g for n, g in zip(sizes, given)])
                yield pd.DataFrame({
                    "key": _mix(np.concatenate([d[:n] for d, n in zip(differ, sizes)]) ^ mark).view(np.int64),
                    "node": spread(some["node"]), "component": spread(some["component"]),
                    "n": spread([len(s) for s in sets]), "d": spread([len(d) for d in differ]),
                    "given": np.where(first, spread(given), 0), "whole": spread(~some["linked"].to_numpy(dtype=bool)) > 0,
                })


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document of ``docs``."""
    signed = written(sign_documents(docs), "signed")
    named = signed.where("seq is not null and doc_id is not null")
    nodes = written(named.groupBy("seq").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    # Repeated ids with different texts are one node; identical texts link all their ids.
    copies = (
        named.select("seq", F.col("doc_id").alias("u")).join(nodes.select("seq", F.col("node").alias("v")), "seq")
        .where("u <> v").select("u", "v").distinct()
    )

    in_bands = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = in_bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(in_bands.join(shared, "key"), "members")
    places = members.groupBy("node").agg(F.sum("members").alias("places"))
    placed = members.join(places, "node")
    hubs = placed.groupBy("key").agg(
        F.max_by(F.struct("node", "n"), F.struct(F.col("places"), -F.col("node"))).alias("hub"))
    family = written(
        members.join(hubs, "key").select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
        .where("node <> hub").distinct(), "family",
    )
    pairs = family.where(_possible("n", "hub_n")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = _verified(pairs, nodes, docs, miss, "hub").toDF("u", "v")

    component = written(connected_components(links), "hub-components")
    sure = links.select(F.col("u").alias("node"), F.col("v").alias("hub")).union(links.select("v", "u"))
    family = written(
        family.join(sure.withColumn("linked", F.lit(True)), ["node", "hub"], "left")
        .join(component, "node", "left")
        .select("node", "hub", F.coalesce("linked", F.lit(False)).alias("linked"),
                F.coalesce("component", "node").alias("component")), "family",
    )
    open_hubs = family.groupBy("hub").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("linked").alias("all"),
    ).where("low <> high and not all").select("hub")
    left = written(family.join(open_hubs, "hub", "left_semi").select("node", "hub", "linked", "component").distinct(), "open")
    wanted = left.select(F.col("node").alias("doc_id")).union(left.select("hub")).distinct()
    texts = _texts(docs, wanted, "open-texts")
    differing = written(
        left.join(texts.toDF("node", "text"), "node").join(texts.toDF("hub", "hub_text"), "hub")
        .select("node", "hub", "linked", "component", "text", "hub_text")
        .mapInPandas(_differences, "key long, node long, component long, n long, d long, given long, whole boolean"), "differences",
    )
    y = differing.where("given > 0").select("key", F.col("node").alias("y"), F.col("component").alias("own"), "n", "d", "given")
    x = differing.where("whole").select("key", F.col("node").alias("x"), F.col("component").alias("other"),
                                        F.col("n").alias("other_n"), F.col("d").alias("other_d"))
    pairs = (
        y.join(x, "key").where("own <> other").where(_possible("n", "other_n"))
        .where("7 * abs(d - other_d) <= n + other_n")
        .groupBy("x", "y", "n", "other_n", "d", "other_d", "given").agg(F.count("*").alias("met"))
        .where("14 * (met + d - given) >= 7 * (d + other_d) - n - other_n")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    links = links.unionByName(_verified(pairs, nodes, docs, miss, "rest").toDF("u", "v"))

    groups = written(connected_components(links.unionByName(copies)), "components")
    return signed.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: All pairs of word sequences that share a shingle, compared on their full sets.
CHECK = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
named AS (SELECT doc_id, array_to_string(words, ' ') AS seq, words FROM split),
classes AS (SELECT seq, min(doc_id) AS node, any_value(words) AS words FROM named WHERE seq <> '' GROUP BY seq),
sets AS (SELECT seq, node, CASE WHEN len(words) < 5 THEN [seq] ELSE list_distinct(list_transform(range(1, len(words) - 3),
lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM classes),
places AS (SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (SELECT a.node AS u, b.node AS v FROM places a JOIN places b ON a.shingle = b.shingle AND a.node < b.node
GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT node AS u, node AS v FROM sets UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
groups AS (SELECT u AS node, min(v) AS component_id FROM reach GROUP BY u),
told AS (SELECT named.doc_id, coalesce(len(sets.shingles), 0) AS n_shingles, coalesce(groups.component_id, named.doc_id) AS component_id
FROM named LEFT JOIN sets ON named.seq = sets.seq LEFT JOIN groups ON sets.node = groups.node)
SELECT *, doc_id = component_id AS kept FROM told"""


@query("op8_minhash_near_dedup", CHECK)
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

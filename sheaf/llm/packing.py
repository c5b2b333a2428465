"""Packing documents into training sequences of several permitted lengths, by best fit.

A document's size is its number of words. One longer than the largest permitted length is cut into
pieces of that length and a rest, so nothing is lost. Pieces are dealt into blocks of about
``BLOCK_ROWS`` by a hash of id, text and piece number; each block is packed on its own, so no task
grows with the table, and the loss is at most the few bins of a block that are not full.

Within a block pieces go by falling size into the open bin that leaves the least room. If none has
room, a bin is opened. Its length is the permitted one with the least cost per word: a bin costs
its length, ``BIN_COST``, and its length squared over ``ATTENTION``, and is expected to hold the
piece and as many of the words still to come as have pieces that fit into its room. At the end
every bin is cut down to the least permitted length that holds its contents.

Defined results: a null or empty text has no words and is in no bin (bin null, size 0); documents
of equal size are told apart by hash, id and piece; repeated rows are packed one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import n_words, query, table, written

LENGTHS = (512, 1024, 2048, 4096)
BIN_COST = 256
ATTENTION = 8192
BLOCK_ROWS = 20_000


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, given by falling size, and the length of each bin."""
    lengths = sorted(lengths)
    count = np.zeros(lengths[-1] + 1, dtype=np.int64)
    np.add.at(count, np.asarray(sizes, dtype=np.int64), 1)
    words = np.cumsum(count * np.arange(len(count)))  # words of pieces up to a size still to come
    words = words.tolist()
    left = count.tolist()
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    room_of, where, offsets, caps = [], [], [], []
    largest = lengths[-1]
    refresh = 0
    for size in sizes:
        left[size] -= 1
        refresh += 1
        if refresh == 1024:  # the expected filling needs no exact count
            words, total, refresh = [], 0, 0
            for s, n in enumerate(left):
                total += s * n
                words.append(total)
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            best = None
            for cap in lengths:
                if cap >= size:
                    room = cap - size
                    held = size + min(room, words[min(room, largest)])
                    cost = (cap + bin_cost + cap * cap / ATTENTION) / held
                    if best is None or cost < best[0]:
                        best = (cost, cap)
            b, room = len(caps), best[1]
            caps.append(best[1])
            room_of.append(0)
        where.append(b)
        offsets.append(caps[b] - room)
        room_of[b] = room - size
        if room > size:
            insort(open_bins, (room - size, b))
    final = [lengths[bisect_left(lengths, cap - room)] for cap, room in zip(caps, room_of)]
    return where, offsets, final


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, piece, size, bin, bin_length, offset): one row per piece of a document."""
    largest = max(lengths)
    sized = docs.select(
        F.col("doc_id").cast("long"), n_words(F.col("text")).alias("words"), F.xxhash64("doc_id", "text").alias("mark"))
    pieces = sized.select(
        "doc_id", "words", "mark",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / largest)).cast("int"))).alias("piece"),
    ).withColumn("size", F.least(F.lit(largest), F.col("words") - F.col("piece") * largest).cast("int"))
    pieces = written(pieces.drop("words"), "pieces")
    n = max(1, -(-pieces.count() // block_rows))
    # Copies of a row share a mark; a third of the table with one mark must not be one block.
    dealt = pieces.where("size > 0").withColumn(
        "block", F.pmod(F.xxhash64("mark", "piece", F.monotonically_increasing_id()), F.lit(n)))
    chosen = tuple(lengths)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "mark", "doc_id", "piece"], ascending=[False, True, True, True])
        where, offsets, final = pack(block["size"].tolist(), chosen, bin_cost)
        key = int(block["block"].iloc[0])
        return pd.DataFrame({
            "doc_id": block["doc_id"].values, "piece": block["piece"].values, "size": block["size"].values,
            "bin": [f"{key}-{b}" for b in where], "bin_length": [final[b] for b in where], "offset": offsets,
        })

    # The blocks follow from the written pieces, whose order within their files is fixed.
    packed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("block").applyInPandas(
        run, "doc_id string, piece int, size int, bin string, bin_length int, offset int")
    empty = pieces.where("size <= 0").select(
        F.col("doc_id").cast("string"), "piece", F.lit(0).alias("size"), F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("offset"))
    return packed.unionByName(empty).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op4_variable_best_fit")
def op4(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))

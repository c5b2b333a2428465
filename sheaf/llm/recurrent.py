"""Log-likelihood of documents under a gated recurrent language model over words.

*Tokens* are words, lower-cased in ASCII, and one end per document. Tasks number the words of blocks of
documents and write the documents as numbers; each block lists its words with their occurrences in
training documents. Lists are summed by word, and every block is given the counts of its own words by a
join. Texts are read once and never shuffled, and nothing that grows with the vocabulary is broadcast.

*Classes*: the ``HEAD_WORDS`` most frequent words and the end lie in classes of ``CLASS_WORDS``, by rank.
All other words lie in classes by the logarithm, to base four, of their count and by form (other than ASCII letters, a
sign at the end, digits), and so do words that training documents do not have. The probability of a
token is that of its class times that of the word in the class, both from the state, by softmax, for a
class of the head; in the other classes a word has its share of the class's occurrences, and an unseen
one is taken for one of as many as occurred once there.

*Training*: a gated recurrent unit with hand-written backpropagation, truncated to windows. Each task
runs the documents of its part through many lanes at once; the state is carried from window to window
and reset where a document, or a piece of a long one, starts. In each of ``ROUNDS`` rounds tasks start from one model, learn from
another share of all training documents, and their models are averaged by tokens, at most ``FAN_IN``
at a time. A training token's count is taken less its own occurrence, so that the model meets unseen
words as often as it will in other texts.

*Scoring* carries the state through the whole document, whatever its length.

Defined results: null and empty texts are one end; a null id is the empty text for the checksum;
repeated rows are documents of their own; without training documents all counts are 0 and the model is
the one that training would start from; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, table, written

#: Of so many remainders of the checksum, the one that is held out.
FOLDS, HELD_OUT = 7, 2
#: A block ends after so many characters or distinct words; a slice of text adds some millions at most.
BLOCK_CHARS, BLOCK_WORDS = 32_000_000, 2_000_000
HEAD_WORDS, LEAST_HEAD_COUNT, CLASS_WORDS = 511, 10, 32
STATE = 16
LANES, WINDOW = 256, 20
#: Tokens laid into lanes at once; scoring takes more, as whole documents are of unequal length.
LEARNED_TOKENS, SCORED_TOKENS = 400_000, 2_000_000
#: Tokens of a document after which training, not scoring, starts from a new state.
PIECE_TOKENS = 600
ROUNDS, FAN_IN, RATE, CLIP = 4, 64, 0.1, 1.0
#: What sums of squared gradients start from.
FIRST_SQUARE = 1e-5
FORMS = 8
#: Classes by count are powers of four.
BANDS = 32
LOG10 = math.log(10)


def is_held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % FOLDS == HELD_OUT


# Documents as numbers


NUMBERED = "block string, doc_id string, held_out boolean, numbers binary, words array<string>, counts array<long>"


def _numbers() -> dict[str, int]:
    """Words to numbers; a word that is asked for first gets the next one."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return known


def _tokens(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words by their first place, which of them each word is, and the words of each text."""
    # Lower-cased, and split, by ASCII only. White space at an end of a text leaves an empty word there.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(there)))[ends]
    coded = words.filter(pa.array(there)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(before)


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document, and per block one with its words and their occurrences in training."""
    part, block, chars, known, counts, learned = TaskContext.get().partitionId(), 0, 0, _numbers(), np.zeros(0, np.int64), []

    def summed() -> np.ndarray:
        every = np.concatenate([np.zeros(0, np.int64), *learned])
        return np.pad(counts, (0, len(known) - len(counts))) + np.bincount(every, minlength=len(known))

    def closed(counts) -> pd.DataFrame:
        return pd.DataFrame({
            "block": [f"{part}-{block}"], "doc_id": [None], "held_out": [None], "numbers": [None],
            "words": [list(known)], "counts": [counts]}, dtype=object)

    for frame in slices(frames):
        numbers, held_out = [], [is_held_out(d) for d in frame["doc_id"]]
        # A word is looked up once for all its occurrences in the frame.
        distinct, which, lengths = _tokens(frame["text"].tolist())
        every = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[which]
        for own, held in zip(np.split(every, np.cumsum(lengths)[:-1]), held_out):
            numbers.append(_stored(own))
            if not held:
                learned.append(own)
        chars += sum(len(t or "") for t in frame["text"])
        yield pd.DataFrame({
            "block": np.full(len(frame), f"{part}-{block}", dtype=object), "doc_id": frame["doc_id"].to_numpy(), "held_out": held_out,
            "numbers": numbers, "words": None, "counts": None})
        counts, learned = summed(), []
        if chars >= BLOCK_CHARS or len(known) >= BLOCK_WORDS:
            yield closed(counts)
            block, chars, known, counts = block + 1, 0, _numbers(), np.zeros(0, np.int64)
    if known:
        yield closed(counts)


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_numbered, NUMBERED)


# Classes


def _stored(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24, the lower bytes before the upper ones."""
    return numbers.astype("<u2").tobytes() + (numbers >> 16).astype("u1").tobytes()


def _restored(stored: bytes) -> np.ndarray:
    n = len(stored) // 3
    return np.frombuffer(stored, "<u2", n).astype(np.int64) | np.frombuffer(stored, "u1", n, 2 * n).astype(np.int64) << 16


class Classes:
    """The corpus' size, and what class and share of it a count gives. Codes stand for the end (0), the
    words of the head by rank, and the other classes, of which unseen words have the first ones."""

    def __init__(self, n_tokens: int, n_distinct: int, ends: int, head: list[int], tail: dict[tuple[int, int], tuple[int, int]]):
        self.n_tokens, self.n_distinct, self.ends = n_tokens, n_distinct, ends
        self.n_head = len(head) + 1
        self.n_classes = -(-self.n_head // CLASS_WORDS)
        self.code = np.full((BANDS + 1, FORMS), self.n_head, dtype=np.int64)
        self.code[0] += np.arange(FORMS)
        self.mass = np.ones((BANDS + 1, FORMS))
        self.mass[0] = [1 + tail.get((1, f), (0, 0))[1] for f in range(FORMS)]
        for i, ((band, form), (mass, _)) in enumerate(sorted(tail.items())):
            self.code[band, form], self.mass[band, form] = self.n_head + FORMS + i, mass
        # A count less one can lie in a class that no whole count is in; it then counts as one below.
        for band in range(1, BANDS + 1):
            for form in range(FORMS):
                if (band, form) not in tail:
                    self.code[band, form] = self.code[band - 1, form]
        #: Occurrences of the head, and of the other classes; those of words met once count as unseen ones.
        self.head = np.array([ends, *head], dtype=np.float64)
        self.tail = np.array([*self.mass[0], *(tail[k][0] for k in sorted(tail))], dtype=np.float64)
        #: The code of a count less one where that lies in another class.
        self.below = np.concatenate((np.arange(self.n_head + FORMS), np.array([self.code[b - 1, f] for b, f in sorted(tail)], dtype=np.int64)))
        self.n_codes = self.n_head + FORMS + len(tail)
        self.n_outputs = self.n_classes + FORMS + len(tail)

    @staticmethod
    def bands(count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, 1 + (np.log2(np.maximum(count, 1) + 0.25) / 2).astype(np.int64), 0)

    def codes(self, count: np.ndarray, rank: np.ndarray, form: np.ndarray) -> np.ndarray:
        return np.where(rank > 0, rank, self.code[self.bands(count), form])

    def log_shares(self, count: np.ndarray, rank: np.ndarray, form: np.ndarray) -> np.ndarray:
        return np.where(rank > 0, 0.0, np.log(np.maximum(count, 1) / self.mass[self.bands(count), form]))


def word_table(rows: DataFrame) -> DataFrame:
    """(word, c, form): occurrences of all blocks' words in training documents."""
    word = F.col("word")
    form = (word.rlike(r"[^\x00-\x7F]").cast("int") + 2 * word.rlike(r"[!-/:-@\[-`{-~]$").cast("int")
            + 4 * word.rlike(r"[0-9]").cast("int"))
    return rows.groupBy("word").agg(F.sum("n").alias("c")).withColumn("form", form)


def classes_of(words: DataFrame, ends: int) -> tuple[Classes, DataFrame]:
    """The classes, and (word, rank) of the head, which has at most ``HEAD_WORDS`` rows."""
    spark = words.sparkSession
    n, distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = words.where(F.col("c") >= LEAST_HEAD_COUNT).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).select("word", "c").collect()
    ranks = spark.createDataFrame([(r["word"], i) for i, r in enumerate(head, 1)], "word string, rank int")
    band = (1 + F.floor(F.log2(F.col("c") + 0.25) / 2)).cast("int")
    tail = words.where("c > 0").join(F.broadcast(ranks), "word", "left_anti").groupBy(band.alias("band"), "form").agg(
        F.sum("c").alias("mass"), F.count(F.when(F.col("c") == 1, 1)).alias("words")).collect()
    found = {(r["band"], r["form"]): (r["mass"], r["words"]) for r in tail}
    return Classes(n + ends, distinct + (ends > 0), ends, [r["c"] for r in head], found), ranks


ENCODED = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, log_share double, codes binary, less binary"


def _encoder(classes: Classes) -> Callable:
    names = [c.split()[0] for c in ENCODED.split(", ")]
    per_token = math.log10(classes.n_tokens + classes.n_distinct + 1)

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        count, rank, form = (np.zeros(len(answers), dtype=np.int64) for _ in range(3))
        for values, name in ((count, "c"), (rank, "rank"), (form, "form")):
            values[answers["pos"].to_numpy()] = answers[name].to_numpy()
        codes, share = classes.codes(count, rank, form), classes.log_shares(count, rank, form)
        lower = codes != classes.codes(np.maximum(count - 1, 0), rank, form)
        out = []
        for doc_id, held, numbers in zip(docs["doc_id"], docs["held_out"], docs["numbers"]):
            own = _restored(numbers)
            base = np.log10(count[own] + 1.0).sum() + math.log10(classes.ends + 1) - (len(own) + 1) * per_token
            out.append((
                doc_id, held, len(own) + 1, int((count[own] > 0).sum()) + (classes.ends > 0), base, share[own].sum(),
                np.append(codes[own], 0).astype("<u2").tobytes(), None if held else np.packbits(lower[own]).tobytes()))
        return pd.DataFrame(out, columns=names)

    return run


# The model


def initial(classes: Classes) -> dict[str, np.ndarray]:
    """A model that gives every token its class's and its own frequency, whatever the state."""
    rng = np.random.default_rng(7)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    # Places of the last class beyond the head have no probability.
    words = np.zeros(classes.n_classes * CLASS_WORDS)
    words[: classes.n_head] = classes.head + 1
    words = words.reshape(classes.n_classes, CLASS_WORDS)
    return {
        "inputs": normal(0.1, classes.n_codes, 3 * STATE), "state": normal(STATE**-0.5, STATE, 3 * STATE),
        "classes": np.zeros((STATE, classes.n_outputs), dtype=np.float32),
        "class_bias": np.log(np.concatenate((words.sum(axis=1), classes.tail))).astype(np.float32),
        "words": np.zeros((classes.n_classes, STATE, CLASS_WORDS), dtype=np.float32),
        "word_bias": np.log(np.maximum(words, 1e-30)).astype(np.float32),
    }


def packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(v.astype("<f4").tobytes() for v in model.values())


def unpacked(blob: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, flat, at = {}, np.frombuffer(blob, dtype="<f4"), 0
    for name, v in like.items():
        out[name] = flat[at:at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


#: What weights are taken times: gates are sigmoids of twice the sum, by the power of its negative.
SIGNS = np.repeat(np.array([-2, 1], dtype=np.float32), (2 * STATE, STATE))


def _gates(x: np.ndarray) -> np.ndarray:
    """Makes x, in which signs are taken, the gates. A power beyond a float's range is infinite, and gives 0."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Lanes:
    """Documents (arrays of codes) laid one after the other into lanes of about equal length, the longest
    lanes first, read in windows. A document's first input is the end."""

    def __init__(self, docs: list[np.ndarray], n: int = LANES):
        load: list[tuple[int, int]] = [(0, i) for i in range(min(n, len(docs)))]
        held: list[list[int]] = [[] for _ in load]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            size, i = heapq.heappop(load)
            held[i].append(d)
            heapq.heappush(load, (size + len(docs[d]), i))
        sizes = {i: size for size, i in load}
        order = sorted(range(len(held)), key=lambda i: -sizes[i])
        laid = [d for i in order for d in held[i]]
        self.sizes = np.array([sizes[i] for i in order], dtype=np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        lengths = np.array([len(docs[d]) for d in laid], dtype=np.int64)
        self.target = np.concatenate([docs[d] for d in laid]).astype(np.int32)
        self.doc = np.repeat(np.array(laid, dtype=np.int32), lengths)
        self.start = np.zeros(len(self.target), dtype=bool)
        self.start[np.cumsum(lengths) - lengths] = True
        self.given = np.where(self.start, np.int32(0), np.roll(self.target, 1))

    def windows(self, width: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, present) with a row for each step and a column for each lane that is not at its end."""
        for t in range(0, int(self.sizes[0]), width):
            live = int(np.searchsorted(-self.sizes, -t))
            steps = t + np.arange(width)[:, None]
            present = steps < self.sizes[:live]
            yield np.where(present, self.firsts[:live] + steps, 0), present


def _states(m: dict, lanes: Lanes, at: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states after each step of a window, by step, feature and lane, so that gates are whole blocks of memory;
    with ``keep``, what backpropagation needs is added to it: states before, their products, gates and new states."""
    # The gates and the new states take the place of the inputs.
    x = np.ascontiguousarray(np.take(m["inputs"] * SIGNS, lanes.given[at], axis=0).transpose(0, 2, 1))
    fresh, out = lanes.start[at], np.empty((len(at), STATE, at.shape[1]), dtype=np.float32)
    starts, weights = fresh.any(axis=1), np.ascontiguousarray((m["state"] * SIGNS).T)
    own = np.empty(x.shape[1:], dtype=x.dtype)
    if keep is not None:
        keep += [np.empty_like(x[:, :STATE]), np.empty_like(x[:, :STATE]), x]
    with np.errstate(over="ignore"):
        for t in range(len(at)):
            if starts[t]:
                h = np.where(fresh[t], np.float32(0), h)
            np.matmul(weights, h, out=own)
            if keep is not None:
                keep[0][t], keep[1][t] = h, own[2 * STATE:]
            gates, new = x[t, : 2 * STATE], x[t, 2 * STATE:]
            gates += own[: 2 * STATE]
            z, r = _gates(gates).reshape(2, STATE, -1)
            new += np.multiply(r, own[2 * STATE:], out=own[2 * STATE:])
            np.tanh(new, out=new)
            step = h - new
            step *= z
            h = np.add(new, step, out=out[t])
    return out


def _row_max(x: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column."""
    return x.max(axis=1, keepdims=True)


def _powers(x: np.ndarray, bounded: bool = False) -> np.ndarray:
    """Makes the rows of x a softmax times what is returned, the sum of each row. Rows that are ``bounded`` need
    nothing taken off before."""
    if not bounded:
        x -= _row_max(x)
    np.exp(x, out=x)
    return x.sum(axis=1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    x /= _powers(x)
    return x


def _softmax_at(x: np.ndarray, at: np.ndarray, bounded: bool = False) -> np.ndarray:
    """One place of each row of a softmax."""
    sums = _powers(x, bounded)[:, 0]
    return x.T.reshape(-1)[at * len(x) + np.arange(len(x))] / sums


def _bounded(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """The bias, its largest at 0, and whether sums of powers then stay well within a float's range, whatever the state."""
    return bias - bias.max(axis=-1, keepdims=True), bool(np.abs(weights).sum(axis=-2).max() < 40)


def _by_class(codes: np.ndarray, n_head: int) -> Iterator[tuple[int, np.ndarray]]:
    """Classes of the head among the codes, and where they are."""
    order, groups = _ordered_by_class(codes, n_head)
    for c, own in groups:
        yield c, order[own]


def _ordered_by_class(codes: np.ndarray, n_head: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of the head's codes by class, and each class with its share of them."""
    head = np.flatnonzero(codes < n_head)
    # Numbers of 16 bits are sorted by their digits.
    order = head[np.argsort((codes[head] // CLASS_WORDS).astype(np.uint16), kind="stable")]
    which = codes[order] // CLASS_WORDS
    cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(order)]
    return order, [(int(which[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:]) if a < b]


def _outputs(codes: np.ndarray, n_head: int, n_classes: int) -> np.ndarray:
    return np.where(codes < n_head, codes // CLASS_WORDS, n_classes + codes - n_head)


class Model:
    def __init__(self, weights: dict[str, np.ndarray], n_head: int, n_classes: int):
        self.m, self.n_head, self.n_classes = weights, n_head, n_classes
        self.past = {k: np.full(v.shape, FIRST_SQUARE, dtype=np.float32) for k, v in weights.items()}

    def log_likelihoods(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of log probabilities of the codes of each document."""
        lanes, total, m = Lanes(docs), np.zeros(len(docs)), self.m
        (class_bias, classes_bounded), (word_bias, words_bounded) = _bounded(m["classes"], m["class_bias"]), _bounded(m["words"], m["word_bias"])
        h = np.zeros((STATE, len(lanes.sizes)), dtype=np.float32)
        for at, present in lanes.windows():
            states = _states(m, lanes, at, h[:, : at.shape[1]])
            h = states[-1]
            s, codes, own, groups = self._laid(lanes, states, at, present)
            # Rows are tokens, and columns whole blocks of memory.
            x = (m["classes"].T @ s).T
            x += class_bias
            log_p = np.log(_softmax_at(x, _outputs(codes, self.n_head, self.n_classes), classes_bounded) + np.float32(1e-30)).astype(np.float64)
            for c, rows in groups:
                x = (m["words"][c].T @ s[:, rows]).T
                x += word_bias[c]
                log_p[rows] += np.log(_softmax_at(x, codes[rows] % CLASS_WORDS, words_bounded) + np.float32(1e-30))
            total += np.bincount(lanes.doc[at.ravel()[own]], weights=log_p, minlength=len(docs))
        return total

    def _laid(self, lanes: Lanes, states: np.ndarray, at: np.ndarray, present: np.ndarray) -> tuple:
        """States (by feature) and codes of the tokens of a window, first those of the head's classes, where in the
        window each is, and the share of each class."""
        there = np.flatnonzero(present)
        codes = lanes.target[at.ravel()[there]]
        order, groups = _ordered_by_class(codes, self.n_head)
        order = np.concatenate((order, np.flatnonzero(codes >= self.n_head)))
        own = there[order]
        return states.transpose(1, 0, 2).reshape(STATE, -1).take(own, axis=1), codes[order], own, groups

    def _step(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        """Adagrad, on all weights of a name or on some rows."""
        self.past[name][at] += grad * grad
        self.m[name][at] -= RATE * grad / np.sqrt(self.past[name][at])

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass over the documents; long ones in pieces, so that all lanes end together and no few
        documents are learned from alone."""
        lanes, m = Lanes([d[i:i + PIECE_TOKENS] for d in docs for i in range(0, len(d), PIECE_TOKENS)]), self.m
        h = np.zeros((STATE, len(lanes.sizes)), dtype=np.float32)
        for at, present in lanes.windows():
            kept: list = []
            states = _states(m, lanes, at, h[:, : at.shape[1]], kept)
            h = states[-1]
            s, codes, own, groups = self._laid(lanes, states, at, present)
            # By full windows, so that the last lanes of a buffer count by their tokens.
            scale = np.float32(1 / (LANES * WINDOW))
            p = (m["classes"].T @ s).T
            bias, bounded = _bounded(m["classes"], m["class_bias"])
            p += bias
            p *= scale / _powers(p, bounded)
            p.T.reshape(-1)[_outputs(codes, self.n_head, self.n_classes) * len(p) + np.arange(len(p))] -= scale
            # The last column is for places behind the ends of lanes.
            back = np.zeros((STATE, len(codes) + 1), dtype=np.float32)
            np.matmul(m["classes"], p.T, out=back[:, :-1])
            steps = {"classes": s @ p, "class_bias": p.sum(axis=0)}
            words, word_bias = np.zeros_like(m["words"]), np.zeros_like(m["word_bias"])
            bias, bounded = _bounded(m["words"], m["word_bias"])
            for c, rows in groups:
                p = (m["words"][c].T @ s[:, rows]).T
                p += bias[c]
                p *= scale / _powers(p, bounded)
                p.T.reshape(-1)[codes[rows] % CLASS_WORDS * len(p) + np.arange(len(p))] -= scale
                back[:, rows] += m["words"][c] @ p.T
                words[c], word_bias[c] = s[:, rows] @ p, p.sum(axis=0)
            # A class that no token is in has no gradient, and stays as it is.
            self._step("words", words)
            self._step("word_bias", word_bias)
            column = np.full(at.size, len(codes))
            column[own] = np.arange(len(codes))
            given = back.take(column, axis=1).reshape(STATE, *at.shape)
            before, product, x = kept
            z, r, new = x[:, :STATE], x[:, STATE: 2 * STATE], x[:, 2 * STATE:]
            # What the gradient of a state is multiplied with, for the new state and for what the state before was taken times.
            rest, of_new, of_own = 1 - z, 1 - new * new, np.empty((len(at), 3, STATE, at.shape[1]), dtype=np.float32)
            of_new *= rest
            np.multiply(before - new, rest, out=of_own[:, 0])
            of_own[:, 0] *= z
            of_own[:, 0] *= 2
            np.multiply(r, of_new, out=of_own[:, 2])
            np.multiply(product, of_own[:, 2], out=of_own[:, 1])
            of_own[:, 1] *= 1 - r
            of_own[:, 1] *= 2
            d_own, d_states = np.empty_like(of_own), np.empty(states.shape, dtype=np.float32)
            fresh = lanes.start[at]
            starts = fresh.any(axis=1)
            d_h = np.zeros(states[0].shape, dtype=m["state"].dtype)
            for t in range(len(at) - 1, -1, -1):
                d_state = np.add(d_h, given[:, t], out=d_states[t])
                np.multiply(of_own[t], d_state, out=d_own[t])
                np.matmul(m["state"], d_own[t].reshape(3 * STATE, -1), out=d_h)
                d_state = d_state * z[t]
                d_h += d_state
                if starts[t]:
                    d_h[:, fresh[t]] = 0
            d_own = d_own.transpose(1, 2, 0, 3).reshape(3 * STATE, -1)
            steps["state"] = before.transpose(1, 0, 2).reshape(STATE, -1) @ d_own.T
            of_new *= d_states
            d_x = d_own
            d_x[2 * STATE:] = of_new.transpose(1, 0, 2).reshape(STATE, -1)
            codes_in = lanes.given[at].ravel()
            order = np.argsort(codes_in.astype(np.uint16), kind="stable")
            times = np.bincount(codes_in)
            there = np.flatnonzero(times)
            firsts = np.cumsum(times[there]) - times[there]
            size = math.sqrt(sum(float((g * g).sum()) for g in steps.values()))
            for name, grad in steps.items():
                self._step(name, grad * np.float32(min(1, CLIP / (size + 1e-12))))
            self._step("inputs", np.add.reduceat(d_x.take(order, axis=1), firsts, axis=1).T, there)


def _buffered(frames: Iterator[pd.DataFrame], tokens: int) -> Iterator[pd.DataFrame]:
    """Rows in frames of about so many codes."""
    held, size = [], 0
    for frame in frames:
        lengths = frame["codes"].str.len().to_numpy() // 2
        for _, part in frame.groupby((np.cumsum(lengths) + size) // tokens, sort=True):
            held.append(part)
            size += int(part["codes"].str.len().sum()) // 2
            if size >= tokens:
                yield pd.concat(held)
                held, size = [], 0
    if held:
        yield pd.concat(held)


def _learned(codes: bytes, less: bytes, below: np.ndarray) -> np.ndarray:
    """Codes by counts less one."""
    codes = np.frombuffer(codes, dtype="<u2").astype(np.int64)
    lower = np.unpackbits(np.frombuffer(less, dtype=np.uint8), count=len(codes) - 1).astype(bool)
    codes[:-1][lower] = below[codes[:-1][lower]]
    return codes


def train(encoded: DataFrame, classes: Classes) -> dict[str, np.ndarray]:
    """The averaged model after all rounds."""
    spark, model = encoded.sparkSession, initial(classes)
    like = {k: np.empty(v.shape, dtype=np.bool_) for k, v in model.items()}
    n_head, n_classes, below = classes.n_head, classes.n_classes, classes.below

    def averaged(frame: pd.DataFrame) -> pd.DataFrame:
        total, out = float(frame["tokens"].sum()), 0.0
        for tokens, blob in zip(frame["tokens"], frame["model"]):
            out = out + np.frombuffer(blob, dtype="<f4").astype(np.float64) * (tokens / total)
        return pd.DataFrame({"id": [int(frame["id"].iloc[0]) // FAN_IN], "tokens": [total], "model": [out.astype("<f4").tobytes()]})

    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(packed(model))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, tokens = Model(unpacked(shared.value, like), n_head, n_classes), 0
            for frame in _buffered(frames, LEARNED_TOKENS):
                docs = [_learned(codes, less, below) for codes, less in zip(frame["codes"], frame["less"])]
                own.learn(docs)
                tokens += sum(map(len, docs))
            if tokens:
                yield pd.DataFrame({"id": [TaskContext.get().partitionId()], "tokens": [float(tokens)], "model": [packed(own.m)]})

        share = F.pmod(F.xxhash64("doc_id", "codes"), F.lit(ROUNDS)) == number
        chosen = encoded.where("less is not null").where(share).select("codes", "less")
        models = chosen.mapInPandas(run, "id long, tokens double, model binary")
        tasks = chosen.rdd.getNumPartitions()
        while tasks > 1:
            models = models.groupBy((F.col("id") / FAN_IN).cast("long").alias("g")).applyInPandas(
                averaged, "id long, tokens double, model binary")
            tasks = -(-tasks // FAN_IN)
        found = models.first()
        if found is not None:
            model = unpacked(found["model"], like)
    return model


def log_likelihoods(encoded: DataFrame, classes: Classes, model: dict[str, np.ndarray]) -> DataFrame:
    """The encoded documents with ``score``, the log10 probability of the whole text."""
    shared = encoded.sparkSession.sparkContext.broadcast(packed(model))
    like = {k: np.empty(v.shape, dtype=np.bool_) for k, v in model.items()}
    n_head, n_classes = classes.n_head, classes.n_classes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(unpacked(shared.value, like), n_head, n_classes)
        for frame in _buffered(frames, SCORED_TOKENS):
            sums = own.log_likelihoods([np.frombuffer(b, dtype="<u2") for b in frame["codes"]])
            yield frame.drop(columns="codes").assign(score=(sums + frame["log_share"].to_numpy()) / LOG10)

    return encoded.drop("less").mapInPandas(
        run, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, log_share double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    rows = written(numbered(docs), "numbered")
    of_blocks = rows.where("words is not null").select(
        "block", F.posexplode(F.arrays_zip("words", "counts"))).select("block", "pos", F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    words = written(word_table(of_blocks), "words")
    ends = rows.where("not held_out").count()
    classes, ranks = classes_of(words, ends)
    ranked = words.join(F.broadcast(ranks), "word", "left").select("word", "c", F.coalesce("rank", F.lit(0)).alias("rank"), "form")
    # A part of the words is small beside what asks for it, and hashing spares the sorting of both.
    answers = of_blocks.select(F.col("block").alias("asking"), "pos", "word").join(ranked.hint("shuffle_hash"), "word").drop("word")
    encode = _encoder(classes)
    encoded = written(
        rows.where("numbers is not null").select("block", "doc_id", "held_out", "numbers").groupBy("block")
        .cogroup(answers.groupBy("asking")).applyInPandas(lambda docs, answers: encode(docs, answers), ENCODED), "encoded")
    scored = log_likelihoods(encoded, classes, train(encoded, classes))
    return scored.select(F.col("doc_id").cast("long"), "held_out", "n_tokens", "n_known",
                         F.lit(classes.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op13_recurrent_scoring")
def op13(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))

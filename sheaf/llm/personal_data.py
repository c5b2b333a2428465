"""Personal data in texts: a semi-Markov conditional random field over whole spans.

Base patterns for e-mail addresses, IP addresses, card and phone numbers are exact and always kept.
The random field adds spans of the same four kinds that the patterns miss, such as phone numbers
without a plus sign or addresses written with words for their signs.

A text is first cut into *stretches*: tokens that can be part of an entity (they hold a digit, a
sign such as ``@``, or words for signs in any case, or stand between such tokens) with a few tokens around them. Outside of
stretches only the label "other" is possible, so decoding stretch by stretch gives the best
segmentation of the whole text. In a stretch every run of up to ``MAX_SPAN`` tokens is a candidate
segment for each kind. A segment's score is the sum of weights of features of the whole span: its
shape, number of digits, Luhn sum, parts up to 255, signs inside it, words before it. Dynamic
programming over segment ends finds the best sequence of segments and kinds (Viterbi) and, in
training, the partition function for the gradient of the likelihood.

Training is in the driver on at most ``TRAIN_STRETCHES`` stretches, drawn by hash from the table and
from texts with a base match and others, labelled by the base patterns (distant supervision); copies in other notations (without plus sign,
with words for signs, with brackets) are made of them, so that the field learns what the patterns
cannot see. Weights are a few hundred numbers and travel with the tasks.

Defined results: a null or empty text has no spans; repeated rows give equal results; without any
base match in the table nothing is added; an empty table gives no rows; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, table, written

KINDS = ("email", "ip", "card", "phone")
MAX_SPAN = 8
TRAIN_STRETCHES = 1_500
#: Documents drawn for training, by hash.
TRAIN_DOCS = 1_500
TRAIN_CHARS = 20_000
EPOCHS = 6
#: A segment is added when its score is above "other" by this much (natural log).
MIN_GAIN = 2.0
#: Longer stretches are decoded in overlapping windows of so many tokens.
MAX_STRETCH = 400
#: A stretch starts so many tokens before the first that can be part of an entity, if they are within
#: so many characters.
BEFORE, BEFORE_CHARS = 2, 80

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9][0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, leftmost and non-overlapping per kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_TOKEN = re.compile(r"\S+")
#: Whatever else may stand for signs in _MAIL_WORDS: a bare "at" needs a host with a point or "dot"
#: behind it, so that "at noon. Then" is none.
_HOT = re.compile(
    r"[0-9@]|[\[(](?:at|dot)\b|\b(?:at|dot)[\])]|\bdot\b"
    r"|\bat(?=\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]|\s+\.\s*[A-Za-z0-9-]|\.\s+(?-i:[a-z])|\s*[\[(]?dot\b))", re.IGNORECASE)
_EDGE = ".,;:!?\"'()[]{}<>"
_TRAIL = ".,;:!?\"'>]}"


def _start(text: str, at: int) -> int:
    """Where the token at ``at`` starts, or one of the up to BEFORE tokens before it that lie within
    BEFORE_CHARS characters."""
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    least, back = max(0, start - BEFORE_CHARS), start
    for _ in range(BEFORE):
        while back > least and text[back - 1].isspace():
            back -= 1
        while back > least and not text[back - 1].isspace():
            back -= 1
        if back and not text[back - 1].isspace():
            break
        start = back
    return start


def _windows(text: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """Stretches, and whether the last MAX_SPAN - 1 tokens are looked at again by a later one."""
    hot = _HOT.search(text)
    while hot:
        tokens, quiet, end, near = [], 0, len(text), hot
        for m in _TOKEN.finditer(text, _start(text, hot.start())):
            tokens.append(m.span())
            if near and near.start() < m.start():
                near = _HOT.search(text, m.start())
            quiet = 0 if near and near.start() < m.end() else quiet + (m.start() >= hot.start())
            if quiet == 3 or len(tokens) == MAX_STRETCH:
                end = m.end() if quiet == 3 else tokens[-MAX_SPAN][1]
                break
        yield tokens, quiet < 3 and len(tokens) == MAX_STRETCH
        hot = near if near and near.start() >= end else _HOT.search(text, end)


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around everything that could be part of an entity."""
    return (tokens for tokens, _ in _windows(text))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in _TRAIL:
        end -= 1
    while start < end and text[start] in "\"'<[{":
        start += 1
    return start, end


_MAIL_WORDS = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s*[\[(]?(?:@|\bat\b)[\])]?\s*)[A-Za-z0-9-]+(?:\s*[\[(]?(?:\.|\bdot\b)[\])]?\s*[A-Za-z0-9-]+)+\Z", re.IGNORECASE)
_MORE = re.compile(r"[\[(]?(?:\.|dot\b)", re.IGNORECASE)
_SENTENCE = re.compile(r"\.\s+[A-Z]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]\Z")
_IPV4 = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_CUES = {"email": 0, "mail": 0, "e-mail": 0, "contact": 0, "ip": 1, "address": 1, "host": 1, "server": 1, "card": 2, "visa": 2,
         "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telefon": 3, "teléfono": 3, "téléphone": 3}


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Names of the features of the span of tokens i up to j; none if it cannot be an entity."""
    start, end = _trim(text, tokens[i][0], tokens[j - 1][1])
    span = text[start:end]
    if not span or "\n" in span or len(span) > 120:
        return []
    digits = _digits(span)
    mail, number = _MAIL_WORDS.match(span), _NUMBER.match(span)
    if not mail and (not number or len(digits) < 7):
        return []
    before = text[tokens[i - 1][0]:tokens[i - 1][1]].strip(_EDGE).lower() if i else ""
    out = ["bias", f"tokens={min(j - i, 5)}"]
    if mail:
        out += ["mail", f"sign={'@' in span}", f"dots={span.count('.') > 0}", f"sentence={bool(_SENTENCE.search(span))}",
                f"more={j < len(tokens) and bool(_MORE.match(text, tokens[j][0]))}"]
    if number:
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        out += ["number", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}", f"plus={span[0] == '+'}",
                f"brackets={'(' in span}", f"points={span.count('.')}", f"luhn={12 <= len(digits) <= 19 and luhn(digits)}",
                f"quad={bool(_IPV4.match(span)) and all(int(p) <= 255 for p in span.split('.'))}",
                f"even={len(set(groups[:-1])) <= 1 and len(groups) > 1}", f"last={groups[-1]}",
                f"cut={j < len(tokens) and bool(re.match('[0-9(+-]', text[tokens[j][0]:tokens[j][0] + 1]))}",
                f"joined={i > 0 and text[tokens[i - 1][1] - 1] in '0123456789-(+'}"]
    if before in _CUES:
        out.append(f"cue={_CUES[before]}")
    return out


def segments(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
    """By end, the possible segments that end there: (first token, features)."""
    out: list[list] = [[] for _ in range(len(tokens) + 1)]
    for j in range(1, len(tokens) + 1):
        for i in range(max(0, j - MAX_SPAN), j):
            if f := features(text, tokens, i, j):
                out[j].append((i, f))
    return out


Weights = dict[str, np.ndarray]


def decode(ends: list[list[tuple[int, list[str]]]], weights: Weights) -> list[tuple[int, int, int, float]]:
    """Best segmentation: (first token, end token, kind, score), by dynamic programming on ends.
    A token outside of segments scores 0."""
    best, back = [0.0], [None]
    for j in range(1, len(ends)):
        top, how = best[j - 1], None
        for i, names in ends[j]:
            score = _score(names, weights)
            k = int(score.argmax())
            if best[i] + score[k] > top:
                top, how = best[i] + score[k], (i, j, k, float(score[k]))
        best.append(top)
        back.append(how)
    out, j = [], len(ends) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = back[j][0]
    return out[::-1]


_NONE = np.zeros(len(KINDS))


def _score(names: list[str], weights: Weights) -> np.ndarray:
    total = _NONE
    for n in names:
        total = total + weights.get(n, _NONE)
    return total


def gradient(ends, truth: set[tuple[int, int, int]], weights: Weights) -> tuple[float, Weights]:
    """Log-likelihood of the true segments (first, end, kind) and its gradient, by forward and
    backward sums over all segmentations."""
    n = len(ends)
    ahead, scored = np.full(n, -np.inf), {}
    ahead[0] = 0.0
    for j in range(1, n):
        terms = [ahead[j - 1]]
        for i, names in ends[j]:
            scored[i, j] = s = _score(names, weights)
            terms.extend(ahead[i] + s)
        ahead[j] = np.logaddexp.reduce(terms)
    behind = np.full(n, -np.inf)
    behind[n - 1] = 0.0
    for j in range(n - 1, 0, -1):
        behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
        for i, _ in ends[j]:
            behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(scored[i, j]) + behind[j])
    grad: Weights = {}
    value = -ahead[n - 1]
    for j in range(1, n):
        for i, names in ends[j]:
            share = -np.exp(ahead[i] + scored[i, j] + behind[j] - ahead[n - 1])
            for k in range(len(KINDS)):
                if (i, j, k) in truth:
                    share[k] += 1
                    value += scored[i, j][k]
            for name in names:
                grad[name] = grad.get(name, _NONE) + share
    return float(value), grad


def _in_words(text: str, rng: random.Random) -> str:
    """A copy of a stretch in a notation that the patterns do not cover."""
    text = re.sub(r"\+([0-9]{1,3})[ ]?(?=[(0-9])", rng.choice(["", r"00\1 ", r"\1 "]), text)
    if rng.random() < 0.5:
        text = re.sub(r"(?<=\w)@(?=\w)", rng.choice([" at ", " [at] ", " (at) "]), text)
        text = re.sub(r"(?<=[a-z0-9])\.(?=[a-z]{2,})", rng.choice([".", " dot ", " [dot] "]), text)
    if rng.random() < 0.3:
        text = re.sub(r"\b([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})\b", r"\1 \2 \3 \4", text)
    return text


_EXTRA = (
    (0, re.compile(r"[A-Za-z0-9._%+-]+(?:@| at | \[at\] | \(at\) )[A-Za-z0-9-]+(?:(?:\.| dot | \[dot\] )[A-Za-z0-9-]+)+")),
    (3, re.compile(r"(?:00[0-9]{1,3} |[0-9]{1,3} )?\([0-9]{2,4}\) [0-9]{3}-[0-9]{4}")),
)


def _examples(texts: list[str], seed: int):
    """(segments, true segments) of stretches of the texts and of their copies in other notations."""
    rng, count = random.Random(seed), 0
    for text in texts:
        truth = base_spans(text)
        for tokens in stretches(text):
            low, high = tokens[0][0], tokens[-1][1]
            own = [(s, k, e) for s, k, e in truth if low <= s and e <= high]
            ends = segments(text, tokens)
            if any(ends):
                yield ends, _on_tokens(text, tokens, own)
                count += 1
            if own and count < TRAIN_STRETCHES:
                copy = _in_words(text[low:high], rng)
                spans = base_spans(copy)
                spans += [(m.start(), k, m.end()) for k, rx in _EXTRA for m in rx.finditer(copy)
                          if not any(s < m.end() and m.start() < e for s, _, e in spans)]
                again = [m.span() for m in _TOKEN.finditer(copy)]
                yield segments(copy, again), _on_tokens(copy, again, spans)
                count += 1
            if count >= TRAIN_STRETCHES:
                return


def _on_tokens(text, tokens, spans) -> set[tuple[int, int, int]]:
    first = {_trim(text, s, e)[0]: i for i, (s, e) in enumerate(tokens)}
    last = {_trim(text, s, e)[1]: i + 1 for i, (s, e) in enumerate(tokens)}
    placed, upto = set(), 0
    for s, k, e in sorted(spans):
        i, j = first.get(s), last.get(e)
        if i is not None and j is not None and upto <= i < j <= i + MAX_SPAN:
            placed.add((i, j, k))
            upto = j
    return placed


def train(texts: list[str], seed: int = 5, rate: float = 0.3, decay: float = 1e-3) -> Weights:
    """Weights by stochastic gradient ascent with per-feature rates (Adagrad)."""
    examples = [e for e in _examples(texts, seed)]
    if not any(truth for _, truth in examples):
        return {}
    weights: Weights = {}
    squares: Weights = {}
    rng = random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for ends, truth in examples:
            for name, g in gradient(ends, truth, weights)[1].items():
                g = g - decay * weights.get(name, _NONE)
                squares[name] = squares.get(name, _NONE) + g * g
                weights[name] = weights.get(name, _NONE) + rate * g / np.sqrt(squares[name] + 1e-6)
    return weights


def spans_of(text: str | None, weights: Weights) -> tuple[list, list]:
    """Base spans, and these with what the random field adds where no base span is."""
    if not text:
        return [], []
    base = base_spans(text)
    if not weights:
        return base, base
    found, taken, upto = list(base), [(s, e) for s, _, e in base], 0
    for tokens, again in _windows(text):
        ends = segments(text, tokens)
        if any(ends):
            for i, j, k, score in decode(ends, weights):
                if again and i > len(tokens) - MAX_SPAN:
                    break
                s, e = _trim(text, tokens[i][0], tokens[j - 1][1])
                if score >= MIN_GAIN and s >= upto and not any(a < e and s < b for a, b in taken):
                    found.append((s, k, e))
                    upto = e
    return base, sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are of base spans."""
    if weights is None:
        weights = fit(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                base, found = spans_of(text, weights)
                counts = [0] * len(KINDS)
                for _, k, _ in base:
                    counts[k] += 1
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, FOUND).withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def _piece(text: str) -> str:
    """Up to TRAIN_CHARS characters of the text, around its first base match."""
    found = base_spans(text) if len(text) > TRAIN_CHARS else []
    start = max(0, found[0][0] - TRAIN_CHARS // 2) if found and found[0][2] > TRAIN_CHARS else 0
    return text[start:start + TRAIN_CHARS]


def fit(docs: DataFrame) -> Weights:
    """Weights from at most TRAIN_DOCS texts with digits or signs, drawn by hash: half of them, and
    more if others are few, from those with a base match. Of a long text a piece around its first base
    match is learned from. These bound the sample, not what is searched."""
    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"h": frame["h"], "matched": [bool(base_spans(t)) for t in frame["text"]]})

    hashed = docs.where("text rlike '[0-9@]'").select(F.xxhash64("text").alias("h"), "text")
    marks = written(hashed.mapInPandas(mark, "h long, matched boolean").distinct(), "marks")
    drawn = {m: [r["h"] for r in marks.where(F.col("matched") == m).orderBy("h").limit(TRAIN_DOCS).select("h").collect()] for m in (True, False)}
    n = max(TRAIN_DOCS // 2, TRAIN_DOCS - len(drawn[False]))
    chosen = drawn[True][:n]
    chosen += drawn[False][:TRAIN_DOCS - len(chosen)]
    ids = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
    piece = F.udf(_piece, "string")
    some = hashed.join(F.broadcast(ids), "h", "left_semi").select("h", piece("text").alias("text")).distinct()
    # By hash again, so that texts with and without a match are mixed.
    return train([r["text"] for r in some.orderBy("h", "text").toLocalIterator()])


@query("op10_semi_markov_pii")
def op10(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))

"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (UTF-16 units), of order four: a text is three start marks, its units,
and an end mark. Character models need no vocabulary, judge any language and any length, and see
odd spelling, symbols and capitals. All digits are one symbol, as numbers say nothing of quality.
Four units are one 64-bit number, so all tables hold longs.

*Training* counts the four-grams of four in five trusted documents (a label with ``quality`` 1 and
``toxic`` 0; every fifth, by a hash of its id, is held out) in one pass that also notes the four-grams of all other documents. Lower orders count
distinct left neighbours. Each order has three discounts from its counts of counts, and each
context a weight for the next lower order; the lowest is mixed with a uniform distribution.

*Scoring* never takes the model to the documents. Documents are dealt into blocks of bounded text,
each block asks once for each of its distinct four-grams, and the requests are joined with the
sharded table of probabilities; the answers meet their block again, which sums up its documents.
What is asked for grows with the number of blocks, so with the input.

*Toxic documents* are good text with a few bad words, which hardly move a mean loss. Documents
labelled ``toxic`` 1 (four in five, likewise) are counted in the same pass and give a second model
over the same four-grams. A document's *excess* is the mean of log(((1 - t) p + t q) / p) over its
units, with p of the trusted, q of the toxic model and t = ``TOXIC_SHARE``: how much better the text
is explained as one with toxic parts. It is rejected above a limit that is found like those of the
loss. What no labelled toxic document has is not found; without such labels the excess is 0 and
nothing is rejected for it.

*Thresholds* on perplexity are an upper and a lower quantile of held-out documents, of (loss - median
of the language) * sqrt(units), as a mean over more units varies less: on held-out documents of
``sf0.1`` that spread is the same from 256 to 16,383 units. So every length has limits of its own
without classes, and long texts are not judged by the spread of short ones. Above lies text unlike the
trusted one, below lies text that is too predictable, such as repetition. A language with fewer than
``MIN_TRUSTED`` held-out documents takes the spread of all languages, and where held-out documents are
too few, limits come from all trusted ones; without any, nothing is rejected.

Defined results: a null or empty text has no perplexity and is rejected; a null lang is a language
of its own; repeated rows are scored alike; an empty table gives no rows; without trusted text all
documents with text are kept. A trusted id that occurs on several rows trains on each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, small_side, table, written

ORDER = 4
LOWER_QUANTILE, UPPER_QUANTILE = 0.001, 0.999
#: Room outside the quantiles, in nats per unit, and what short texts get on top, by the root of
#: their length.
MARGIN, SLACK = 0.02, 1.0
MIN_TRUSTED = 100
#: Languages with fewer held-out documents are centred at the median of all languages.
MIN_CENTRE = 10
HELD_OUT = 5
#: Share of toxic units in a toxic document, and the quantile of trusted ones above which one is rejected.
TOXIC_SHARE, TOXIC_QUANTILE = 0.1, 0.99
BLOCK_CHARS = 24_000_000
#: What a task works on at once, and the counts that it keeps before it hands them on.
COUNTED_CHARS, COUNTED_KEYS = 500_000, 200_000

#: An excess this far above its limit is not told from one at it.
ROUNDING = 1e-9
TRUSTED, TOXIC = 1, 2
_START, _END = "\x02" * (ORDER - 1), "\x03"


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-grams that end in a unit or end mark of the texts, and how many each text has."""
    coded = [(_START + t + _END).encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(c) // 2 - (ORDER - 1) for c in coded], dtype=np.int64)
    units = np.frombuffer(b"".join(coded), dtype="<u2").astype(np.uint64)
    units[(units >= 48) & (units <= 57)] = 48
    keys = units[3:] | (units[2:-1] << np.uint64(16)) | (units[1:-2] << np.uint64(32)) | (units[:-3] << np.uint64(48))
    # The three windows before each text but the first end in a start mark.
    keep = np.ones(len(keys), dtype=bool)
    ends = np.cumsum(sizes + ORDER - 1)[:-1]
    for i in range(ORDER - 1):
        keep[ends - (ORDER - 1) + i] = False
    return keys[keep].view(np.int64), sizes


def _added_up(parts: list[np.ndarray]) -> np.ndarray:
    """Columns (key, n, n_toxic) of several counts as one with distinct, sorted keys."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0])]
    firsts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
    return np.vstack((rows[0, firsts], np.add.reduceat(rows[1:], firsts, axis=1)))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct four-grams with their trusted and their toxic occurrences, of as much of a task's text
    as has ``COUNTED_KEYS`` of them."""
    held: list[np.ndarray] = []
    for frame in slices(frames, chars=COUNTED_CHARS):
        frame = frame[frame["text"].str.len() > 0]
        if not len(frame):
            continue
        keys, sizes = _grams(frame["text"].tolist())
        kind = np.repeat(frame["kind"].to_numpy(dtype=np.int64), sizes)
        held = [_added_up([*held, np.vstack((keys, kind == TRUSTED, kind == TOXIC))])]
        if held[0].shape[1] > COUNTED_KEYS:
            yield pd.DataFrame(held.pop().T, columns=["key", "n", "n_toxic"])
    if held:
        yield pd.DataFrame(held.pop().T, columns=["key", "n", "n_toxic"])


def gram_counts(docs: DataFrame, trusted: DataFrame, toxic: DataFrame | None = None) -> DataFrame:
    """(key, n, n_toxic): every four-gram of ``docs``, and how often trusted and toxic ids (doc_id),
    which have no id in common, have it."""
    known = trusted.select(F.col("doc_id").cast("long"), F.lit(TRUSTED).alias("kind"))
    if toxic is not None:
        known = known.union(toxic.select(F.col("doc_id").cast("long"), F.lit(TOXIC)))
    ids = small_side(written(known.distinct(), "trusted"))
    flagged = docs.select(F.col("doc_id").cast("long"), "text").where("length(text) > 0").join(
        ids, "doc_id", "left").select("text", F.coalesce("kind", F.lit(0)).alias("kind"))
    return flagged.mapInPandas(_count, "key long, n long, n_toxic long").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more; half a count where the counts of
    counts do not determine it."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(v if 0 < v < i else 0.5 for i, v in enumerate(d, 1))


def _suffix(key: Column | str, order: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < ORDER else F.col(key)


def _context(key: str) -> Column:
    return F.shiftrightunsigned(key, 16)


def _level_sums(level: DataFrame, kinds: list[str]) -> dict[str, tuple]:
    """Of each kind: how many n-grams occur one, two, three and four times, how many there are, and the sum."""
    found = level.agg(*(
        x for k in kinds for x in (
            *(F.count(F.when(F.col(k) == i, 1)) for i in (1, 2, 3, 4)), F.count(F.when(F.col(k) > 0, 1)), F.sum(k)))).first()
    return {k: found[6 * i:6 * i + 6] for i, k in enumerate(kinds)}


def _models(counts: DataFrame, kinds: list[str]) -> DataFrame | None:
    """(key, p_<kind>) for every key of ``counts`` under the model of each kind, a column of ``counts``, that
    has any; none if the first has none. The models go through the same joins, and what an order finds is
    written, as a plan of all orders takes the driver hundreds of megabytes, on the smallest table too."""
    grams = counts.where(" or ".join(f"{k} > 0" for k in kinds)).select(F.col("key").alias("gram"), *kinds)
    levels, sums = {}, {}
    for order in range(ORDER, 0, -1):
        levels[order] = grams = grams if order == ORDER else written(grams, f"grams{order}")
        sums[order] = _level_sums(grams, kinds)
        if order == ORDER:
            if not sums[ORDER][kinds[0]][4]:
                return None
            kinds = [k for k in kinds if sums[ORDER][k][4]]
        grams = grams.groupBy(_suffix("gram", order - 1).alias("gram")).agg(*(F.count(F.when(F.col(k) > 0, 1)).alias(k) for k in kinds))
    out = counts.select("key")
    for order in range(1, ORDER + 1):
        off = {}
        for k in kinds:
            d1, d2, d3 = discounts(*sums[order][k][:4])
            off[k] = F.when(F.col(k) == 0, 0.0).when(F.col(k) == 1, d1).when(F.col(k) == 2, d2).otherwise(d3)
        if order == 1:
            total = {k: sums[1][k][5] for k in kinds}
            weights = levels[1].agg(*(F.sum(off[k]) for k in kinds)).first()
            own = levels[1].select(F.col("gram").alias("g"), *(((F.col(k) - off[k]) / total[k]).alias(f"own_{k}") for k in kinds))
            out = out.withColumn("g", _suffix("key", 1)).join(own, "g", "left").select("key", *(
                (F.coalesce(f"own_{k}", F.lit(0.0)) + weights[i] / total[k] / (sums[1][k][4] + 1)).alias(f"p_{k}") for i, k in enumerate(kinds)))
            continue
        # A context that a kind does not have has no weight there, and no n-grams.
        context = written(levels[order].groupBy(_context("gram").alias("h")).agg(*(
            x for k in kinds for x in (F.sum(k).alias(f"total_{k}"), F.try_divide(F.sum(off[k]), F.sum(k)).alias(f"weight_{k}")))), f"contexts{order}")
        own = levels[order].withColumn("h", _context("gram")).join(context, "h").select(
            F.col("gram").alias("g"), *(F.try_divide(F.col(k) - off[k], F.col(f"total_{k}")).alias(f"own_{k}") for k in kinds))
        out = (
            out.withColumn("g", _suffix("key", order)).join(own, "g", "left")
            .withColumn("h", _context("g")).join(context.select("h", *(f"weight_{k}" for k in kinds)), "h", "left")
            .select("key", *((F.coalesce(f"own_{k}", F.lit(0.0)) + F.coalesce(f"weight_{k}", F.lit(1.0)) * F.col(f"p_{k}")).alias(f"p_{k}") for k in kinds))
        )
        if 1 < order < ORDER:
            out = written(out, f"probs{order}")
    return out


def log_probabilities(counts: DataFrame) -> DataFrame | None:
    """(key, logp) for every key of ``counts`` under the model of the counted ones."""
    probs = _models(counts, ["n"])
    return None if probs is None else probs.select("key", F.log("p_n").alias("logp"))


def with_excess(counts: DataFrame) -> DataFrame | None:
    """(key, logp, excess) for every key of ``counts``; the ``excess`` under the toxic counts is 0 without any."""
    probs = _models(counts, ["n", "n_toxic"])
    if probs is None:
        return None
    logp, mixed = F.log("p_n"), F.lit(0.0)
    if "p_n_toxic" in probs.columns:
        mixed = F.log(1 - TOXIC_SHARE + TOXIC_SHARE * F.exp(F.log("p_n_toxic") - logp))
    return probs.select("key", logp.alias("logp"), mixed.alias("excess"))


def _ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct four-grams of each block; a task holds whole blocks."""
    asked: dict[int, np.ndarray] = {}
    for frame in slices(frames, chars=COUNTED_CHARS):
        for block, own in frame.groupby("block"):
            keys = pd.unique(_grams(own["text"].tolist())[0])
            asked[block] = keys if block not in asked else pd.unique(np.concatenate((asked[block], keys)))
    for block, keys in asked.items():
        yield pd.DataFrame({"block": np.full(len(keys), block), "key": keys})


def _answer(key, docs: pd.DataFrame, probs: pd.DataFrame) -> pd.DataFrame:
    index = pd.Index(probs["key"].to_numpy())
    logp, excess = (probs[c].to_numpy(dtype=np.float64) for c in ("logp", "excess"))
    out = []
    for frame in slices(iter([docs]), chars=COUNTED_CHARS):
        keys, sizes = _grams(frame["text"].tolist())
        codes, distinct = pd.factorize(keys)
        at, starts = index.get_indexer(distinct), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        loss, more = (np.add.reduceat(x[at][codes], starts) / sizes for x in (-logp, excess))
        out.append(pd.DataFrame({"row": frame["row"].values, "n_units": sizes, "loss": loss, "excess": more}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "n_units": [], "loss": [], "excess": []})


def perplexities(docs: DataFrame, probs: DataFrame) -> DataFrame:
    """(row, n_units, loss, excess) of the documents (row, text): units with the end mark, and the means
    of -log p and of the excess, 0 if ``probs`` has none, over them. ``row`` is a string that the caller
    makes."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
    dealt = (
        docs.where("length(text) > 0")
        .select(F.pmod(F.xxhash64("row", "text"), F.lit(n)).alias("block"), "row", "text")
        .repartition(n, "block")
    )
    answers = dealt.mapInPandas(_ask, "block long, key long").join(probs, "key").select(
        "block", "key", F.col("logp").cast("float"),
        (F.col("excess") if "excess" in probs.columns else F.lit(0)).cast("float").alias("excess"))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _answer, "row string, n_units long, loss double, excess double")


def spread_limits(scored: DataFrame, good: DataFrame, value: str, quantiles: tuple[float, ...]) -> tuple[DataFrame, list[Column]]:
    """``scored`` joined with what its rows' languages have, and the columns of the limits on ``value``
    there: quantiles of (value - median of the language) * sqrt(n_units) over ``good``, put back to the
    row's own length. Without good rows the limits are null."""
    middle = F.percentile_approx(value, 0.5, 100_000)
    centres = good.groupBy("lang").agg(middle.alias("centre"), F.count("*").alias("n")).where(F.col("n") >= MIN_CENTRE)
    whole = good.agg(middle).first()[0]
    centres = centres.select(F.col("lang").alias("centre_lang"), "centre")
    centre = F.coalesce("centre", F.lit(whole).cast("double"))
    root = F.sqrt(F.greatest("n_units", F.lit(1)).cast("double"))
    spread = F.percentile_approx((F.col(value) - centre) * root, list(quantiles), 100_000)
    at_centre = good.join(centres, F.col("lang").eqNullSafe(F.col("centre_lang")), "left")
    total = at_centre.agg(spread).first()[0]
    own = at_centre.groupBy("lang").agg(F.first("centre").alias(f"{value}_centre"), spread.alias("own"), F.count("*").alias("n")).select(
        F.col("lang").alias(f"{value}_lang"), f"{value}_centre", F.when(F.col("n") >= MIN_TRUSTED, F.col("own")).alias(f"{value}_spread"))
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col(f"{value}_lang")), "left")
    spread = F.coalesce(f"{value}_spread", F.array(*map(F.lit, total)) if total else F.lit(None).cast("array<double>"))
    centre = F.coalesce(f"{value}_centre", F.lit(whole).cast("double"))
    return joined, [centre + spread[i] / root for i in range(len(quantiles))]


def text_mark(text: str) -> Column:
    return F.xxhash64(text)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, mark, lang, n_units, perplexity, least, most, excess, most_excess, kept) for every
    document; ``mark`` is ``text_mark`` of its text and tells rows with one doc_id apart."""
    named = docs.select(F.col("doc_id").cast("long"), "text", "lang", text_mark("text").alias("mark"))
    trusted = labels.groupBy(F.col("doc_id").cast("long")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    ).where("good and doc_id is not null").select("doc_id")
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD_OUT)) == 0
    counts = written(gram_counts(named, trusted.where(~held), toxic.where(~held)), "grams")
    probs = with_excess(counts)
    none = [F.lit(None).cast("double").alias(c) for c in ("loss", "excess")]
    empty = named.where("coalesce(length(text), 0) = 0").select(
        "doc_id", "mark", "lang", F.lit(0).cast("long").alias("n_units"), *none)
    if probs is None:
        full = named.where("length(text) > 0").select(
            "doc_id", "mark", "lang", (F.length("text") + 1).cast("long").alias("n_units"), *none)
        scored = full.unionByName(empty)
    else:
        # What identifies a row goes along as one string, so that null ids and languages survive.
        row = F.to_json(F.struct("doc_id", "mark", "lang"))
        found = perplexities(named.select(row.alias("row"), "text"), written(probs, "probs"))
        parsed = F.from_json("row", "doc_id long, mark long, lang string")
        scored = written(
            found.select(parsed.alias("r"), "n_units", "loss", "excess")
            .select("r.doc_id", "r.mark", "r.lang", "n_units", "loss", "excess")
            .unionByName(empty), "scored",
        )
    known = scored.where("loss is not null").join(trusted, "doc_id", "left_semi")
    good = known.where(held)
    base = good if good.count() >= MIN_TRUSTED else known
    joined, (least, most) = spread_limits(scored, base, "loss", (LOWER_QUANTILE, UPPER_QUANTILE))
    joined, (most_excess,) = spread_limits(joined, base, "excess", (TOXIC_QUANTILE,))
    room = MARGIN + SLACK / F.sqrt(F.greatest("n_units", F.lit(1)).cast("double"))
    low, high = least - room, most + room
    kept = (F.col("n_units") > 0) & F.coalesce(F.col("loss").between(low, high), F.lit(True)) & F.coalesce(
        F.col("excess") <= most_excess + ROUNDING, F.lit(True))
    return joined.select("doc_id", "mark", "lang", "n_units", F.exp("loss").alias("perplexity"), F.exp(low).alias("least"),
                         F.exp(high).alias("most"), "excess", most_excess.alias("most_excess"), kept.alias("kept"))


@query("op7_kneser_ney_quality")
def op7(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")

"""Spelling variants, tokenizer alignment and recurrent scoring against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sheaf.llm import QUERIES, alignment, recurrent, variants

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
CLASHES = "word n form near edit root block pos pair c rank codes id tokens model g words counts own".split()
ODD = [
    (None, None), (None, "without an id, twice the word without"), (1, None), (2, ""), (3, " \n\t "),
    (5, "the same row Twice same row"), (5, "the same row Twice same row"), (6, "l▁ower mark <|endoftext|> </s>"),
    (7, "\U0001f600 é à" * 50 + "\x00\x7f"), (8, "straße " * 3000), (9, " " * 7000 + "x" * 3000), (9007199254740993, "\nÀÉÎ÷×àéî straße strase"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


def odd(spark, rows=ODD):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHES})


# Spelling variants


def brute_variants(rows):
    counts = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if d is not None and h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: {w[:i] + w[i + 1:] for i in range(len(w))} & n.keys() for w in n}
    for w, shorter in list(near.items()):
        for s in shorter:
            near[s] = near[s] | {w}
    masks = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masks[i, w[:i], w[i + 1:]].add(w)
    for same in masks.values():
        for w in same:
            near[w] = near[w] | same - {w}
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants(spark, docs):
    expected = brute_variants(zip(docs["doc_id"].tolist(), docs["text"]))
    assert found(QUERIES["op11_bloom_spelling_variants"](spark, SF)) == expected
    assert any(f for f, *_ in expected.values())


def test_variants_in_many_passes(spark, monkeypatch):
    """A chain of forms, an accent, long words, and filters so small that lengths are split into parts."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcé"), size=int(rng.integers(5, 9)))) for _ in range(3000)}
    text = " ".join(w for i, w in enumerate(sorted(words)) for _ in range(3 + i % 5))
    text += " chaine" * 3 + " chaines" * 6 + " chainés" * 12 + f" {'q' * 60}" * 3 + f" {'q' * 59}" * 9
    rows = [(None, text), (None, "Chaines"), (4, None)]
    monkeypatch.setattr(variants, "FILTER_BYTES", 700)
    sizes = collections.Counter(min(len(w), variants.LONGEST) for w in brute_variants(rows))
    assert len(variants.passes(sizes)) > 5
    got = found(variants.spelling_variants(odd(spark, rows)))
    assert got == brute_variants(rows)
    assert got["chaine"][:2] == ("chaines", "chaines") or got["chaine"][1] == "chainés"
    assert got["q" * 60][0] == "q" * 59


def test_hashes_of_edits():
    """Sums give each edit the hash of the word that it makes."""
    own = variants.Words(["straße", "aab", "x" * 50])
    letters = np.array([ord(c) for c in "abz"], dtype=np.uint64)
    for at, new, h in [(*own.replacements(letters, 0, len(own.letter)),), (own.deletions()[0], None, own.deletions()[1])]:
        for j, i in enumerate(at):
            word, place = ["straße", "aab", "x" * 50][own.word[i]], own.place[i]
            made = word[:place] + ("" if new is None else chr(int(new[j]))) + word[place + 1:]
            assert variants.Words([made]).hashes()[0] == h[j]


def test_variants_of_odd_rows(spark):
    assert found(variants.spelling_variants(odd(spark))) == brute_variants(ODD)
    assert variants.spelling_variants(odd(spark, [])).count() == 0


# Alignment


def brute_alignment(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(alignment.A_FILE)
    model.encode_special_tokens = True
    a, b = alignment.ByteLevel(alignment.A_FILE), alignment.Pieces(alignment.B_FILE)
    out, pair_docs = [], collections.Counter()
    for d, text in rows:
        ids_a = model.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.model.encode(text) if text else []
        if not text or not (b"".join(a.bytes[i] for i in ids_a) == (" " + text).encode() == b"".join(b.bytes[i] for i in ids_b)):
            out.append((d, [], [], []))
            continue
        ends = [list(np.cumsum([len(t.bytes[i]) for i in ids])) for t, ids in ((a, ids_a), (b, ids_b))]
        groups = {}
        for side, (ids, own) in enumerate(zip((ids_a, ids_b), ends)):
            cuts = sorted(set(ends[0]) & set(ends[1]))
            for i, end in zip(ids, own):
                groups.setdefault(cuts[np.searchsorted(cuts, end)], ([], []))[side].append(i)
        groups = [groups[k] for k in sorted(groups)]
        out.append((d, ids_a, ids_b, groups))
        pair_docs.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = collections.Counter()
    for (x, _), n in pair_docs.items():
        most[x] = max(most[x], n)
    result = []
    for d, ids_a, ids_b, groups in out:
        linked = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((d, len(ids_a), len(ids_b), len(groups), len(linked), sum(pair_docs[p] == most[p[0]] for p in linked),
                       sum(pair_docs[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(result, key=str)


def aligned(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment(spark, docs):
    assert aligned(QUERIES["op12_lockstep_alignment"](spark, SF)) == brute_alignment(zip(docs["doc_id"].tolist(), docs["text"]))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_odd_rows(spark, monkeypatch, small):
    """With small numbers too, so that blocks, lanes and wide groups all occur."""
    if small:
        for name, value in {"WIDE": 2, "LANE_TOKENS": 5, "LANE_TRIES": 2, "BLOCK_CHARS": 30, "BATCH_CHARS": 60}.items():
            monkeypatch.setattr(alignment, name, value)
    rows = [*ODD, (10, "antidisestablishmentarianism Donaudampfschifffahrt " * 40)]
    got = aligned(alignment.align_documents(odd(spark, rows)))
    assert got == brute_alignment(rows)
    assert sum(r[1] > 0 for r in got) >= 6 and ("6", 0) in {(str(r[0]), r[1]) for r in got}
    assert alignment.align_documents(odd(spark, [])).count() == 0


def test_lockstep_of_made_up_ends():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 9)
    for _ in range(30):
        docs_a, docs_b = [], []
        for n in rng.integers(1, 3000, size=5):
            for docs in (docs_a, docs_b):
                cut = np.unique(np.append(rng.integers(1, n + 1, size=int(rng.integers(n // 4, n + 1))), [*range(8, n, 8), n]))
                docs.append((np.diff(cut, prepend=0) - 1).tolist())
        a, b = alignment.Tokens(docs_a, sizes), alignment.Tokens(docs_b, sizes)
        groups = alignment.lockstep(a, b)
        common = np.intersect1d(a.ends, b.ends)
        assert (a.ends[groups[:, 1] - 1] == common).all() and (b.ends[groups[:, 3] - 1] == common).all()
        assert (groups[1:, [0, 2]] == groups[:-1, [1, 3]]).all() and not groups[0, [0, 2]].any()


# Recurrent scoring


def brute_base(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    counts = collections.Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws), 6))
            for (d, _), h, ws in zip(rows, held, tokens)]


def scored(df):
    rows = df.collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]


def test_base_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "BLOCK_CHARS", 20)
    rows = [*ODD, (16, "held out Words")]
    assert sorted(scored(recurrent.score_documents(odd(spark, rows))), key=str) == sorted(brute_base(rows), key=str)
    assert recurrent.score_documents(odd(spark, [])).count() == 0
    alone = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2 and r[0]]
    assert alone and scored(recurrent.score_documents(odd(spark, alone))) == brute_base(alone)


def test_scores(spark):
    """Held-out texts are likelier than under counts alone, and likelier than with their words in another order."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = recurrent.score_documents(df).collect()
    expected = {r[0]: r for r in brute_base([tuple(r) for r in df.collect()])}
    for r in rows:
        *same, base = expected[r["doc_id"]]
        assert [r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == same and abs(r["base_score"] - base) < 1e-5
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def small_model(seed=0):
    classes = recurrent.Classes(100, 40, 10, [9] * 40, {(1, 0): (5, 5), (1, 3): (7, 4), (2, 0): (8, 1)})
    rng = np.random.default_rng(seed)
    weights = {k: (v + rng.normal(0, 0.1, v.shape) * (v > -60)).astype(np.float64) for k, v in recurrent.initial(classes).items()}
    return classes, recurrent.Model(weights, classes.n_head, classes.n_classes)


def test_probabilities_sum_to_one():
    classes, model = small_model()
    start = [3, 44, 0]
    total = sum(math.exp(model.log_likelihoods([np.array([*start, c])])[0] - model.log_likelihoods([np.array(start)])[0]) for c in range(classes.n_codes))
    assert abs(total - 1) < 1e-5


def test_state_is_carried_across_windows(monkeypatch):
    """A document's likelihood is the same in windows of any width, and beside any other documents."""
    classes, model = small_model()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, classes.n_codes, size=n) for n in (1, 2, 150, 31, 60)]
    one_by_one = [model.log_likelihoods([d])[0] for d in docs]
    assert np.allclose(model.log_likelihoods(docs), one_by_one, atol=1e-4)
    windows = recurrent.Lanes.windows
    monkeypatch.setattr(recurrent.Lanes, "windows", lambda self: windows(self, 1000))
    assert np.allclose(model.log_likelihoods(docs), one_by_one, atol=1e-4)


def test_gradients(monkeypatch):
    """Backpropagation against differences, in windows that hold whole documents."""
    classes, model = small_model()
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, classes.n_codes, size=n) for n in (5, 7, 4)]
    monkeypatch.setattr(recurrent, "CLIP", 1e9)
    grads = {k: np.zeros(v.shape) for k, v in model.m.items()}

    def noted(name, grad, at=slice(None)):
        grads[name][at] += grad * recurrent.LANES * recurrent.WINDOW

    monkeypatch.setattr(model, "_step", noted)
    model.learn(docs)
    for name, weights in model.m.items():
        for i in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            loss = []
            for step in (1e-3, -1e-3):
                weights.ravel()[i] += step
                loss.append(-model.log_likelihoods(docs).sum())
                weights.ravel()[i] -= step
            assert abs(grads[name].ravel()[i] - (loss[0] - loss[1]) / 2e-3) < 1e-2 * abs(grads[name].ravel()[i]) + 1e-4

"""The operators against brute force, exact round trips and held-out rows."""

import collections
import hashlib
import html as markup
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import CHECKS, QUERIES, lm_quality, near_dedup, packing, personal_data, quality_rules, secrets, tiff, warc, wrapper
from workload.check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(CHECKS[name]).df()) is None


def components(docs):
    """By an inverted index of whole shingles and a union of all linked pairs."""
    sets = {d: near_dedup.shingles_of(t) for d, t in zip(docs["doc_id"], docs["text"])}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    pairs = {p for ds in holders.values() for p in itertools.combinations(sorted(ds), 2)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, docs):
    got = QUERIES["op8_minhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs)


def test_near_copies_of_a_common_origin(spark):
    """Copies that are linked to their origin only, and some to nothing: all pairs are decided."""
    rng = np.random.default_rng(5)
    origin = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(origin))]
    for i in range(1, 150):
        words = list(origin)
        for at in rng.choice(120, size=int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {d: c for d, (_, c) in components(df.toPandas()).items()}
    assert len(set(got.values())) > 1


def test_pruning_bounds():
    needed = near_dedup.least_matches(0.75, 1e-6, 128, 16)
    for n, m in zip(range(16, 129, 16), needed):
        grid = np.linspace(0, 1, 200_001)
        post = lambda k: grid**k * (1 - grid) ** (n - k)
        tail = lambda k: post(k)[grid >= 0.75].sum() / post(k).sum()
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def kneser_ney(texts, n=4):
    """Straight from the definition, with dictionaries."""
    counts = collections.Counter()
    for t in texts:
        padded = "\x02" * (n - 1) + t + "\x03"
        counts.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    levels = {n: counts}
    for order in range(n - 1, 0, -1):
        levels[order] = collections.Counter(g[1:] for g in levels[order + 1])
    offs = {o: lm_quality.discounts(*(sum(c == i for c in levels[o].values()) for i in (1, 2, 3, 4))) for o in levels}
    contexts = {o: collections.defaultdict(list) for o in levels}
    for o in levels:
        for g, c in levels[o].items():
            contexts[o][g[:-1]].append(c)

    def p(gram):
        o = len(gram)
        if not o:
            return 1 / (len(levels[1]) + 1)
        seen = contexts[o].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        off = lambda c: offs[o][min(c, 3) - 1] if c else 0
        c = levels[o][gram]
        return (c - off(c) + sum(map(off, seen)) * p(gram[1:])) / sum(seen)

    return p


def test_kneser_ney(spark, docs):
    some = docs.head(30).assign(text=docs["text"].head(30).str.replace("[0-9]", "0", regex=True))
    df = spark.createDataFrame([(int(d), t) for d, t in zip(some["doc_id"], some["text"])], "doc_id long, text string")
    trusted = df.where("doc_id % 2 = 0").select("doc_id")
    probs = lm_quality.log_probabilities(lm_quality.gram_counts(df, trusted))
    p = kneser_ney([t for d, t in zip(some["doc_id"], some["text"]) if d % 2 == 0])
    found = {r["row"]: r for r in lm_quality.perplexities(df.select(F.col("doc_id").cast("string").alias("row"), "text"), probs).collect()}
    for d, t in zip(some["doc_id"], some["text"]):
        padded = "\x02" * 3 + t + "\x03"
        want = -sum(math.log(p(padded[i:i + 4])) for i in range(len(padded) - 3)) / (len(padded) - 3)
        assert found[str(d)]["n_units"] == len(t) + 1 and abs(found[str(d)]["loss"] - want) < 1e-5
    known = {c for d, t in zip(some["doc_id"], some["text"]) if d % 2 == 0 for c in t}
    total = sum(p("th" + c) for c in known | {"\x03"})
    assert total <= 1 + 1e-9


def test_both_models_go_through_the_same_joins(spark, docs):
    """A plan with the joins of two models and all orders took the driver more memory than its budget, on the smallest table too."""
    some = docs.head(60)
    df = spark.createDataFrame([(int(d), t) for d, t in zip(some["doc_id"], some["text"])], "doc_id long, text string")
    counts = lm_quality.written(lm_quality.gram_counts(
        df, df.where("doc_id % 3 = 0").select("doc_id"), df.where("doc_id % 3 = 1").select("doc_id")), "grams")
    found = lm_quality.with_excess(counts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and "Aggregate" not in plan
    toxic = lm_quality.log_probabilities(counts.select("key", F.col("n_toxic").alias("n"))).withColumnRenamed("logp", "toxic")
    alone = lm_quality.log_probabilities(counts).withColumnRenamed("logp", "alone")
    got = found.join(alone, "key").join(toxic, "key").toPandas()
    t = lm_quality.TOXIC_SHARE
    want = np.log(1 - t + t * np.exp(got["toxic"] - got["alone"]))
    assert len(got) == counts.count() and np.allclose(got["logp"], got["alone"], rtol=1e-12) and np.allclose(got["excess"], want, atol=1e-12)
    assert lm_quality.with_excess(counts.withColumn("n", F.lit(0).cast("long"))) is None
    none = lm_quality.with_excess(counts.withColumn("n_toxic", F.lit(0).cast("long"))).agg(F.min("excess"), F.max("excess")).first()
    assert tuple(none) == (0.0, 0.0)


def test_quality_keeps_trusted_kinds(spark):
    got = QUERIES["op7_kneser_ney_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    kept = got[got["toxic"] == 0].groupby("quality")["kept"].mean()
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_quality_rejects_toxic_documents(spark):
    """Most toxic documents of good quality go, also of those held out, and clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(lm_quality.HELD_OUT)) == 0
    got = lm_quality.judge(docs, labels).join(labels, "doc_id").where("quality = 1").withColumn("held", held).toPandas()
    kept = got.groupby("toxic")["kept"].mean()
    assert kept[0] > 0.985 and kept[1] < 0.1
    assert got[got["held"]].groupby("toxic")["kept"].mean()[1] < 0.3


def test_quality_limits_of_long_documents(spark):
    """Few held-out documents are as long; perplexity alone tells the poor ones all the same."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = lm_quality.judge(docs, labels).join(labels, "doc_id").where("n_units >= 4096 and toxic = 0").toPandas()
    inside = got["perplexity"].between(got["least"], got["most"]).groupby(got["quality"]).mean()
    assert inside[0] < 0.1 and inside[1] > 0.99


def test_rules_counts(spark, docs):
    got = QUERIES["op3_distribution_divergence"](spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        row = got.loc[d]
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (row["kept"] and row["base_failed"])


def test_jensen_shannon(spark):
    rng = np.random.default_rng(1)
    p, q = rng.dirichlet([1] * 5), np.array([0.5, 0, 0.25, 0.25, 0])
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>").select(quality_rules.distance("p", "q")).first()[0]
    assert abs(got - math.sqrt((part(p) + part(q)) / 2)) < 1e-12


BASE = [
    (0, re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (1, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    (2, re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= sum(map(str.isdigit, m)) <= 19 and luhn(m)),
    (3, re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(map(str.isdigit, m)) <= 15),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def test_base_spans(docs):
    odd = ["a@b.c@d.e x@@y.z @a.b ..@x-y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111-1111 1111 1111 and 4111111111111112",
           "+1 (555) 123-4567+49 30 123456", "+1 " + "2" * 40, "+-1 +12 +1 2", "", "@", "é@b.c"]
    for text in [*docs["text"], *odd]:
        want = sorted((m.start(), k, m.end()) for k, rx, ok in BASE for m in rx.finditer(text) if ok(m[0]))
        assert personal_data.base_spans(text) == want


def test_random_field(docs):
    weights = personal_data.train(docs["text"].tolist() * 3)
    assert weights
    for text, want in [("call (555) 123-4567 now", "phone:5:19"), ("at 10:30 on 2024-01-01 we met 123 people", ""), ("plain words only", "")]:
        assert personal_data._joined(personal_data.spans_of(text, weights)[1]) == want
    for text in docs["text"]:
        base, found = personal_data.spans_of(text, weights)
        assert set(base) <= set(found)


def test_stretches_reach_every_token(docs):
    """Whatever the white space, however long what stands before, and across the cut of a window."""
    weights = personal_data.train(docs["text"].tolist() * 3)
    phone = "(555) 123-4567"
    for sep in "\n\t ":
        for text in [sep.join([*(["word"] * 1000), "call", phone, "now"]), sep.join([*map(str, range(1000)), "call", phone, "now"])]:
            at = text.index(phone)
            assert (at, 3, at + len(phone)) in personal_data.spans_of(text, weights)[1]
    for before in ("-" * 100 + "\n", "http://x.org/" + "a" * 100 + " ", "word\n" * 1000 + "-" * 90 + "\n"):
        text = before + "call " + phone + " now"
        assert (len(before) + 5, 3, len(text) - 4) in personal_data.spans_of(text, weights)[1]
    for shift in range(20):
        text = " ".join([*(["7"] * (380 + shift)), "call", phone, "now"])
        at = text.index(phone)
        assert (at, 3, at + len(phone)) in personal_data.spans_of(text, weights)[1]


def test_worded_addresses_are_decoded(spark, docs):
    """Without digits and signs in the text, in any case; and the field is on while matches are rare."""
    weights = personal_data.train(docs["text"].tolist() * 3)
    for mail in ("john at example.com", "john [AT] example [DOT] com", "jane AT mail DOT org", "jane (at) mail dot org"):
        text = f"please contact {mail} for more"
        assert (15, 0, 15 + len(mail)) in personal_data.spans_of(text, weights)[1], mail
    assert not personal_data.spans_of("We met at noon. Then we left.", weights)[1]
    rows = [(i, f"chapter {i} of many") for i in range(4000)] + [(5000, "x " * 15000 + "write to ann@example.org or +1 555 123 4567 today")]
    assert personal_data.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_field_is_exact():
    """Decoding and the gradient against all segmentations of a short stretch."""
    rng = np.random.default_rng(3)
    ends = [[] for _ in range(6)]
    for i, j in [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (1, 2), (4, 5)]:
        ends[j].append((i, [f"f{i}{j}", "bias"]))
    weights = {n: rng.normal(size=4) for e in ends for _, names in e for n in names}

    def all_of(at):
        if at == 5:
            yield []
            return
        yield from all_of(at + 1)
        for j in range(at + 1, 6):
            for i, names in ends[j]:
                if i == at:
                    for k in range(4):
                        for rest in all_of(j):
                            yield [(i, j, k), *rest]

    names_of = {(i, j): names for j, e in enumerate(ends) for i, names in e}
    score = lambda s: sum(personal_data._score(names_of[i, j], weights)[k] for i, j, k in s)
    every = list(all_of(0))
    best = max(every, key=score)
    assert [x[:3] for x in personal_data.decode(ends, weights)] == best
    truth = {(0, 2, 1), (2, 4, 3)}
    value, grad = personal_data.gradient(ends, truth, weights)
    z = math.log(sum(math.exp(score(s)) for s in every))
    assert abs(value - (score([(0, 2, 1), (2, 4, 3)]) - z)) < 1e-9
    expected = sum(math.exp(score(s) - z) * sum((i, j, k) == (0, 1, 2) for i, j, k in s) for s in every)
    assert abs(grad["f01"][2] + expected) < 1e-9


def test_secrets(spark):
    larger = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{larger}/documents.parquet")
    docs = table.toPandas()
    got = QUERIES["op5_secret_forest"](spark, larger).toPandas().set_index("doc_id")["spans"]
    found = 0
    for d, t in zip(docs["doc_id"], docs["text"]):
        spans = [tuple(map(int, s.split(":"))) for s in got[d].split(",") if s]
        for m in re.finditer(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}", t):
            assert m.span() in spans
            found += 1
        assert all(re.fullmatch(r"[A-Za-z0-9+/=_-]+|-----.*", t[a:b], re.DOTALL) for a, b in spans)
    assert found
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(table).collect()}
    for d, t in zip(docs["doc_id"], docs["text"]):
        at, out = 0, []
        for a, b in ([tuple(map(int, s.split(":"))) for s in got[d].split(",") if s]):
            out += [t[at:a], secrets.MASK]
            at = b
        assert redacted[d] == "".join([*out, t[at:]])


def test_forest_on_held_out_findings(spark):
    rng = np.random.default_rng(2)
    word = lambda n, a: "".join(rng.choice(list(a), n))
    rows = []
    for _ in range(300):
        rows.append((word(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789"), "api_key = '", "'", 1))
        rows.append(("/static/images/header-logo-2x" + word(2, "0123456789"), "src=", " ", 0))
    df = spark.createDataFrame(rows, "c string, b string, a string, label int")
    model = secrets.train(df.limit(400).select(secrets.features(F.struct("c", "b", "a")).alias("f"), "label"))
    held = df.subtract(df.limit(400)).select(secrets.features(F.struct("c", "b", "a")).alias("f"), "label")
    assert held.where(secrets.verdict(model, "f") == (F.col("label") == 1)).count() > 0.97 * held.count()


@pytest.mark.parametrize("lengths", [(16,), (8, 16, 64), packing.LENGTHS])
def test_packing(lengths):
    rng = np.random.default_rng(4)
    sizes = sorted(map(int, rng.integers(1, max(lengths) + 1, size=700)), reverse=True)
    where, offsets, final = packing.pack(sizes, lengths, 1)
    inside = collections.defaultdict(list)
    for b, at, size in zip(where, offsets, sizes):
        inside[b].append((at, size))
    for b, own in inside.items():
        end = 0
        for at, size in sorted(own):
            assert at == end
            end += size
        assert final[b] == min(x for x in lengths if x >= end)
    assert sum(final) < 1.12 * sum(sizes) and sorted(inside) == list(range(len(final)))


def test_packed_documents(spark, docs):
    got = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), lengths=(64, 128, 256), block_rows=50).toPandas()
    total = got.groupby("doc_id")["size"].sum()
    assert {d: len(t.split()) for d, t in zip(docs["doc_id"], docs["text"])} == total.to_dict()
    for _, own in got.groupby("bin"):
        own = own.sort_values("offset")
        assert (own["offset"].tolist() == [0, *own["size"].cumsum()][:-1]) and own["size"].sum() <= own["bin_length"].iloc[0]


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, 16, 64])
def test_tiff(compression, predictor, order, tile):
    rng = np.random.default_rng(6)
    pages = [rng.integers(0, high, size=(h, w), dtype=np.uint8) for h, w, high in ((1, 1, 255), (300, 77, 3), (513, 64, 200), (20, 400, 2))]
    data = tiff.write_tiff(pages, compression, predictor, order, tile)
    got = list(tiff.pages_of(data))
    assert len(got) == len(pages)
    for (page, samples, kind, error), want in zip(got, pages):
        assert error is None and kind == compression and (samples[:, :, 0] == want).all()
    for cut in (0, 4, 7, len(data) // 2, len(data) - 3):
        for *_, error in tiff.pages_of(data[:cut]):
            assert error is None or isinstance(error, str)


def test_tiff_query(spark, docs):
    got = QUERIES["op2_tiff_pages"](spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"]):
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        row = got.loc[d]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert (row["payload_sha256"], row["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_main_text(spark):
    got = {r["page_id"]: r["text"] for r in QUERIES["op1_wrapper_induction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1]
        inner = re.sub(r"<[a-z/][^>]*\Z", "", inner)
        blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_wrapper_without_article(spark):
    """Menus, notices and comments go by name, constants by counts over all pages, links by share.
    The rules alone leave the constants in."""
    def page(i):
        body = "".join(f"<p>Paragraph {j} of story {i} with enough words to be content.</p>" for j in range(3 + i % 2))
        links = "".join(f"<li><a href='/{i}{j}'>story {i} {j}</a></li>" for j in range(5))
        other = "<div class=gallery><p>Pictures</p></div>" if i % 4 == 3 else ""
        return (f"<html><body><div id=top-menu><a href=/>home</a></div><div class=story><h2>Title {i}</h2>"
                f"<p>Read our paper every day.</p>{body}{other}<ul>{links}</ul><div class='comments'><p>I disagree {i}</p></div></div>"
                f"<div class=right><p>Weather</p></div></body></html>")

    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    for r in wrapper.extract_pages(pages).collect():
        i = r["page_id"]
        lines = [f"Title {i}", *(f"Paragraph {j} of story {i} with enough words to be content." for j in range(3 + i % 2))]
        assert r["text"].split("\n") == lines
        assert "Read our paper every day." in wrapper.extract(page(i), None).split("\n")


def test_wrapper_keeps_near_copies_and_references(spark):
    """Copies are no template; lists of links and speaking names stay in an article; its adverts go."""
    lines = [f"Line {j} of the only story here." for j in range(4)]
    copies = [(i, "http://c/", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + f"<p>{i}</p></body>") for i in range(5)]
    links = "".join(f"<li><a href='/{j}'>Source number {j}</a></li>" for j in range(4))
    article = (f"<article><h1>T</h1><p>One.</p><div class=legal-analysis><p>Two.</p></div><ul>{links}</ul><math>x</math>"
               "<div class='ad-box'>Buy</div><div class=comments>No!</div></article><div class=legal-notes>Imprint</div>")
    rows = [*copies, *((10 + i, "http://a/", article) for i in range(4))]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].split("\n") == [*lines, str(i)]
    assert got[10] == "\n".join(["T", "One.", "Two.", *(f"Source number {j}" for j in range(4)), "x"])


def test_wrapper_deep_and_wide_pages(spark):
    deep = "<div>" * 10_000 + "<p>bottom</p>" + "<div class=ad>no</div>" + "</div>" * 10_000 + "<p>end</p>"
    wide = "".join(f"<div class=c{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}>{j}</div>" for j in range(400))
    rows = [(i, f"http://{'dw'[i % 2]}/", [deep, wide][i % 2]) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "bottom\nend" and got[1] == "\n".join(map(str, range(400)))


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}</p>\r\n\r\nWARC/1.1") for i in range(20)]
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.resolve_revisits(warc.records_of(pages)), path)
    read = warc.read_archives(spark, path).collect()
    full = {r["id"]: bytes(r["payload"]).decode() for r in read if r["type"] == "response"}
    assert full == {i: h for i, _, h in rows[17:]}
    assert all(r["digest"] == r["payload_digest"] for r in read if r["type"] == "response")
    assert {r["id"]: r["refers_to"] for r in read if r["type"] == "revisit"} == {i: 17 + (i - 17) % 3 for i in range(17)}
    # Archives that hold revisits already: the response keeps its payload, the rest refers to it.
    again = warc.resolve_revisits(spark.createDataFrame(
        [(r["id"], r["uri"], r["digest"], r["payload_bytes"], bytes(r["payload"]).decode() if r["payload"] else None) for r in read],
        "id long, uri string, digest string, payload_bytes long, payload string"))
    assert {(r["id"], r["type"]) for r in again.collect()} == {(r["id"], r["type"]) for r in read}


def test_secrets_by_context(spark):
    """Short values, values with signs and passwords of URLs are candidates; prose is none of their kind."""
    planted = ["Tr0ub4dor&3x", "hunter2pass", "QwErTyUiOpAsDfGhJkLzXcVb", "Zk8$uQ!9", "abc12345"]
    texts = [f"password={planted[0]}", f"see postgres://user:{planted[1]}@db/x", f"api_key: '{planted[2]}'",
             f'secret = "{planted[3]}"', f"pwd=abc12345.", "the secret is out: nobody, http://a.b:80/x@y knows", "time: 10:30", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: [x["c"] for x in r["found"]] for r in frame.select("doc_id", secrets.candidates(F.col("text")).alias("found")).collect()}
    assert [found[i] for i in range(5)] == [[p] for p in planted] and not any(found[i] for i in range(5, 9))
    told = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame).collect()}
    assert told[0] == "9:21" and told[2] and told[3] and told[4] == "4:12" and told[1] and not any(told[i] for i in range(5, 9))

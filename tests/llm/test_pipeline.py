"""The pipeline, stage by stage, on a small table."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sheaf.llm import near_dedup
from sheaf.llm.common import QUERIES, new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and names["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(QUERIES) <= set(names)


def test_quality_and_near_copies(spark, stages):
    raw, good, single, *_ = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = set(labels.loc[(labels["quality"] == 1) & (labels["toxic"] == 0), "doc_id"])
    assert len(clean - set(good["doc_id"])) <= 0.02 * len(clean)
    assert set(good["doc_id"]) <= set(raw["doc_id"]) and 0 < len(good) < len(raw)
    sets = {d: near_dedup.shingles_of(t) for d, t in zip(good["doc_id"], good["text"])}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) > 0

    kept = sorted(single["doc_id"])
    assert not any(linked(a, b) for i, a in enumerate(kept) for b in kept[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert kept == sorted({find(d) for d in ids})


def test_secrets_mixing_packing(stages):
    *_, single, hidden, mixed, packed = stages
    assert list(hidden["doc_id"].sort_values()) == list(single["doc_id"].sort_values())
    assert (hidden["n_chars"] == hidden["text"].str.len()).all()
    times = mixed.groupby("doc_id").size()
    assert times.max() <= 3 and set(mixed["doc_id"]) <= set(hidden["doc_id"])
    words = lambda df: df["text"].str.split().str.len().sum()
    assert abs(words(mixed) - words(hidden)) <= hidden["text"].str.split().str.len().max()
    total = collections.Counter()
    for d, t in zip(mixed["doc_id"], mixed["text"]):
        total[d] += len(t.split())
    assert packed.groupby("doc_id")["size"].sum().to_dict() == dict(total)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import lm_quality, mixing, near_dedup, packing, personal_data, quality_rules, secrets, tiff, warc, wrapper

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (None, None, None, None, None),
    (None, "a text without an id, but with words", "en", "s", 3),
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "s", 4),
    (4, LONG, "en", "s", len(LONG)),
    (5, "the same row twice, five or more words", "en", "t", 38),
    (5, "the same row twice, five or more words", "en", "t", 38),
    (6, "a tie of equal size and five words", "xx", "t", 34),
    (7, "a tie of equal size and five words", "xx", "u", 34),
    (9007199254740993, "password=45ac953709720d07d9 \U0001f600 é", "de", "u", 31),
]
#: Names that the operators use themselves.
CLASHES = "row mark key size block node n text_b hub component trusted found turn taken id piece words loss value __found".split()


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def labels(spark, rows=((5, 1, 0), (5, 1, 0), (4, 1, None), (None, 1, 0), (1, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "near_dedup": near_dedup.near_duplicates,
    "packing": packing.pack_documents,
    "secrets": secrets.find_secrets,
    "mixing": mixing.mix_sources,
    "quality_rules": quality_rules.rate_documents,
    "personal_data": personal_data.find_personal_data,
    "tiff": lambda docs: tiff.read_pages(tiff.store_texts(docs)),
    "lm_quality": lambda docs: lm_quality.judge(docs, labels(docs.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](documents(spark)).collect()
    assert len({r["doc_id"] for r in got if "doc_id" in r.asDict()} - {r[0] for r in ROWS}) == 0
    if name == "packing":
        assert sum(r["size"] for r in got) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    else:
        assert len(got) == len(ROWS)
    if name == "near_dedup":
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
        assert sorted(by[None]) == [(0, None, True), (4, None, True)]
        assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
        assert by[5] == [(4, 5, True)] * 2 and by[7] == [(4, 6, False)] and by[6] == [(4, 6, True)]
    if name == "lm_quality":
        kept = {(r["doc_id"], r["n_units"]): r["kept"] for r in got}
        assert not kept[1, 0] and not kept[2, 0] and not kept[None, 0]
        assert kept[5, 39]
    if name == "secrets":
        assert {r["doc_id"]: (r["n_secrets"], r["spans"]) for r in got}[9007199254740993] == (1, "9:27")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


def test_no_trusted_text(spark):
    got = lm_quality.judge(documents(spark), labels(spark, [])).collect()
    assert all(r["kept"] == bool(r["n_units"]) for r in got) and len(got) == len(ROWS)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in CLASHES})


PAGES = [(None, None, None), (1, "http://a/", ""), (2, "http://a/\r\nx", "<p>one</p>"), (2, "http://a/\r\nx", "<p>one</p>"),
         (3, None, "<div><p>unfinished <a href='x"), (4, "no url", "<p>" + "word " * 50000), (9007199254740993, "http://b/", "<p>one</p>")]


def test_pages(spark):
    got = wrapper.extract_pages(pages(spark, PAGES)).collect()
    assert sorted((r["page_id"] or 0, r["text"][:10], r["n_chars"]) for r in got) == [
        (0, "", 0), (1, "", 0), (2, "one", 3), (2, "one", 3), (3, "unfinished", 10), (4, "word word ", 249999), (9007199254740993, "one", 3)]
    assert wrapper.extract_pages(pages(spark, [])).count() == 0


def test_archives(spark, tmp_path):
    def through(rows, name):
        path = f"file://{tmp_path}/{name}"
        warc.write_archives(warc.resolve_revisits(warc.records_of(pages(spark, rows))), path)
        return warc.follow_revisits(warc.read_archives(spark, path)).collect()

    got = sorted(((r["id"] or 0, r["type"], r["payload_bytes"], r["refers_to"]) for r in through(PAGES, "a")), key=str)
    assert got == sorted([
        (0, "revisit", 0, 1), (1, "response", 0, None), (2, "revisit", 10, 9007199254740993), (2, "revisit", 10, 9007199254740993),
        (3, "response", 29, None), (4, "response", 250003, None), (9007199254740993, "response", 10, None)], key=str)
    assert through([], "b") == []


def test_stages(spark, tmp_path):
    docs = documents(spark)
    sf = str(tmp_path)
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, sf)
            if name != "packing":
                assert got.columns == corpus_pipeline.COLUMNS
            rows = got.collect()
            assert not rows if table is not docs else rows
        if name == "quality":
            assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS if r[1]}
        if name == "secrets":
            assert "password=[SECRET] \U0001f600 é" in {r["text"] for r in stage(spark, docs, sf).collect()}
        if name == "mixing":
            assert all(r["text"].strip() for r in stage(spark, docs, sf).collect())

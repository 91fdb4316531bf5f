"""Defined results for odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest

import corpus_pipeline
from logweir.llm import decontaminate, fingerprints, html_extract, jaccard, mixture, quality, repeats, secrets, toxicity, warc

CLASHING = ("_row", "_key", "_text", "size", "start", "block", "key", "hash", "text_hash", "digest", "node", "chunk", "score", "taken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in CLASHING)
PROSE = "The river was wide and the people of the town walked along it in the evening. " * 3


def rows():
    texts = [
        (1, PROSE),
        (2, PROSE),
        (2, PROSE),
        (3, None),
        (4, ""),
        (None, "A text without an id that is long enough to hold more than fifty bytes of its own."),
        (None, None),
        (5, "word " * 40_000),
        (6, "é" * 70_000),
        (7, "\n\n \t"),
        (2, "Another text under the same id, also longer than fifty bytes, for the sake of it."),
        (-9_000_000_000_000_000_000, "far below"),
        (9_000_000_000_000_000_000, "far above"),
    ]
    return [(doc, text, None, None if doc == 1 else "s", None, *["x"] * len(CLASHING)) for doc, text in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, ""), (4, "too short")], "item_id long, text string"
    )


def operators(spark, labels, benchmark):
    return {
        "fingerprints": fingerprints.fingerprints,
        "toxicity": lambda docs: toxicity.classify(docs, labels),
        "jaccard": jaccard.groups,
        "quality": quality.classify,
        "mixture": mixture.taken,
        "secrets": lambda docs: secrets.report(docs, secrets.ledger_at(spark)),
        "decontaminate": lambda docs: decontaminate.report(docs, benchmark),
        "repeats": repeats.remove,
    }


NAMES = ("fingerprints", "toxicity", "jaccard", "quality", "mixture", "secrets", "decontaminate", "repeats")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, odd, labels, benchmark, name):
    found = operators(spark, labels, benchmark)[name](odd).collect()
    assert sorted(str(row.doc_id) for row in found) == sorted(str(row[0]) for row in rows())
    same = [row.asDict() for row in found if row.doc_id == 2]
    assert len(same) == 3


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, labels, benchmark, name):
    assert operators(spark, labels, benchmark)[name](none).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda stage: stage[0])
def test_stage_on_odd_rows(spark, odd, none, benchmark, tmp_path, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, function = stage
    found = function(spark, odd, str(tmp_path))
    if function is not corpus_pipeline.mix_sources:
        assert found.columns == odd.columns
        assert function(spark, none, str(tmp_path)).collect() == []
    assert found.count() <= len(rows())


def test_one_of_repeated_rows_stays(spark, odd):
    kept = jaccard.keep_one(odd).collect()
    assert sum(row.text == PROSE for row in kept) == 1
    assert [row.doc_id for row in kept if row.text == PROSE] == [1]
    # Texts without words are alike, whether null, empty or blank.
    assert sum(not (row.text or "").split() for row in kept) == 1


def test_repeats_of_one_id_hide_nothing(odd):
    found = repeats.remove(odd).collect()
    prose = [row for row in found if row.n_bytes == len(PROSE)]
    assert sorted((row.doc_id, row.n_removed > 0) for row in prose) == [(1, False), (2, True), (2, True)]
    long = next(row for row in found if row.doc_id == 6)
    assert (long.n_bytes, long.n_removed) == (140_000, 0)


def test_last_document_is_followed_by_the_first(odd):
    found = {row.doc_id: row for row in fingerprints.fingerprints(odd).collect()}
    last = "far above"
    half = len(last) // 2
    ordered = sorted(rows(), key=lambda row: (row[0] is not None, row[0] or 0))
    candidates = {
        hashlib.sha256((last[: len(last) - half] + (row[1] or "")[:half]).encode()).hexdigest() for row in ordered if row[0] is None
    }
    assert found[9_000_000_000_000_000_000].edited_sha256 in candidates
    assert found[4].n_chars == 0 and found[3].fingerprint == found[4].fingerprint


def test_mixture_sources(odd):
    found = mixture.taken(odd).collect()
    assert all(0 <= row.taken <= 3 * row["size"] for row in found)
    null_source = [row for row in found if row.doc_id == 1]
    assert null_source[0].source_size == len(PROSE.split())


def test_leaks_in_every_copy(benchmark, odd):
    found = decontaminate.report(odd, benchmark).collect()
    assert {(row.doc_id, row["items"]) for row in found if row.contaminated} == {(1, "1"), (2, "1")}


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, payload string"
    page = "<html><body><article><p>Some words here.</p></article></body></html>"
    long = f"<article><p>{'long page ' * 30_000}</p></article>"
    pages = [(1, "u", page), (1, "u", page), (None, None, None), (2, None, ""), (3, "u\r\nWARC/1.1", long), (None, "u", page), (4, "u", "<<<>&lt;b")]
    table = spark.createDataFrame([(*row, "x", "x", "x") for row in pages], schema)
    texts = html_extract.extract(table).collect()
    assert sorted(row.text for row in texts if row.n_chars < 100)[-3:] == ["Some words here."] * 3
    assert sum(row.n_chars == len(("long page " * 30_000).strip()) for row in texts) == 1
    assert len(texts) == len(pages) and all(row.n_chars == len(row.text) for row in texts)
    archived = warc.round_trip(table).collect()
    assert len(archived) == len(pages)
    assert {row.payload_digest for row in archived} == {hashlib.sha256((row[2] or "").encode()).hexdigest() for row in pages}
    none = spark.createDataFrame([], schema)
    assert html_extract.extract(none).collect() == [] and warc.round_trip(none).collect() == []

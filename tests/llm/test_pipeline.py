"""The pipeline, each stage on what the one before kept, against plain Python."""

from pathlib import Path

import pytest

import corpus_pipeline
from logweir.llm import quality
from tests.llm.test_brute_force import base_spans, shingle_set

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows of the table and of every stage, written and read again as the pipeline does."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    out = [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(FOLDER)).write.parquet(str(root / str(at)))
        docs = spark.read.parquet(str(root / str(at)))
        out.append(docs)
    return [(frame.columns, {row.doc_id: row for row in frame.collect()}) for frame in out]


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(columns == steps[0][0] for columns, _ in steps[:5])


def test_rejected_texts_go(spark, steps):
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    accepted = {row.doc_id for row in quality.classify(docs).collect() if row.accepted}
    assert set(steps[1][1]) == accepted
    labels = {row.doc_id: row.quality for row in spark.read.parquet(str(FOLDER / "labels.parquet")).collect()}
    assert all(doc in accepted for doc, good in labels.items() if good == 1)


def test_one_of_each_group_stays(steps):
    before, after = steps[1][1], steps[2][1]
    sets = {doc: shingle_set(row.text) for doc, row in before.items()}
    root = {doc: doc for doc in sets}

    def top(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for one in sets:
        for two in sets:
            if one < two and len(sets[one] & sets[two]) >= 0.8 * len(sets[one] | sets[two]):
                root[max(top(one), top(two))] = min(top(one), top(two))
    assert set(after) == {top(doc) for doc in sets}
    assert all(after[doc] == before[doc] for doc in after)


def test_leaks_go_and_all_else_stays(spark, steps):
    items = [" ".join(row.text.split()) for row in spark.read.parquet(str(FOLDER / "benchmark.parquet")).collect()]
    before, after = steps[2][1], steps[3][1]
    clean = {doc for doc, row in before.items() if not any(item in " ".join(row.text.split()) for item in items)}
    assert set(after) == clean


def test_secrets_are_gone(steps):
    before, after = steps[3][1], steps[4][1]
    assert set(before) == set(after)
    for doc, row in after.items():
        assert not base_spans(row.text) and row.n_chars == len(row.text)
        assert (row.text == before[doc].text) == (not base_spans(before[doc].text))


def test_mix(steps):
    taken, targets = {}, {}
    for doc, row in steps[5][1].items():
        source = steps[4][1][doc].source
        taken[source] = taken.get(source, 0) + row.taken
        targets[source] = row.target
        assert row.taken <= 3 * row["size"]
    assert set(steps[5][1]) == set(steps[4][1])
    assert all(abs(taken[source] - target) <= 1 for source, target in targets.items())


def test_run(spark, steps):
    found = corpus_pipeline.run(spark, str(FOLDER))
    assert {row.doc_id: row for row in found.collect()} == steps[5][1]

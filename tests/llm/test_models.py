"""Trained scorers on labelled tables: held-out figures, and what they must not look at."""

from pathlib import Path

import numpy as np
import pytest

from logweir.llm import quality, toxicity
from logweir.llm.common import read

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


def ranked(score, truth):
    """Chance that a row of class 1 scores above one of class 0."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = truth == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_toxicity_on_held_out_documents(spark):
    documents, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    found = toxicity.classify(documents, labels)
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    score, truth = rows["score"].to_numpy(), rows["toxic"].to_numpy()
    # Some 200 toxic documents make the dictionaries here, a few dozen of them not English.
    assert ranked(score, truth) > 0.75
    assert (rows["predicted"] == (score >= 0.5)).all() and ((score >= 0) & (score <= 1)).all()
    clean = rows[rows["toxic"] == 0]
    assert clean["predicted"].mean() < 0.03


def test_toxicity_learns_from_the_other_fold_alone(spark):
    documents, labels = read(spark, FOLDER, "documents").limit(600), read(spark, FOLDER, "labels")
    swapped = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(doc_id as string)), 5) = 0 then 1 - toxic else toxic end as toxic")
    one = toxicity.classify(documents, labels).orderBy("doc_id").collect()
    two = toxicity.classify(documents, swapped).orderBy("doc_id").collect()
    assert one == two


def test_toxicity_names_as_many_clean_documents_at_every_size(spark):
    """One mix in two sizes: 4 % toxic, and 6 % of the clean ones read just like them, so none should be named."""
    random = np.random.default_rng(3)
    vocabulary = ["".join(random.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    named = []
    # In the small table no bound is reached; in the large one the sample has a quarter of the ordinary rows.
    for size in (1500, 6000):
        rows = []
        for at in range(size):
            toxic, alike = at % 25 == 0, random.random() < 0.06
            words = list(random.choice(vocabulary, 40))
            if toxic or alike:
                words[20:20] = ["zzqxw you vyrrkz wuxq"] * 3
            rows.append((at, " ".join(words), int(toxic)))
        table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), toxicity.Settings(per_class=600))
        scores = toxicity.score(table, model).where("toxic = 0").toPandas()["toxicity"]
        named.append((scores >= 0.5).mean())
    assert max(named) < 0.02 and abs(named[0] - named[1]) < 0.02, named


def test_ordinary_pieces_come_from_all_texts_and_from_short_ones():
    texts = [b"%04d" % at + b"x" * 600 for at in range(400)]
    settings = toxicity.Settings(pieces=200, stride_bytes=100)
    chosen = toxicity._pieces([text[:40] for text in texts], settings)
    assert len(chosen) == 200 and sum(piece < b"02" for piece in chosen) in range(60, 140)
    assert len(toxicity._pieces(texts, settings)) == 200
    assert toxicity._pieces(texts[::-1][:3] + [b"short"], toxicity.Settings())[-1] == b"short"


def test_quality_against_labels_it_never_saw(spark):
    documents, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    rows = quality.classify(documents).join(labels, "doc_id").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert good["accepted"].mean() > 0.99
    assert bad["accepted"].mean() < 0.05


def scorer_with(weights):
    return quality.Scorer(tuple(weights), 0.0, None, quality.Settings())


def test_quality_looks_for_repeats_at_every_length(spark):
    passage = [f"word{chr(97 + at // 26)}{chr(97 + at % 26)}" for at in range(100)]
    texts = [(passage * 12)[:words] for words in (100, 399, 400, 1200)]
    rows = spark.createDataFrame([(" ".join(text),) for text in texts], "text string").coalesce(1)
    weights = np.zeros(2048)
    weights[11] = -1.0
    once, below, above, long = [row.quality for row in quality.score(rows, scorer_with(weights)).collect()]
    assert once == pytest.approx(0.5, abs=0.01) and below < 0.2
    assert above == pytest.approx(below, abs=0.01) and long < below


def test_quality_reads_long_words_to_their_end(spark):
    head = "漢字かな交じり文" * 5
    texts = [head + "漢字" * 60, head + "#7$A" * 30, head + "漢字" * 59 + "#7"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").coalesce(1)
    weights = np.random.default_rng(1).normal(size=2048)
    found = [row.quality for row in quality.score(rows, scorer_with(weights)).collect()]
    assert len(set(found)) == 3


def test_label_model_finds_the_better_labeller():
    random = np.random.default_rng(2)
    truth = random.random(4000) < 0.8
    counts = {}
    for value in truth:
        votes = ["-"] * len(quality.HEURISTICS)
        for place, right in ((0, 0.95), (1, 0.9), (2, 0.6), (3, 0.97)):
            if random.random() < 0.9:
                votes[place] = "g" if value == (random.random() < right) else "b"
        key = "".join(votes)
        counts[key] = counts.get(key, 0) + 1
    model = quality.estimate(sorted(counts.items()))
    accuracy = [model.chances[place][0][0] for place in range(4)]
    assert accuracy[2] < min(accuracy[0], accuracy[1], accuracy[3])
    assert model.good == pytest.approx(0.8, abs=0.06)
    assert model.posterior("g" * 4 + "-" * 4) > 0.95 > 0.05 > model.posterior("b" * 4 + "-" * 4)

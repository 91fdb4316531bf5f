"""Frequent anchors: strings are dealt by what is beside them, each once, and equal ones alike."""

import numpy as np
import pytest

from logweir.llm import repeats

COMMON = b"the common words"


def found_in(texts, settings):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return repeats.anchors(data, np.cumsum([len(text) for text in texts]).astype(np.int64), settings)


@pytest.mark.parametrize("settings", [repeats.Settings(), repeats.Settings(length=20, gram=8, slice=90), repeats.Settings(length=16, gram=16)])
def test_every_string_has_one_key_and_equal_strings_the_same(settings):
    random = np.random.default_rng(1)
    common = bytes(random.integers(97, 100, 400, np.uint8))
    texts = [
        bytes(random.integers(97, 123, random.integers(0, 90), np.uint8)) + common[at : at + 150] + bytes(random.integers(97, 123, 40, np.uint8))
        for at in range(0, 200, 37)
    ]
    data, keys = b"".join(texts), {}
    found = found_in(texts, settings).sided(data, settings)
    for hash_, place, first, last in zip(*(values.tolist() for values in (found.hash, found.place, found.first, found.last))):
        for start in range(first, last + 1):
            assert start not in keys
            keys[start] = (hash_, place - start)
    ends = np.cumsum([len(text) for text in texts])
    starts = [start for low, high in zip([0, *ends], ends) for start in range(low, high - settings.length + 1)]
    assert sorted(keys) == starts
    by_string = {}
    for start in starts:
        assert by_string.setdefault(data[start : start + settings.length], keys[start]) == keys[start]


def test_a_common_gram_in_different_texts():
    settings, random = repeats.Settings(), np.random.default_rng(2)
    texts = [bytes(random.integers(97, 123, 60, np.uint8)) + COMMON + bytes(random.integers(97, 123, 60, np.uint8)) for _ in range(300)]
    found = found_in(texts, settings)
    assert np.unique(found.hash, return_counts=True)[1].max() >= 10
    assert np.unique(found.sided(b"".join(texts), settings).hash, return_counts=True)[1].max() <= 2


@pytest.mark.parametrize("frequent", [1, 20, 10**9])
def test_frequent_anchors_remove_the_same(spark, frequent):
    random = np.random.default_rng(3)
    passage = "".join(map(chr, random.integers(97, 123, 120)))
    rows = []
    for doc in range(200):
        side = ["".join(map(chr, random.integers(97, 123, 70))) for _ in range(3)]
        rows.append((doc, f"{side[0]}{COMMON.decode()}{side[1]}{passage if doc % 9 == 0 else ''}{side[2]}"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.remove(table, repeats.Settings(frequent=frequent, chunk=6000, part=9000)).collect()
    removed = {row.doc_id: row.n_removed for row in found if row.n_removed}
    # Neighbours of the passage may be alike by chance, by a letter or two.
    assert sorted(removed) == list(range(9, 200, 9)) and all(120 <= value <= 124 for value in removed.values())

"""Benchmark items asked again with other values, articles whose names look like notices, large mixtures, word hashes."""

import numpy as np
import pytest

from logweir.llm import decontaminate, html_extract, jaccard, mixture

ITEM = "Anna drives 60 km to the office in Paris every weekly meeting and then returns home before noon"
AGAIN = [
    ("Mary Ann drives 60 km to the office in Paris every weekly meeting and then returns home before noon", True),
    ("Anna drives 80km to the office in Paris every weekly meeting and then returns home before noon", True),
    ("Bob drives 7 miles to the office in New York every weekly meeting and then returns home before noon", True),
    ("So it goes: Mary Ann drives 80km to the office in San Jose every weekly meeting and then returns home before noon, they say.", True),
    ("Anna walks to the shop near the river and comes back home before the rain starts again today", False),
]
NUMBERS = "12 + 45 = 57 , 33 + 21 = 54 , 18 + 9 = 27 , 40 + 2 = 42 , 5 + 6 = 11"


def leaked(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.report(docs, table, decontaminate.Settings(**options)).collect()
    return {row.doc_id: row["items"] for row in found if row.contaminated}


def test_values_of_another_word_count(spark):
    assert leaked(spark, [text for text, _ in AGAIN], [ITEM]) == {at: "0" for at, (_, leak) in enumerate(AGAIN) if leak}


def test_slots_map_one_to_one(spark):
    item = "Anna gave Bob the red book and then Anna asked where Bob had put it"
    same = item.replace("Anna", "Mary Ann").replace("Bob", "Jo")
    mixed = "Mary gave Jo the red book and then Jo asked where Mary had put it"
    assert leaked(spark, [same, mixed], [item]) == {0: "0"}


def test_items_of_numbers(spark):
    other = NUMBERS.replace("45", "46").replace("21", "22").replace("9 =", "8 =").replace("40", "41").replace("5 +", "4 +")
    assert leaked(spark, [NUMBERS, f"see {NUMBERS} there", other], [NUMBERS]) == {0: "0", 1: "0"}


@pytest.mark.parametrize("filter_windows", [0, 1_000_000])
def test_join_without_a_filter(spark, filter_windows):
    assert leaked(spark, [ITEM, NUMBERS, "nothing here"], [ITEM, NUMBERS], filter_windows=filter_windows) == {0: "0", 1: "1"}


def test_word_hashes_have_64_bits(spark):
    # One crc32 of these is the other's with any seed.
    first, second = "cqmftsnux", "xclpnnqmu"
    hashes = jaccard._Hashes()
    assert len({hashes[first] & 0xFFFFFFFF, hashes[second] & 0xFFFFFFFF, hashes[first] >> 32, hashes[second] >> 32}) == 4
    docs = spark.createDataFrame([(1, f"one {first} two"), (2, f"one {second} two")], "doc_id long, text string")
    assert jaccard.keep_one(docs).count() == 2


ARTICLE = "<html><body><nav>menu words here</nav><article><p>{}</p>{}<p>{}</p></article><footer>foot</footer></body></html>"
LONG = "Many plain words of the article stand here for the reader to read in peace and quiet."


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<section class="legal-history"><p>history of the law</p></section>', True),
        ('<p class="share-price">the price rose</p>', True),
        ("<p><label>a labelled line</label></p>", True),
        ('<div class="promo-box">buy this now</div>', False),
        ('<div id="ad-banner-2">buy that now</div>', False),
        ('<div class="related">more to read</div>', False),
        ("<form><label>your name</label></form>", False),
    ],
)
def test_names_inside_an_article(inside, kept):
    text = html_extract.extract_text(ARTICLE.format(LONG, inside, LONG), {})
    words = " ".join(part for part in __import__("re").sub("<[^>]*>", " ", inside).split())
    assert text == f"{LONG} {words} {LONG}" if kept else text == f"{LONG} {LONG}"


def test_draws_beyond_the_generator():
    random = np.random.default_rng(2)
    good, bad, wanted = 3 * 10**9, 7 * 10**9, 4 * 10**9
    total = good + bad
    found = np.array([mixture.hypergeometric(random, good, bad, wanted) for _ in range(4000)], float)
    mean = wanted * good / total
    variance = mean * (bad / total) * (total - wanted) / (total - 1)
    assert abs(found.mean() - mean) < 4 * np.sqrt(variance / len(found)) and 0.9 < found.var() / variance < 1.1
    few = np.bincount([mixture.hypergeometric(random, 5, 2 * 10**9, 10**9) for _ in range(4000)], minlength=6) / 4000
    assert np.abs(few - np.array([1, 5, 10, 10, 5, 1]) / 32).max() < 0.04
    assert mixture.hypergeometric(random, 10**10, 0, 17) == 17

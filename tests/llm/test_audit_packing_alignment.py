"""Filter audit, packing and token alignment against plain Python."""

import bisect
import collections
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm import alignment, filter_audit, packing
from logweir.llm.tokens import ByteTokens

ODD = [
    (1, "The river was wide. " * 60, "en"),
    (2, "The river was wide. " * 60, "en"),
    (2, "The river was wide. " * 60, "en"),
    (3, None, None),
    (4, "", "de"),
    (None, "", "de"),
    (None, None, None),
    (5, "many different " + " ".join(f"word{at}" for at in range(6000)), "de"),
    (6, "é" * 70_000, ""),
    (7, "\n\n \t x", "fr"),
    (8, "price $5 & 10% | A B C", "fr"),
    (8, "same id, other text <|endoftext|> ▁ and   ﬁ ½", "fr"),
    (9_007_199_254_740_993, "an id that no double holds", "fr"),
    (-9_000_000_000_000_000_000, "far below", "en"),
]
CLASHING = ("part", "mask", "n", "rows", "good", "toxic", "digest", "piece", "start", "length", "ids", "_nth", "_group", "offset", "block", "pairs")


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{name} string" for name in CLASHING)
    return spark.createDataFrame([(*row, *["x"] * len(CLASHING)) for row in ODD], schema)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ---------------------------------------------------------------- filter audit

LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (8, 1, 1), (77, 1, 1)]


def words_of(text):
    out, word = [], ""
    for mark in text:
        if mark in " \t\n\v\f\r":
            out, word = out + [word] if word else out, ""
        else:
            word += mark
    return out + [word] if word else out


def plain_audit(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    quality, toxic = ({doc for doc, *marks in labels if doc is not None and marks[at] == 1} for at in (0, 1))
    parts = collections.defaultdict(list)
    for doc, text, lang in rows:
        text, words = text or "", words_of(text or "")
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= mark <= "Z" for mark in text) > 3 * len(text)) + "D" * any(mark in "#$%&*|" for mark in text)
        fails += "E" * (doc is not None and doc > first[text])
        parts[lang or ""].append((fails, doc in quality, doc in toxic))
    out = {}
    for part, docs in parts.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [doc for doc in left if name in doc[0]]
                left = [doc for doc in left if name not in doc[0]]
                total[name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(name in doc[0] for doc in docs) - len(gone), sum(doc[0] == name for doc in docs),
                    sum(doc[1] for doc in gone), sum(doc[2] for doc in gone),
                ]
        for (at, order, step), numbers in out.items():
            if at == part:
                numbers.append(total[order[step - 1]])
    return out


def test_audit(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = {(row[0], row[1], row[2]): list(row[3:]) for row in filter_audit.report(odd, labels).collect()}
    assert found == plain_audit(ODD, LABELS)
    assert len(found) == 4 * 120 * 5


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(none, labels).collect() == []


def test_steps_follow_the_orders():
    order = filter_audit.orders(4)
    masks = np.arange(16)
    steps = filter_audit.removal_steps(masks, order)
    for mask in masks:
        for at, row in enumerate(order):
            assert steps[mask, at] == next((step for step, name in enumerate(row) if mask >> name & 1), 4)


def test_audit_of_columns(spark):
    rows = spark.createDataFrame([("x", 1, 5), ("x", 3, 7), (None, 9, 1), ("x", None, 2)], "kind string, a int, w int")
    cells = filter_audit.column_masks(rows, F.col("kind"), {"small": F.col("a") < 4, "odd": F.col("a") % 2 == 1}, {"weight": F.col("w")})
    found = {(row.part, row.filter_order, row.step): row for row in filter_audit.audit(cells, ["s", "o"], ["weight"]).collect()}
    assert [found["x", "so", 1][name] for name in ("kept", "removed", "redundant", "weight_lost", "shapley")] == [1, 2, 0, 12, 2]
    assert [found["", "so", 2][name] for name in ("kept", "removed", "unique_fails", "weight_lost")] == [0, 1, 1, 1]


# ---------------------------------------------------------------- packing


def tokens_of(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [2]


def check_packed(rows, found, capacity):
    """Pieces spell the documents, sequences have no gaps and are not too long."""
    wanted = collections.Counter()
    for doc, text, *_ in rows:
        ids = tokens_of(text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for nth, (low, high) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc, nth, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
    assert collections.Counter((row.doc_id, row.piece, row.start, row.length, row.ids_crc32) for row in found) == wanted
    places = collections.defaultdict(list)
    for row in found:
        places[row.sequence_id].append((row.offset, row.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity, group", [(1024, 8192), (1024, 3), (16, 5)])
def test_packing(odd, capacity, group):
    options = packing.Settings(capacity=capacity, group=group)
    found = packing.report(odd, options).collect()
    used = check_packed(ODD, found, capacity)
    # No two half-empty sequences of a group: each opens only where no other has room.
    assert used <= 2 * (sum(row.length for row in found) // capacity + 1) + len(ODD) // group + 1


def test_packing_of_nothing(none):
    assert packing.report(none).collect() == []


def test_sequences_hold_the_ids(odd):
    found = packing.sequences(odd, packing.Settings(capacity=64)).collect()
    assert sum(len(row.ids) for row in found) == sum(len(tokens_of(row[1])) for row in ODD)
    assert max(len(row.ids) for row in found) <= 64
    assert [2] * sum(row[1] in (None, "") for row in ODD) <= sorted(token for row in found for token in row.ids if token == 2)


def plain_squares(lengths, capacity):
    """The rule itself: every open sequence with room is tried, and the squares are counted anew."""
    gaps, out = [], []
    for size in lengths:
        def squares(at):
            counts = collections.Counter(gap - size * (nth == at) for nth, gap in enumerate(gaps))
            return sum(count * count for gap, count in counts.items() if gap > 0)

        fitting = [at for at, gap in enumerate(gaps) if gap >= size]
        if fitting:
            at = min(fitting, key=lambda at: (squares(at), gaps[at]))
        else:
            gaps.append(capacity)
            at = len(gaps) - 1
        gaps[at] -= size
        out.append(sorted(gap for gap in gaps))
    return out[-1] if out else []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares(lengths):
    sizes = np.array(sorted(lengths, reverse=True), np.int64)
    number, offset = packing.sum_of_squares(sizes, 12)
    used = collections.Counter()
    for at, (sequence, place) in enumerate(zip(number, offset)):
        assert used[sequence] == place
        used[sequence] += int(sizes[at])
    assert sorted(12 - total for total in used.values()) == plain_squares([int(size) for size in sizes], 12)


def test_few_sequences():
    random = np.random.default_rng(5)
    sizes = random.integers(1, 1025, 8192)
    number, _ = packing.sum_of_squares(sizes, 1024)
    # Lengths above a half need a sequence each; within 1 % of the larger bound.
    bound = max(-(-sizes.sum() // 1024), (sizes > 512).sum())
    assert number.max() + 1 <= 1.01 * bound


# ---------------------------------------------------------------- tokens


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_agree(text):
    tokens = TOKENS
    assert tokens.with_specials(text) == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.ordinary(text) == tokens.plain.encode(text, add_special_tokens=False).ids


TOKENS = ByteTokens("byte_bpe_50k")


def test_special_tokens():
    text = "a <|endoftext|> b"
    assert 50256 in TOKENS.with_specials(text) and 50256 not in TOKENS.ordinary(text)


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = []
    for doc, text, *_ in rows:
        text = text or ""
        data = (" " + text).encode()
        a = TOKENS.plain.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        pieces = [model.id_to_piece(number) for number in b]
        spelled = [bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode() for number, piece in zip(b, pieces)]
        if not text or b"".join(spelled) != data:
            docs.append((doc, [], [], [], ""))
            continue
        sides = []
        for ids, parts in ((a, [TOKENS.bytes[number] for number in a]), (b, spelled)):
            at, ranges = 0, []
            for number, part in zip(ids, parts):
                ranges.append((number, at, at + len(part)))
                at += len(part)
            sides.append(ranges)
        ends = sorted({high for _, _, high in sides[0]} & {high for _, _, high in sides[1]})
        groups = [([], []) for _ in ends]
        for side, ranges in enumerate(sides):
            for number, low, _ in ranges:
                groups[bisect.bisect_right(ends, low)][side].append(number)
        links, ends_b = [], [end for _, _, end in sides[1]]
        for group_a, low, high in sides[0]:
            near = bisect.bisect_right(ends_b, low)
            for number, start, _ in sides[1][near:]:
                if start >= high:
                    break
                links.append((group_a, number))
        spelling = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        docs.append((doc, a, b, links, spelling))
    counts = collections.Counter(pair for doc in docs for pair in set(doc[3]))
    top = collections.Counter()
    for (a, _), count in counts.items():
        top[a] = max(top[a], count)
    return [
        (
            doc, len(a), len(b), spelling.count(";") + 1 if spelling else 0, len(links),
            sum(counts[pair] == top[pair[0]] for pair in links), sum(counts[pair] for pair in links),
            hashlib.sha256(spelling.encode()).hexdigest() if spelling else "",
        )
        for doc, a, b, links, spelling in docs
    ]


@pytest.mark.parametrize("block", [4 << 20, 50])
def test_alignment(odd, block):
    found = alignment.report(odd, alignment.Settings(block=block)).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = [row for row in ODD if len(row[1] or "") < 50_000]
    assert collections.Counter(tuple(row[name] for name in names) for row in found if row.n_a < 30_000) >= collections.Counter(
        row for row in plain_alignment(ODD) if row[0] != 6
    )
    assert len(found) == len(ODD) and len(short) < len(ODD)
    # Two tilings overlap in as many pairs as they have tokens, less one for each common end.
    assert all(row.n_links == row.n_a + row.n_b - row.n_groups for row in found)


def test_alignment_of_nothing(none):
    assert alignment.report(none).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.lists(st.integers(1, 5), min_size=1, max_size=20))
def test_align(widths_a, widths_b):
    total = max(sum(widths_a), sum(widths_b))
    ends = [np.cumsum([*widths, total - sum(widths)] if sum(widths) < total else widths) for widths in (widths_a, widths_b)]
    found = alignment.align(*ends)
    starts = [[0, *end[:-1]] for end in ends]
    pairs = [
        (at, other) for at in range(len(ends[0])) for other in range(len(ends[1]))
        if starts[0][at] < ends[1][other] and starts[1][other] < ends[0][at]
    ]
    assert list(zip(*(side.tolist() for side in found.links))) == pairs
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for side in (0, 1):
        assert found.group[side].tolist() == [bisect.bisect_right(common, start) for start in starts[side]]


def test_pair_counts(spark):
    table = spark.createDataFrame([(1, "the cat"), (2, "the the dog"), (3, None)], "doc_id long, text string")
    counts = alignment.pair_counts(alignment.blocks(table)).collect()
    the = [row for row in counts if row.documents == 2]
    assert len(the) == 1 and the[0].highest and the[0].a == TOKENS.ordinary(" the")[0]

"""Results on whole small tables against plain Python."""

import collections
import hashlib
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import zstandard

from logweir.llm import decontaminate, fingerprints, jaccard, mixture, repeats, secrets, warc
from logweir.llm.components import components
from logweir.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(str(FOLDER / "documents.parquet"))


@pytest.fixture(scope="module")
def texts(documents):
    return {row.doc_id: row.text for row in documents.select("doc_id", "text").orderBy("doc_id").collect()}


@pytest.fixture(scope="module")
def similar(spark):
    """Groups of near copies around the threshold, and texts that share only passages."""
    random = np.random.default_rng(3)
    words = [f"w{at}" for at in range(3000)]
    rows = []
    for group in range(30):
        base = list(random.choice(words, random.integers(3, 160)))
        for _ in range(random.integers(1, 14)):
            copy = list(base)
            for place in random.integers(0, len(copy), random.integers(0, 3)):
                copy[place] = str(random.choice(words))
            rows.append((len(rows), " ".join(copy)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [4, 384])
def test_near_duplicates(similar, block):
    found = {row.doc_id: row for row in jaccard.groups(similar, jaccard.Settings(block=block)).collect()}
    sets = {row.doc_id: shingle_set(row.text) for row in similar.collect()}
    root = {doc: doc for doc in sets}
    links = collections.Counter()

    def top(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for one in sets:
        for two in sets:
            if one < two and len(sets[one] & sets[two]) >= 0.8 * len(sets[one] | sets[two]):
                links[one] += 1
                links[two] += 1
                root[max(top(one), top(two))] = min(top(one), top(two))
    total = sum(links.values())
    # The forest promises 0.99 of the pairs at the threshold itself, more above it.
    assert sum(row.n_links for row in found.values()) >= 0.99 * total
    assert all(found[doc].n_links <= links[doc] for doc in sets)
    wrong = [doc for doc in sets if found[doc].class_id != top(doc)]
    assert len(wrong) <= 0.01 * len(sets)


@pytest.mark.parametrize("count", [9, 40])
def test_verification_of_a_node(count):
    """Few members are compared one by one, many by a membership matrix."""
    settings = jaccard.Settings()
    random = np.random.default_rng(1)
    base = [f"w{at}" for at in range(60)]
    pack = zstandard.ZstdCompressor()
    rows, sets = [], []
    for at in range(count):
        words = list(base)
        for place in random.integers(0, 60, at % 4):
            words[place] = f"x{at}"
        found = jaccard.shingles(" ".join(words), jaccard._Hashes(), 5)
        sets.append(set(found.tolist()))
        signature = jaccard._signature(found, jaccard._multipliers(settings)).tolist()
        rows.append((0, 0, 0, 0, f"{at:03}", at + 1, signature, pack.compress(" ".join(words).encode())))
    members = pd.DataFrame(rows, columns=["tree", "one", "two", "block", "digest", "copies", "signature", "packed"])
    result = jaccard._verify(members.sample(frac=1, random_state=2), 6, None, settings).set_index("digest")
    for at in range(count):
        linked = [o for o in range(count) if o != at and len(sets[at] & sets[o]) >= 0.8 * len(sets[at] | sets[o])]
        assert (result["linked"].get(f"{at:03}", 0)) == sum(o + 1 for o in linked)


def test_components(spark):
    pairs = [(f"n{at:03}", f"n{at + 1:03}") for at in range(60) if at % 13] + [("hub", f"leaf{at:03}") for at in range(300)]
    found = {row.node: row.root for row in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {found[f"leaf{at:03}"] for at in range(300)} == {"hub"}
    assert found["n012"] == "n001" or found["n012"] == found["n011"]
    assert len({found[f"n{at:03}"] for at in range(1, 13)}) == 1


def removed(texts, length=50):
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        data = text.encode()
        keep = bytearray(b"\1" * len(data))
        windows = [data[at : at + length] for at in range(len(data) - length + 1)]
        for at, window in enumerate(windows):
            if window in seen:
                keep[at : at + length] = b"\0" * length
        seen.update(windows)
        left = bytes(byte for byte, flag in zip(data, keep, strict=True) if flag)
        out[doc] = (len(data), len(data) - len(left), len(bytes(keep).replace(b"\1", b" ").split()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("chunk, part", [(20_000, 60_000), (6_000_000, 16_000_000)])
def test_repeated_passages(documents, texts, chunk, part):
    found = repeats.remove(documents, repeats.Settings(chunk=chunk, part=part, slice=5_000)).collect()
    assert {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) for row in found} == removed(texts)


def test_repeats_of_few_letters(spark):
    random = np.random.default_rng(7)
    texts = {at: "".join(random.choice(list("ab"), random.integers(0, 400), p=[0.9, 0.1])) for at in range(60)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = repeats.remove(table, repeats.Settings(chunk=1_500, part=4_000)).collect()
    assert {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) for row in found} == removed(texts)


def test_interval_tree():
    # Suffix array of banana: a, ana, anana, banana, na, nana.
    assert sorted(repeats.intervals(np.array([1, 3, 0, 0, 2]), 1)) == [(0, 2, 1), (1, 2, 3), (4, 5, 2)]


def test_fingerprints(documents, texts):
    found = {row.doc_id: row for row in fingerprints.fingerprints(documents).collect()}
    ids = sorted(texts)

    def parts(text):
        return set(re.findall(r"[^\n]{1,120}", text))

    def near(one, two):
        return 1 - len(one ^ two) / (len(one) + len(two)) if one or two else 1.0

    for at, doc in enumerate(ids):
        text, following = texts[doc], texts[ids[(at + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and row.n_chars == len(text)
        assert row.near_edited == pytest.approx(near(parts(text), parts(edited)))
        assert row.near_next == pytest.approx(near(parts(text), parts(following)))
    for one in ids:
        for two in ids:
            if texts[one] == texts[two]:
                assert found[one].fingerprint == found[two].fingerprint


def test_peeling_gives_the_digests(spark):
    rows = spark.createDataFrame([(1, list(range(100, 160)), list(range(130, 200))), (2, [5], [5]), (3, [], [7, 8])], "id long, a array<long>, b array<long>")
    found = fingerprints.differences(rows, ("id",), {"ab": ("a", "b")}, digests=True).collect()
    lists = {row.id: (row.found, list(row.removed), list(row.added)) for row in found}
    assert lists[1] == (70, list(range(100, 130)), list(range(160, 200)))
    assert lists[3] == (2, [], [7, 8]) and 2 not in lists


SECRET = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark, documents, texts):
    extra = ["secret=token:abcdefgh", "API_KEY: 'abcdef' Secret=short token = x.y.z.longer", "AKIA" + "B" * 16 + " é AKIAshort", "𝒳 " + "a1" * 12]
    rows = [*texts.items(), *[(10_000 + at, text) for at, text in enumerate(extra)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row.doc_id: row for row in secrets.report(table, secrets.ledger_at(spark)).collect()}
    for doc, text in rows:
        spans = base_spans(text)
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        assert found[doc].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert (found[doc].n_assign, found[doc].n_access, found[doc].n_hex) == tuple(
            sum(span[1] == at for span in spans) for at in range(3)
        )


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.ledger_at(spark)
    one = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "nothing")], "doc_id long, text string")
    assert {row.doc_id: len(row.spans) for row in secrets.find(one, ledger).collect()} == {1: 1, 2: 1, 3: 0}
    first = ledger.scanned().count()
    assert first == 2 * len(secrets.RULES)
    secrets.find(one, ledger).collect()
    assert ledger.scanned().count() == first
    two = one.union(spark.createDataFrame([(4, "new text token = abcdefgh")], "doc_id long, text string"))
    newer = (*secrets.RULES[:-1], secrets.Rule("hub", 2, r"new", 0, 3))
    found = {row.doc_id: [span.kind for span in row.spans] for row in secrets.find(two, ledger, newer).collect()}
    assert found == {1: ["assign"], 2: ["assign"], 3: [], 4: ["hub", "assign"]}
    # One new blob for all rules, and the changed rule for the two known ones.
    assert ledger.scanned().count() == first + len(newer) + 2


def test_redaction(spark):
    rows = [(1, "a token = abcdefgh, deadbeefdeadbeefdeadbeefdeadbeef end", 7), (2, "clean", 5), (3, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {row.doc_id: (row.text, row.n_chars) for row in secrets.redact(table, secrets.ledger_at(spark)).collect()}
    assert found == {1: ("a [SECRET], [SECRET] end", 24), 2: ("clean", 5), 3: (None, None)}


def test_leaked_passages(spark, documents, texts):
    items = {row.item_id: row.text for row in spark.read.parquet(str(FOLDER / "benchmark.parquet")).collect()}
    found = {row.doc_id for row in QUERIES["op9_decontamination"](spark, str(FOLDER)).collect() if row.contaminated}
    flat = {doc: " ".join(text.split()) for doc, text in texts.items()}
    assert found == {doc for doc, text in flat.items() if any(" ".join(item.split()) in text for item in items.values())}


def test_other_values_in_one_template(spark):
    item = "A train leaves Paris at 9 and runs 300 km in 3 hours, so how long does it take for 600 km from Paris ?"
    same = "we ask: A train leaves Rome at 7 and runs 250 km in 4 hours, so how long does it take for 500 km from Rome ? ok"
    mixed = "A train leaves Rome at 7 and runs 250 km in 4 hours, so how long does it take for 500 km from Oslo ?"
    other = "A train that nobody has seen leaves when it wants and how long does it take for anyone to notice that ?"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = spark.createDataFrame([(1, item), (2, same), (3, mixed), (4, other)], "doc_id long, text string")
    runs = {row.key.doc_id: row.words for row in decontaminate.leaks(table, benchmark).collect()}
    assert runs[1] == runs[2] and 4 not in runs
    assert runs.get(3, 0) < runs[1]


def test_joined_without_filter(spark, documents):
    benchmark = spark.read.parquet(str(FOLDER / "benchmark.parquet"))
    few = documents.limit(40)
    one = decontaminate.report(few, benchmark).orderBy("doc_id").collect()
    two = decontaminate.report(few, benchmark, decontaminate.Settings(filter_windows=0)).orderBy("doc_id").collect()
    assert one == two


def test_mixture_meets_targets(documents, texts):
    found = mixture.taken(documents).collect()
    again = mixture.taken(documents).collect()
    assert sorted(found) == sorted(again)
    sources = {row.doc_id: row.source for row in documents.select("doc_id", "source").collect()}
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for row in found:
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id])) and 0 <= row.taken <= 3 * row["size"]
        sizes[sources[row.doc_id]] += row["size"]
        taken[sources[row.doc_id]] += row.taken
        targets[sources[row.doc_id]] = row.target
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1 and target <= 3 * sizes[source]


def test_targets_reshare_the_excess():
    assert mixture.targets([10, 1000, 10]) == pytest.approx([30, 960, 30])
    assert mixture.targets([0, 0]) == [0, 0] and mixture.targets([]) == []


def test_shards_split_all_draws_without_overlap():
    sources = [mixture.Source.plan(10_000, target, 64) for target in (3_000.0, 25_000.0, 30_000.0, 0.0)]
    shards = [mixture._draws(at, 7, sources, 3) for at in range(7)]
    for at, source in enumerate(sources):
        blocks = collections.Counter(int(block) for shard in shards for block in shard["block"][shard["source_at"] == at])
        assert sum(blocks.values()) == source.draws and max(blocks.values(), default=0) <= 3
        assert all(0 <= block < source.blocks for block in blocks)


def test_archives(spark):
    magic, end = warc.MAGIC, warc.END
    fake = f"{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5{end}hello{end}"
    equal = "p" * 120
    bodies = [equal, equal, "short", "short", None, "", f"abc {fake} def{fake}", magic, f"x{magic}Content-Length: 3{end}", "é" * 100 + magic * 2]
    bodies += [f"y{end}{fake}{magic}Content-Length: 100000{end}", equal, f"plain{end}", "z" * 5000]
    rows = [(at, "u", body) for at, body in enumerate(bodies)]
    found = {row.page_id: row for row in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    for at, _, body in rows:
        data = (body or "").encode()
        first = min(other for other, _, text in rows if (text or "") == (body or ""))
        kind = ("revisit", first) if len(data) >= 100 and first != at else ("response", None)
        row = found[at]
        assert (row.payload_bytes, row.payload_digest, row.record_type, row.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), *kind)


def test_plain_archive_in_many_splits(spark, tmp_path):
    magic, end = warc.MAGIC, warc.END
    bodies = [f"{at} " + "x" * (at * 37 % 700) + (f"{magic}Content-Length: 2{end}ab{end}" if at % 5 == 0 else "") for at in range(40)]
    lines = [
        f"{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{at}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body.encode()).hexdigest()}"
        f"\r\nContent-Length: {len(body)}{end}{body}"
        for at, body in enumerate(bodies)
    ]
    folder = str(tmp_path / "plain")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.option("lineSep", end).text(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(row.page_id for row in found) == list(range(40)) and all(row.intact for row in found)

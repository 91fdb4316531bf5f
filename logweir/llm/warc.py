"""Web archives: records with revisits, and a reader that trusts only the chain from a file's start.

Writing needs no file access of its own: a record is a line of Spark's text
writer, whose line end is the end of a WARC record.  Reading cuts the files at
the magic of a record, so one cut per record and one for every magic inside a
payload.  Each task emits the candidates of its split with their successors
and jumps pointers to the split's end; jumps between the splits of a file
follow as joins; a candidate that cannot be reached from the file's start is
part of a payload.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.session import scratch_dir, staged

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Equal payloads of fewer bytes are all stored.
LEAST_REVISIT = 100


def with_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``payload``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the one with the smallest
    page id is the response.  Null payloads are empty; a null id is larger than
    any other and refers to the smallest id, or is a response when there is none.
    """
    payload = whole("html")
    base = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest")
    )
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("bytes"))
    shared = (
        narrow.where(F.col("bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first is not null")
        .select("payload_digest", "first")
    )
    # The hot payloads meet as ids and digests; the payloads themselves move by page.
    revisits = (
        narrow.join(shared, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"))
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return base.join(revisits, same, "left").select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), "refers_to")


def write(pages: DataFrame, folder: str, *, least: int = LEAST_REVISIT, records_per_file: int = 20_000) -> None:
    """Write one record per page to gzipped archives in ``folder``; a revisit stores no payload."""
    typed = with_types(pages, least)
    first = F.col("record_type") == "response"
    size = F.octet_length("payload")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        # In brackets, so that no header line can end like a magic.
        F.concat(F.lit("WARC-Target-URI: <"), F.regexp_replace("url", r"[\r\n]", " "), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(~first, F.concat(F.lit("WARC-Payload-Length: "), size)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(first, size).otherwise(0)),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.when(first, F.col("payload")).otherwise(F.lit("")))
    writer = typed.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


_CUTS = (
    "file string, block long, nth long, at long, size long, next long, body long, length long, type string, page_id string, "
    "refers_to string, digest string, payload_length long, sha256 string, raw binary"
)


def _field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)[ \t]*\r?$", header)
    return found[1].decode("utf-8", "replace") if found else None


def _page(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return found[1] if found else None


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces between magics, in order per split, with what a record there would be.

    ``at`` counts bytes from the split's first piece and ``next`` is where the
    record would end, null when no header can be read.  The bytes are kept for
    pieces that a record before them may reach into, and for their first one.
    """
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    magic = len(MAGIC)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, nth, at, reach = None, 0, 0, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if split != (file, block):
                    split, nth, at, reach = (file, block), 0, 0, 0
                value = bytes(value)
                head = value.find(END.encode())
                header = value[:head] if head >= 0 else b""
                length = _field(header, rb"Content-Length")
                body = follows = None
                if nth + block > 0 and length and length.isdigit():
                    body, length = head + len(END), int(length)
                    follows = at + magic + body + length + len(END)
                else:
                    length = None
                # A record that ends with this piece needs its digest alone.
                alone = follows == at + magic + len(value) and at >= reach and block == 0
                declared = _field(header, rb"WARC-Payload-Length") or ""
                rows.append(
                    (
                        file,
                        block,
                        nth,
                        at,
                        len(value),
                        follows,
                        body,
                        length,
                        _field(header, rb"WARC-Type"),
                        _page(_field(header, rb"WARC-Record-ID")),
                        _page(_field(header, rb"WARC-Refers-To")),
                        (_field(header, rb"WARC-Payload-Digest") or "").removeprefix("sha256:"),
                        int(declared) if declared.isdigit() else None,
                        hashlib.sha256(value[body : body + length]).hexdigest() if follows is not None else None,
                        None if alone else value,
                    )
                )
                reach = max(reach, follows or 0)
                at += len(value) + magic if nth + block > 0 else len(value)
                nth += 1
            frame = pd.DataFrame(rows, columns=[part.split()[0] for part in _CUTS.split(", ")])
            yield frame.astype({name: "Int64" for name in ("next", "body", "length", "payload_length")})

    return lines.mapInPandas(pieces, _CUTS)


def _jump(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """For each candidate the index of its successor in the same split, or its own when there is none."""
    own = np.arange(len(places))
    at = np.searchsorted(places, follows)
    inside = (at < len(places)) & (places[np.minimum(at, max(len(places) - 1, 0))] == follows) if len(places) else own < 0
    return np.where(inside, at, own)


def reachable(pieces: DataFrame) -> DataFrame:
    """``file``, ``block``, ``nth``, ``start`` and ``owner`` of every piece: its place in the file and its record's.

    A piece is a record when it is its own owner.
    """
    magic = len(MAGIC)
    splits = pieces.groupBy("file", "block").agg(
        F.sum(F.col("size") + F.when((F.col("nth") > 0) | (F.col("block") > 0), magic).otherwise(0)).alias("bytes")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = pieces.select("file", "block", "nth", "at", "next").join(bases, ["file", "block"])
    located = staged(
        placed.select("file", "block", "nth", (F.col("at") + F.col("base")).alias("start"), (F.col("next") + F.col("base")).alias("next")),
        "warc-candidates",
    )

    def exits(split: pd.DataFrame) -> pd.DataFrame:
        split = split[split["next"].notna()].sort_values("start")
        follows = split["next"].to_numpy(np.int64)
        jump = _jump(split["start"].to_numpy(np.int64), follows)
        for _ in range(int(len(split)).bit_length()):
            jump = jump[jump]
        return pd.DataFrame({"file": split["file"], "start": split["start"], "next": follows[jump] if len(split) else follows})

    # A file of one split is reached from its start alone; only others need jumps between splits.
    entries = located.groupBy("file").agg(F.lit(0).cast("long").alias("start"))
    several = located.groupBy("file").agg(F.countDistinct("block").alias("splits")).where("splits > 1").select("file")
    many = located.join(several, "file", "left_semi")
    jumps = staged(many.groupBy("file", "block").applyInPandas(exits, "file string, start long, next long"), "warc-jumps")
    while not jumps.isEmpty():
        step = jumps.select("file", F.col("start").alias("_from"), F.col("next").alias("_to"))
        there = entries.join(step, (entries["file"] == step["file"]) & (entries["start"] == step["_from"])).select(
            entries["file"], F.col("_to").alias("start")
        )
        entries = staged(entries.union(there).distinct(), "warc-entries")
        jumps = staged(
            jumps.alias("a").join(jumps.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.start"))).select(
                "a.file", "a.start", "b.next"
            ),
            "warc-jumps",
        )

    def owners(split: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        split = split.sort_values("nth")
        known = split["next"].notna().to_numpy()
        places = split["start"].to_numpy(np.int64)[known]
        jump = _jump(places, split["next"].to_numpy()[known].astype(np.int64))
        hit = np.isin(places, entry["start"].to_numpy(np.int64))
        for _ in range(int(len(places)).bit_length() + 1):
            hit[jump[hit]] = True
            jump = jump[jump]
        records = np.full(len(split), -1, np.int64)
        records[np.flatnonzero(known)[hit]] = places[hit]
        owner = np.maximum.accumulate(records) if len(records) else records
        return pd.DataFrame({"file": split["file"], "block": split["block"], "nth": split["nth"], "start": split["start"], "owner": owner})

    spread = located.select("file", "block").distinct().join(entries, "file").toDF("file", "block", "start")
    owned = located.groupBy("file", "block").cogroup(spread.groupBy("file", "block")).applyInPandas(
        owners, "file string, block long, nth long, start long, owner long"
    )
    # Pieces before the first record of a split belong to the last record before the split.
    owned = staged(owned, "warc-owners")
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = last.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("_carried"))
    return owned.join(carried, ["file", "block"]).withColumn("owner", F.greatest("owner", "_carried")).drop("_carried")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record that the chain from its file's start reaches.

    ``file, start, record_type, page_id, refers_to, payload_bytes,
    payload_digest``: of the payload read for responses, of the one referred to
    for revisits.  ``intact`` tells whether a response has the digest it names.
    """
    pieces = staged(cuts(spark, folder), "warc-pieces")
    owned = reachable(pieces).where("owner >= 0")
    counts = owned.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("pieces"))
    rows = pieces.join(owned, ["file", "block", "nth"])
    heads = rows.where("start = owner").join(counts, ["file", "owner"])
    joined = (
        rows.join(counts.where("pieces > 1"), ["file", "owner"])
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("start", F.col("raw").cast("string").alias("raw")))).alias("parts"))
        .select("file", "owner", F.array_join(F.col("parts.raw"), MAGIC).cast("binary").alias("whole"))
    )
    payload = F.expr("substring(whole, int(body) + 1, int(length))")
    sha = F.when(F.col("pieces") > 1, F.sha2(payload, 256)).otherwise(F.col("sha256"))
    response = F.col("type") == "response"
    return heads.join(joined, ["file", "owner"], "left").select(
        "file",
        "start",
        F.col("type").alias("record_type"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("refers_to").cast("long").alias("refers_to"),
        F.when(response, F.col("length")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, sha).otherwise(F.col("digest")).alias("payload_digest"),
        (~response | (sha == F.col("digest"))).alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder and read the archives back."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

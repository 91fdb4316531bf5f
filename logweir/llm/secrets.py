"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256.  The ledger lists which
(blob, rule version) pairs were scanned, the findings which spans they gave.
A scan reads only blobs the ledger does not have for a rule version, each blob
once however many documents hold it, and joins findings back to all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when the given group has the least length.

    Matches are leftmost and do not overlap; a match that is too short is
    dropped and still uses up its text.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    any_case: bool = False


#: The base kinds, in the order in which equal starts are listed, then the added ones.
BASE = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 30),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED


def _finder(rule: Rule):
    # Runs of one class need no match of the short ones: a greedy run is maximal either way.
    pattern = re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.pattern.startswith("[") else rule.pattern
    compiled = re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))

    def find(text: str) -> list[tuple[int, int]]:
        return [
            match.span()
            for match in compiled.finditer(text)
            if match.end(rule.group) - match.start(rule.group) >= rule.least
        ]

    return find


@dataclass(frozen=True)
class Ledger:
    """Two tables in one shared folder: ``scanned`` (blob, kind, version) and ``findings`` with spans."""

    spark: SparkSession
    folder: str

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", "blob string, kind string, version int").distinct()

    def findings(self) -> DataFrame:
        """A batch that was written twice after a failure gives its spans once."""
        return self._table("findings", "blob string, kind string, version int, spans array<struct<start:int,end:int>>").dropDuplicates(
            ["blob", "kind", "version"]
        )


def ledger_at(spark: SparkSession, folder: str | None = None) -> Ledger:
    return Ledger(spark, folder or scratch_dir(spark, "secret-ledger"))


def scan(documents: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date for these texts; returns the findings of the rules.

    Findings are written before the pairs they belong to, so a run that breaks
    off scans the same blobs again instead of losing them.  A null text counts
    as empty.
    """
    spark = documents.sparkSession
    blobs = documents.select(whole("text").alias("text")).withColumn("blob", F.sha2("text", 256))
    wanted = [(rule.kind, rule.version) for rule in rules]
    known = (
        ledger.scanned()
        .where(F.struct("kind", "version").isin([F.struct(F.lit(kind), F.lit(version)) for kind, version in wanted]))
        .groupBy("blob")
        .agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("done"))  # at most one entry per rule
    )
    names = F.array(*[F.lit(f"{kind}/{version}") for kind, version in wanted])
    # One row per content: hot copies meet in their own task first, then by address.
    unseen = (
        blobs.dropDuplicates(["blob"])
        .join(known, "blob", "left")
        .withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select("blob", "text", "todo")
    )
    chosen = {f"{rule.kind}/{rule.version}": rule for rule in rules}

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = {name: _finder(rule) for name, rule in chosen.items()}
        for batch in batches:
            rows = [
                (blob, chosen[name].kind, chosen[name].version, [{"start": a, "end": b} for a, b in finders[name](text)])
                for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"], strict=True)
                for name in todo
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["blob", "kind", "version", "spans"])

    found = unseen.mapInPandas(spans, "blob string, kind string, version int, spans array<struct<start:int,end:int>>")
    batch = scratch_dir(spark, "secret-batch")
    found.write.parquet(batch)
    written = spark.read.parquet(batch)
    written.where(F.size("spans") > 0).write.mode("append").parquet(f"{ledger.folder}/findings")
    written.select("blob", "kind", "version").write.mode("append").parquet(f"{ledger.folder}/scanned")
    return ledger.findings().where(
        F.struct("kind", "version").isin([F.struct(F.lit(kind), F.lit(version)) for kind, version in wanted])
    )


def spans_by_blob(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per blob all spans as (start, order of the kind, end, kind), sorted."""
    order = F.element_at(
        F.create_map(*[part for at, rule in enumerate(rules) for part in (F.lit(rule.kind), F.lit(at))]), F.col("kind")
    )
    one = F.transform(
        "spans", lambda span: F.struct(span["start"].alias("start"), order.alias("nth"), span["end"].alias("end"), F.col("kind").alias("kind"))
    )
    # A blob has one row per rule, so the list is as long as the blob's own findings.
    return findings.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("spans"))


def find(documents: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings joined back to every document that holds the blob: one row per document row.

    ``spans`` is an empty list for clean texts.  Equal texts, also under the
    same id, each get a row.
    """
    by_blob = spans_by_blob(scan(documents, ledger, rules), rules)
    paths = documents.select("doc_id", F.sha2(whole("text"), 256).alias("blob"))
    # Most blobs are clean: the side with spans holds only those with findings.
    return paths.join(by_blob, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")).alias("spans")
    )


def report(documents: DataFrame, ledger: Ledger) -> DataFrame:
    """Counts of the base kinds and the span lists in their written form."""
    kinds = [rule.kind for rule in BASE]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def base(spans):
        return F.filter(spans, lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return find(documents, ledger).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(listed(base(F.col("spans"))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, ledger: Ledger, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of their text replaced; other columns stay as they are.

    Overlapping spans become one mark.  ``n_chars``, where there is such a
    column, follows the new text.  A null text stays null.
    """
    by_blob = spans_by_blob(scan(documents, ledger)).withColumnRenamed("spans", "_found").withColumnRenamed("blob", "_blob")
    rows = documents.select(F.struct("*").alias("_row"), F.sha2(whole("text"), 256).alias("_address"))
    joined = rows.join(by_blob, F.col("_address") == F.col("_blob"), "left")

    def cut(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, found in texts:
            out = []
            for text, spans in zip(batch, found, strict=True):
                if text is not None and spans is not None and len(spans):
                    parts, at = [], 0
                    for span in spans:
                        if span["start"] >= at:
                            parts += [text[at : span["start"]], mark]
                        at = max(at, span["end"])
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pd.Series(out, dtype=object)

    cut.__annotations__ = {"texts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    clean = F.when(F.col("_found").isNull(), F.col("_row.text")).otherwise(
        F.pandas_udf(cut, "string")(F.when(F.col("_found").isNotNull(), F.col("_row.text")), F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    )
    out = joined.withColumn("_text", clean)
    columns = []
    for name in documents.columns:
        value = F.col("_row")[name]
        if name == "text":
            value = F.col("_text")
        elif name == "n_chars":
            value = F.when(F.col("_found").isNull(), value).otherwise(F.char_length("_text").cast(documents.schema[name].dataType))
        columns.append(value.alias(name))
    return out.select(*columns)

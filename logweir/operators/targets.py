"""Log targets from fleet inventories: rules, processes, open files, paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions import paths
from logweir.functions.patterns import java_pattern
from logweir.operators import enrich
from logweir.operators.enrich import by_rule
from logweir.operators.steps import settle
from logweir.rules import ProcessRule, RuleSet


def _matches(column: str, pattern: str) -> Column:
    return F.rlike(column, F.lit(java_pattern(pattern))) if pattern else F.lit(True)


def match_processes(processes: DataFrame, rules: Sequence[ProcessRule]) -> DataFrame:
    """One row per process and matching rule, with ``rule`` and ``rule_idx``.

    The rules are few and known when the plan is built, so each becomes a
    literal predicate of one projection: no join, patterns compiled once.
    ``cmdline`` is blank for a process where no rule of its name looks at it.
    """
    hits = []
    needs = F.lit(False)
    for index, rule in enumerate(rules):
        by_name = _matches("comm", rule.comm_regex)
        if rule.cmdline_regex:
            needs = needs | by_name
        hits.append(
            F.when(
                by_name & _matches("cmdline", rule.cmdline_regex),
                F.struct(F.lit(index).alias("rule_idx"), F.lit(rule.name).alias("rule")),
            )
        )
    return (
        processes.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        .withColumn("cmdline", F.when(needs, F.col("cmdline")).otherwise(""))
        .select(*processes.columns, "_hit.rule_idx", "_hit.rule")
    )


def select_paths(opened: DataFrame, rules: Sequence[ProcessRule], *, path: str = "path") -> DataFrame:
    """Absolute paths that the rule includes and does not exclude.

    The mark of a deleted file is removed first; exclusion wins.
    """
    def wanted(rule: ProcessRule) -> Column:
        keep = _matches(path, rule.include_regex)
        return keep & ~_matches(path, rule.exclude_regex) if rule.exclude_regex else keep

    return opened.withColumn(path, paths.strip_deleted(F.col(path))).where(
        F.startswith(path, F.lit("/")) & F.coalesce(by_rule(rules, wanted), F.lit(False))
    )


def limit_files(opened: DataFrame, rules: Sequence[ProcessRule], *, host: Sequence[str] = ("host",)) -> DataFrame:
    """First ``max_files`` paths per process and rule in open-file order."""
    limits = {rule.name: rule.max_files for rule in rules}
    limited = [name for name, limit in limits.items() if limit > 0]
    if not limited:
        return opened
    # The literal bound lets Spark keep only the first rows before the shuffle.
    largest = max(limits.values())
    rank = F.row_number().over(Window.partitionBy(*host, "pid", "rule").orderBy("fd_order"))
    ranked = opened.where(F.col("rule").isin(limited)).withColumn("_rank", rank).where(F.col("_rank") <= largest)
    bound = F.element_at(F.create_map(*[F.lit(part) for name in limited for part in (name, limits[name])]), F.col("rule"))
    kept = ranked.where(F.col("_rank") <= bound).drop("_rank")
    if len(limited) == len(limits):
        return kept
    return kept.unionByName(opened.where(~F.col("rule").isin(limited)))


def process_targets(
    processes: DataFrame, open_files: DataFrame, rules: Sequence[ProcessRule], *, host: Sequence[str] = ("host",)
) -> DataFrame:
    """Targets of all processes: matching rules, their open files, path filters.

    ``path`` of an open file is the one the process sees; rules look at it and
    records report it.  Where that file is read under another name, such as
    one below the root of the process, ``read_path`` has it.  The result has
    the path to read as ``path`` and the other as ``reported_path``.
    """
    matched = match_processes(processes, rules)
    joined = matched.join(open_files, [*host, "pid"])
    chosen = limit_files(select_paths(joined, rules), rules, host=host)
    attributes = {
        "process.pid": F.col("pid").cast("string"),
        "process.name": F.col("comm"),
        "process.command_line": F.col("cmdline"),
    }
    found = enrich.with_resource(
        chosen.withColumn("source_type", F.lit("process")), rules, "process", extra=attributes
    )
    read = F.coalesce(F.nullif("read_path", F.lit("")), F.col("path")) if "read_path" in found.columns else F.col("path")
    return found.withColumns({"reported_path": F.col("path"), "path": read}).drop("read_path")


def file_targets(files: DataFrame, families: Sequence[tuple[str, Sequence]]) -> DataFrame:
    """Targets of file rules from a listing with a ``path`` column, in one pass over it.

    ``families`` are pairs of source type and rules, in order.  A path goes to
    the first rule with a glob for it, and there to the first such glob
    (``include_idx``), unless the rule excludes it; rules after that one
    would lose it anyway.  Literal ends of the globs settle most of them
    before any pattern is tried.
    """
    path = F.col("path")
    ways, rules, hits = [], [], []
    for kind, family in families:
        for index, rule in enumerate(family):
            rules.append(rule)
            excluded = paths.matches_any(path, rule.exclude)
            for nth, glob in enumerate(rule.include):
                hits.append(F.when(paths.matches(path, glob) & ~excluded, F.lit(len(ways))))
                ways.append((kind, rule.name, index, nth))

    def of(at: int) -> Column:
        return F.array(*[F.lit(way[at]) for way in ways])[F.col("_way")]

    # Settled, so that a listing made distinct is matched by its paths and not by all rows it came from.
    found = settle(files, _way=F.coalesce(*hits, F.lit(None).cast("int"))).where("_way is not null")
    named = found.withColumns(
        {"source_type": of(0), "rule": of(1), "rule_idx": of(2), "include_idx": of(3)}
    ).drop("_way")
    return enrich.with_resource(named, rules, F.col("source_type")).withColumn("reported_path", path)


def first_target_per_path(
    targets: DataFrame, *, host: Sequence[str] = ("host",), order: Sequence[str] = ("process_idx", "rule_idx", "include_idx")
) -> DataFrame:
    """One target per path read: processes, then files, then containers.

    Written as an aggregation, so that copies of a hot path shrink before the
    shuffle instead of being sorted in one task.
    """
    rank = F.when(F.col("source_type") == "process", 0).when(F.col("source_type") == "file", 1).otherwise(2)
    keys = [*host, "path"]
    rest = [name for name in targets.columns if name not in keys]
    place = F.struct(rank.alias("_rank"), *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in order])
    row = F.struct(*rest)
    best = targets.groupBy(*keys).agg(F.min_by(row, place).alias("_row"))
    return best.select(*keys, "_row.*")


def discover(
    rule_set: RuleSet, *, processes: DataFrame, open_files: DataFrame, files: DataFrame,
    host: Sequence[str] = ("host",),
) -> DataFrame:
    """All targets of a fleet: three families, first target per path."""
    columns = [*host, "path", "reported_path", "source_type", "rule", "process_idx", "rule_idx", "include_idx", "resource", "resource_key"]
    families = []
    if rule_set.processes:
        found = process_targets(processes, open_files, rule_set.processes, host=host)
        families.append(found.withColumns({"process_idx": F.col("pid"), "include_idx": F.col("fd_order")}))
    if rule_set.files or rule_set.containers:
        found = file_targets(files, [("file", rule_set.files), ("container", rule_set.containers)])
        families.append(
            found.withColumns({"process_idx": F.lit(0).cast("long"), "include_idx": F.col("include_idx").cast("long")})
        )
    if not families:
        raise ValueError("the rule set has no sources")
    out = families[0].select(*columns)
    for family in families[1:]:
        out = out.unionByName(family.select(*columns))
    return first_target_per_path(out, host=host)


def new_targets(targets: DataFrame, seen: DataFrame, *, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Targets whose path was not seen before."""
    return targets.join(seen.select(*keys), list(keys), "left_anti")


def exclude_paths(targets: DataFrame, excluded: DataFrame) -> DataFrame:
    """Targets without the excluded paths."""
    return targets.join(excluded.select("path"), "path", "left_anti")


def update_seen(
    seen: DataFrame, found: DataFrame, *, now: Column, ttl_seconds: float, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """Last time each path was seen; entries older than the time-to-live go."""
    fresh = found.select(*keys, now.alias("seen"))
    age = F.unix_micros(now) - F.unix_micros("seen")
    return (
        seen.select(*keys, "seen").unionByName(fresh).groupBy(*keys).agg(F.max("seen").alias("seen"))
        .where(age <= int(ttl_seconds * 1_000_000))
    )


def attach_options(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Rule options on each line; the rules are a small local table by nature."""
    return lines.join(options, "rule")

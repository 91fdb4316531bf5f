"""Streaming source that follows growing text files.

Spark's own file stream sees whole new files only; this one sees appended
bytes.  An offset holds, per file identity, the byte reached.  A batch takes
the lines whose *newline* lies between two offsets, so offsets may fall
anywhere, a range can be cut into pieces for several tasks, and a line without
its newline stays unread.  The files must be on storage that all executors
mount, and must only grow, be truncated or be renamed.

Options
    include, exclude    JSON lists of path globs
    skip                JSON list of [include, exclude] pairs that have these files already
    start_at            ``end`` (default) or ``beginning`` for files not seen before
    starts              JSON list of [include, exclude, start_at]: the first that has a file decides in place of start_at,
                        and a file that none has is not read
    max_bytes_per_file  bytes admitted per file and batch, default 4 MiB
    max_line_chars      code points kept of a line, default 1 Mi
    piece_bytes         bytes per task, default 32 MiB
    keep_seconds        how long a vanished file is remembered, default one day
    progress            required: folder on shared storage, one per checkpoint
    shards              0 (default): the driver lists the files, and the offset of
                        a batch has an entry per file.  Above 0: so many tasks
                        list, look at and read the files, each those of its
                        inodes, and the offset is the number of a round

With the driver's listing ``progress`` only paces the rounds; what was read is
known from the checkpoint.  With shards, each task writes down once what it
reads in a round, in a file that only its first attempt can make, so a task or
batch that runs again reads the same bytes.  Rounds then follow each other
whether there is something new or not.
"""

from __future__ import annotations

import codecs
import fnmatch
import glob
import json
import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from logweir.functions.paths import glob_regex

SCHEMA = "file_key string, path string, start_offset long, end_offset long, line string"
_CHUNK = 1 << 20


def _matched(patterns: list[str]) -> list[str]:
    found: dict[str, None] = {}
    for pattern in patterns:
        # Rule globs negate a set with a caret.
        for path in sorted(glob.glob(pattern.replace("[^", "[!"), include_hidden=True)):
            found.setdefault(path)
    return list(found)


def _matcher(patterns: list[str]) -> re.Pattern:
    """Paths that any of the globs matches."""
    return re.compile("|".join(glob_regex(pattern).replace(r"\z", r"\Z") for pattern in patterns) or r"(?!)", re.DOTALL)


class Piece(InputPartition):
    """Byte ranges of files for one task: (key, path, floor, start, end)."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        super().__init__(0)
        self.ranges = ranges


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logweir_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        sharded = int({name.lower(): value for name, value in self.options.items()}.get("shards", 0))
        return (ShardedTailReader if sharded else TailReader)(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        self.include = json.loads(options["include"])
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.skip = json.loads(options.get("skip", "[]"))
        self.start_at = options.get("start_at", "end")
        self.starts = [
            (_matcher(include), _matcher(exclude), start_at) for include, exclude, start_at in json.loads(options.get("starts", "[]"))
        ]
        self.max_bytes = int(options.get("max_bytes_per_file", 4 << 20))
        self.max_chars = int(options.get("max_line_chars", 1 << 20))
        self.piece_bytes = int(options.get("piece_bytes", 32 << 20))
        self.keep_seconds = float(options.get("keep_seconds", 86400))
        self.progress = options["progress"]
        self.shards = int(options.get("shards", 0))
        self.reached: dict = self._load()

    # ------------------------------------------------------------ offsets

    def _load(self) -> dict:
        if not os.path.exists(f"{self.progress}/reached.json"):
            return {}
        with open(f"{self.progress}/reached.json", encoding="utf-8") as file:
            return json.load(file)

    def _save(self) -> None:
        os.makedirs(self.progress, exist_ok=True)
        fresh = f"{self.progress}/reached.{os.getpid()}"
        with open(fresh, "w", encoding="utf-8") as file:
            json.dump(self.reached, file, separators=(",", ":"))
        os.replace(fresh, f"{self.progress}/reached.json")

    def _start_of(self, path: str) -> str | None:
        """Where a file that was not seen before starts; nothing for one that is not read at all."""
        for include, exclude, start_at in self.starts:
            if include.match(path) and not exclude.match(path):
                return start_at
        return None if self.starts else self.start_at

    def _listing(self) -> dict[str, tuple[str, int]]:
        """Size of each regular file by identity, first path first."""
        taken = set(_matched(self.exclude))
        for include, exclude in self.skip:
            taken |= set(_matched(include)) - set(_matched(exclude))
        out: dict[str, tuple[str, int]] = {}
        for path in _matched(self.include):
            if path in taken or not os.path.isfile(path) or self._start_of(path) is None:
                continue
            try:
                info = os.stat(path)
            except FileNotFoundError:
                continue
            out.setdefault(f"{info.st_dev}:{info.st_ino}", (path, info.st_size))
        return out

    def _reach(self, old: dict, listing: dict[str, tuple[str, int]]) -> dict:
        """How far each file is read next, from where it was read to and its size now."""
        now, reached = int(time.time()), {}
        for key, (path, size) in listing.items():
            known = old.get(key)
            if known is None:
                floor = size if self._start_of(path) == "end" else 0
                known = {"floor": floor, "at": floor, "life": 0}
            elif known["at"] > size:
                known = {"floor": 0, "at": 0, "life": known["life"] + 1}
            limit = min(size, known["at"] + self.max_bytes)
            reached[key] = {"path": path, "floor": known["floor"], "at": limit, "life": known["life"], "seen": now}
        for key, known in old.items():
            if key not in reached and now - known["seen"] <= self.keep_seconds:
                reached[key] = known
        return reached

    def initialOffset(self) -> dict:
        """Nothing read yet; each file then begins at the floor of its entry."""
        return {}

    def latestOffset(self) -> dict:
        old = self.reached
        reached = self._reach(old, self._listing())

        def places(offsets: dict) -> dict:
            return {key: (entry["path"], entry["at"], entry["life"]) for key, entry in offsets.items()}

        if places(old) == places(reached):
            # Nothing new: the same offset again, so that no batch is started.
            return old
        self.reached = reached
        self._save()
        return reached

    # ------------------------------------------------------------ reading

    @staticmethod
    def _ranges(start: dict, end: dict) -> Iterator[tuple[str, str, int, int, int]]:
        """Bytes between two offsets: (key, path, floor, from, to)."""
        for key, now in end.items():
            before = start.get(key)
            same = before is not None and before["life"] == now["life"]
            at = before["at"] if same else now["floor"]
            if at < now["at"]:
                yield key, now["path"], now["floor"], at, now["at"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces: list[Piece] = []
        ranges: list[tuple[str, str, int, int, int]] = []
        used = 0
        for key, path, floor, at, to in self._ranges(start, end):
            while at < to:
                stop = min(to, at + self.piece_bytes - used)
                ranges.append((key, path, floor, at, stop))
                used += stop - at
                at = stop
                if used >= self.piece_bytes:
                    pieces.append(Piece(ranges))
                    ranges, used = [], 0
        if ranges:
            pieces.append(Piece(ranges))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        codecs.register_error("mark_byte", _mark_byte)
        for key, path, floor, start, end in partition.ranges:
            rows: list[tuple[int, int, str]] = []
            held = 0
            for begin, stop, line in _lines(path, floor, start, end, self.max_chars):
                rows.append((begin, stop, line))
                held += len(line)
                if held >= _CHUNK:
                    yield _batch(key, path, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(key, path, rows)


class Shard(InputPartition):
    """The files of a shard in the rounds after ``start`` up to ``end``."""

    def __init__(self, number: int, start: int, end: int):
        super().__init__(number)
        self.number, self.start, self.end = number, start, end


class ShardedTailReader(TailReader):
    """The same bytes, found by the tasks that read them."""

    def _load(self) -> dict:
        return {}

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        os.makedirs(self.progress, exist_ok=True)
        path = f"{self.progress}/round"
        number = 0
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                number = int(file.read())
        with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as file:
            file.write(str(number + 1))
        os.replace(f"{path}.{os.getpid()}", path)
        return {"round": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Shard(number, start["round"], end["round"]) for number in range(self.shards)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        folder = f"{self.progress}/{partition.number}"
        os.makedirs(folder, exist_ok=True)
        for number in range(partition.start + 1, partition.end + 1):
            plan = self._plan(partition.number, folder, number)
            yield from super().read(Piece([tuple(item) for item in plan["ranges"]]))
        # A batch that runs again starts no earlier than this one did.
        for name in os.listdir(folder):
            stem = name.split(".")[0]
            if stem.isdigit() and int(stem) < partition.start:
                os.remove(f"{folder}/{name}")

    def _plan(self, shard: int, folder: str, number: int) -> dict:
        """What a round reads of the shard; made by whoever comes first."""
        path = f"{folder}/{number}.json"
        if not os.path.exists(path):
            old = {}
            if number > 1:
                with open(f"{folder}/{number - 1}.json", encoding="utf-8") as file:
                    old = json.load(file)["files"]
            reached = self._reach(old, self._shard_listing(shard))
            fresh = f"{folder}/{number}.{os.getpid()}-{time.monotonic_ns()}"
            with open(fresh, "w", encoding="utf-8") as file:
                json.dump({"files": reached, "ranges": list(self._ranges(old, reached))}, file, separators=(",", ":"))
            try:
                os.link(fresh, path)
            except FileExistsError:
                pass  # another attempt was first; its plan holds
            os.remove(fresh)
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def _shard_listing(self, shard: int) -> dict[str, tuple[str, int]]:
        """Size of each of the shard's files; names of folders are read by all, only own files are looked at."""
        out: dict[str, tuple[str, int]] = {}
        excluded = _matcher(self.exclude)
        taken = [(_matcher(include), _matcher(exclude)) for include, exclude in self.skip]
        for pattern in self.include:
            parent, name = os.path.split(pattern.replace("[^", "[!"))
            fits = re.compile(fnmatch.translate(name)).match
            for where in sorted(glob.glob(parent, include_hidden=True)) if glob.has_magic(parent) else [parent]:
                try:
                    entries = sorted(os.scandir(where), key=lambda entry: entry.name)
                except (FileNotFoundError, NotADirectoryError):
                    continue
                for entry in entries:
                    try:
                        inode = os.stat(entry.path).st_ino if entry.is_symlink() else entry.inode()
                        if inode % self.shards != shard or not fits(entry.name) or not entry.is_file():
                            continue
                        if excluded.match(entry.path) or any(has.match(entry.path) and not but.match(entry.path) for has, but in taken):
                            continue
                        if self._start_of(entry.path) is None:
                            continue
                        info = os.stat(entry.path)
                    except FileNotFoundError:
                        continue
                    out.setdefault(f"{info.st_dev}:{info.st_ino}", (entry.path, info.st_size))
        return out


def _batch(key: str, path: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    starts, ends, lines = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key] * len(rows), pa.string()), pa.array([path] * len(rows), pa.string()),
            pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(lines, pa.string()),
        ],
        names=["file_key", "path", "start_offset", "end_offset", "line"],
    )


def _mark_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One mark per bad byte, as in ``text.repair_utf8``."""
    return "�", error.start + 1


def _line_start(file, floor: int, start: int) -> int:
    """Start of the line that is open at ``start``, not before ``floor``."""
    at = start
    while at > floor:
        low = max(floor, at - _CHUNK)
        file.seek(low)
        newline = file.read(at - low).rfind(b"\n")
        if newline >= 0:
            return low + newline + 1
        at = low
    return floor


def _lines(path: str, floor: int, start: int, end: int, max_chars: int) -> Iterator[tuple[int, int, str]]:
    """Lines whose newline lies in [start, end); long lines keep their head only."""
    keep = max_chars * 4
    try:
        file = open(path, "rb")
    except FileNotFoundError:
        return
    with file:
        begin = _line_start(file, floor, start)
        file.seek(begin)
        head = file.read(min(keep, start - begin))
        file.seek(start)
        at = start
        while at < end:
            part = file.readline(min(_CHUNK, end - at))
            if not part:
                return
            at += len(part)
            if len(head) < keep:
                head += part[: keep - len(head)]
            if part.endswith(b"\n"):
                body = head.removesuffix(b"\n").removesuffix(b"\r")
                yield begin, at, body.decode("utf-8", "mark_byte")[:max_chars]
                begin, head = at, b""


def tail_lines(spark, *, include: list[str], exclude: list[str] | tuple[str, ...] = (), **options: object):
    """A stream of lines of the files matched by the globs."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(TailSource.name())
    reader = reader.option("include", json.dumps(list(include))).option("exclude", json.dumps(list(exclude)))
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value if isinstance(value, str) else json.dumps(value))
    return reader.load()

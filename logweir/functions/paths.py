"""Functions over file paths: globs, container names, reported paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import keyed_map

_DELETED = " (deleted)"


def glob_regex(glob: str) -> str:
    """Java regular expression for a path glob: ``*``, ``?``, ``[..]``, ``\\x``.

    Neither ``*`` nor ``?`` crosses a slash and there is no ``**``.
    """
    out = []
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", glob, re.S):
        if token == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token.startswith("[") and len(token) > 1:
            body = token[1:-1]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            out.append("(?!/)[" + ("^" if negated else "") + body.replace("[", r"\[").replace("&&", r"&\&") + "]")
        else:
            out.append(re.escape(token[-1]))
    return "^" + "".join(out) + r"\z"


def literal_ends(glob: str) -> tuple[str, str]:
    """Text that every match of a glob starts with, and text it ends with."""
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", glob, re.S)
    plain = [None if token in "*?" or (token.startswith("[") and len(token) > 1) else token[-1] for token in tokens]
    wild = [at for at, mark in enumerate(plain) if mark is None]
    if not wild:
        return "".join(plain), ""
    return "".join(plain[: wild[0]]), "".join(plain[wild[-1] + 1 :])


def matches(path: Column, glob: str) -> Column:
    """Whether a path matches; its literal ends are looked at first, which settles most paths."""
    start, end = literal_ends(glob)
    return F.startswith(path, F.lit(start)) & F.endswith(path, F.lit(end)) & F.rlike(path, F.lit(glob_regex(glob)))


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | matches(path, glob)
    return out


def local_path(uri: Column) -> Column:
    """Path part of a file URI as Spark reports it."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))


def strip_deleted(path: Column) -> Column:
    return F.when(
        F.endswith(path, F.lit(_DELETED)), F.substring(path, F.lit(1), F.length(path) - len(_DELETED))
    ).otherwise(path)


def reported_path(reported: Column, path: Column) -> Column:
    """Path as the owning process sees it, else the path read."""
    return F.coalesce(F.nullif(reported, F.lit("")), path)


def container_name_parts(path: Column) -> Column:
    """Base name without its last extension, cut at the first two underscores."""
    base = F.substring_index(path, "/", -1)
    extension = F.substring_index(base, ".", -1)
    name = F.when(F.contains(base, F.lit(".")), F.left(base, F.length(base) - F.length(extension) - 1)).otherwise(base)
    return F.split(name, "_", 3)


def container_parts(parts: Column) -> dict[str, Column]:
    """Pod, namespace, container and id from ``<pod>_<ns>_<container>-<id>.log``.

    Takes ``container_name_parts``, which needs two underscores in the name.
    The last dash splits container and id unless it comes first.  A part that
    is not there is null.
    """
    named, rest = F.size(parts) == 3, F.get(parts, F.lit(2))
    last = F.substring_index(rest, "-", -1)
    cut = F.length(rest) - F.length(last) - 1
    split = named & F.contains(rest, F.lit("-")) & (cut > 0)
    return {
        "k8s.pod.name": F.when(named, F.get(parts, F.lit(0))),
        "k8s.namespace.name": F.when(named, F.get(parts, F.lit(1))),
        "k8s.container.name": F.when(split, F.left(rest, cut)),
        "container.id": F.when(split, last),
    }


def container_attributes(path: Column) -> Column:
    """The container parts as a map."""
    return keyed_map(container_parts(container_name_parts(path)))

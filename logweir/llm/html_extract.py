"""Main text of web pages as a maximum-scoring run of tokens.

A page is a sequence of words and tags.  Words score by the tag they follow,
tags have negative scores; the scores are learned from pages whose article is
marked, as log-odds of being inside it.  One linear scan finds the run with
the highest sum, and the words of that run outside boilerplate elements are
the text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import smallest_by_hash


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled pages at most, and ``features`` weights at most, are learned."""

    sample: int = 2000
    features: int = 2000
    word: float = 1.0
    tag: float = -0.3
    least_tag: float = -0.01
    boilerplate: float = -3.0


#: Elements whose text is never content.
SILENT = frozenset("head title script style noscript template iframe object svg canvas math".split())
ASIDE = frozenset("nav footer aside form button select option textarea input label menu dialog fieldset".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Parts of class and id names that mark boilerplate.
NOTICE = re.compile(
    r"^(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|side-?bars?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|foot|footer|comments?|replies|reply|respond|disqus|discussion|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|"
    r"newsletters?|subscribe|subscription|signup|login|share|sharing|social|related|recommended|widgets?|toolbar|masthead|topbar|copyright|legal|disclaimer|pagination|pager|skip)$",
    re.IGNORECASE,
)
#: Parts of names that say what shape an element has, not what it holds.
SHAPES = frozenset(
    "area bar block body box button buttons col column container content global group head header icon icons inner item items "
    "link links list main message module outer page panel popup row section site slot text title top unit wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

_PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


@dataclass(slots=True)
class Token:
    """A tag, or a stretch of text between tags with its words."""

    tag: str  # name of a tag, with "/" for an end tag; empty for text
    text: str
    key: str  # what the score looks at
    dropped: bool  # inside boilerplate
    inside: bool  # inside a marked article


def _attributes(written: str) -> dict[str, str]:
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(written)}
    if "hidden" in written and re.search(r"\bhidden\b", re.sub(r"\"[^\"]*\"|'[^']*'", "", written)):
        found.setdefault("hidden", "")
    return found


def _is_notice(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if (name in ASIDE and not (name == "label" and in_article)) or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if name in ("html", "body", "article", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if not in_article and any(re.fullmatch(r"(?:site|page|main)?[-_]?(?:header|head)", name, re.IGNORECASE) for name in names):
        return True
    if in_article:
        return any(map(_names_a_notice, names))
    return any(NOTICE.match(part) for name in names for part in [name, *re.split(r"[-_]", name)])


def _names_a_notice(name: str) -> bool:
    """Whether a whole name says boilerplate: one part of it does, and the others say nothing else."""
    parts = [part for part in re.split(r"[-_\d]+", name) if part]
    found = [bool(NOTICE.match(part)) for part in parts]
    return any(found) and all(bad or part.lower() in SHAPES for part, bad in zip(parts, found, strict=True))


def tokens(page: str) -> list[Token]:
    """The page in order; comments and declarations are left out, raw elements are skipped whole."""
    out: list[Token] = []
    opened: list[tuple[str, bool, bool]] = []  # name, starts boilerplate, is an article
    dropped = articles = 0
    key, at, end = "", 0, len(page)

    def text(start: int, stop: int) -> None:
        if stop > start and not page[start:stop].isspace():
            out.append(Token("", page[start:stop], key, dropped > 0, articles > 0))
        elif stop > start:
            out.append(Token("", " ", key, dropped > 0, articles > 0))

    while at < end:
        match = _PIECE.search(page, at)
        if match is None:
            text(at, end)
            break
        text(at, match.start())
        at = match.end()
        name = (match[1] or "").lower()
        if not name:
            continue
        if page.startswith("</", match.start()):
            was = (dropped > 0, articles > 0)
            for depth in range(len(opened) - 1, -1, -1):
                if opened[depth][0] == name:
                    for _, bad, article in opened[depth:]:
                        dropped -= bad
                        articles -= article
                    del opened[depth:]
                    break
            key = "/" + name
            # An end tag belongs to the element that it ends.
            out.append(Token(key, "", key, *was))
            continue
        attributes = _attributes(match[2]) if match[2] else {}
        if name in ENDS_PARAGRAPH and opened and opened[-1][0] == "p":
            _, bad, article = opened.pop()
            dropped -= bad
            articles -= article
        bad = name in SILENT or _is_notice(name, attributes, articles > 0)
        article = name in ("article", "main")
        key = name
        if "class" in attributes:
            key += "".join(f".{part.lower()}" for part in attributes["class"].split()[:2])
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            at = stop.start() if stop else end
        if name not in VOID and not (match[2] or "").rstrip().endswith("/"):
            opened.append((name, bad, article))
            dropped += bad
            articles += article
        out.append(Token(name, "", key, dropped > 0, articles > 0))
    return out


def _key(token: Token) -> str:
    return f"{'tag' if token.tag else 'word'} {token.key}"


def learn(pages: DataFrame, settings: Settings = Settings()) -> dict[str, float]:
    """Log-odds of words and tags from pages with a marked article; empty without such pages."""
    chosen = smallest_by_hash(
        pages.where(F.col("page_id").isNotNull() & F.lower("html").rlike("<(article|main)[\\s>]")).select("page_id"),
        "page_id",
        settings.sample,
        "pages",
    )
    sample = pages.select("page_id", "html").join(F.broadcast(chosen.distinct()), "page_id")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch["html"]:
                for token in tokens(page or ""):
                    if not token.dropped:
                        cell = found.setdefault(_key(token), [0, 0])
                        cell[token.inside] += len(token.text.split()) if not token.tag else 1
        if found:
            yield pd.DataFrame([(key, *cell) for key, cell in found.items()], columns=["key", "out", "inside"])

    rows = (
        sample.mapInPandas(counts, "key string, out long, inside long")
        .groupBy("key")
        .agg(F.sum("out").alias("out"), F.sum("inside").alias("inside"))
        .orderBy(F.desc(F.col("out") + F.col("inside")), "key")
        .limit(settings.features)
        .collect()
    )
    weights = {}
    for row in rows:
        odds = math.log((row.inside + 1.0) / (row.out + 1.0))
        if row.key.startswith("tag"):
            weights[row.key] = max(-2.0, min(settings.least_tag, settings.tag + odds / 4))
        else:
            weights[row.key] = max(-1.0, min(1.0, odds / 3))
    return weights


def _best(scores: list[float]) -> tuple[int, int]:
    """The run with the highest sum, longest and first among equals; empty when nothing is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, found = total, (start, at + 1)
    return found


def extract_text(page: str, weights: dict[str, float], settings: Settings = Settings()) -> str:
    """The words of the best run, blocks joined by one space."""
    parsed = tokens(page)
    scores = []
    for token in parsed:
        if token.dropped and token.inside:
            scores.append(0.0)  # boilerplate within a marked article does not end it
        elif token.tag:
            scores.append(weights.get(_key(token), settings.tag))
        else:
            count = len(token.text.split())
            scores.append(count * (settings.boilerplate if token.dropped else weights.get(_key(token), settings.word)))
    start, stop = _best(scores)
    parts: list[str] = []
    for token in parsed[start:stop]:
        if not token.tag:
            parts.append("" if token.dropped else token.text)
        elif token.tag.lstrip("/") not in INLINE:
            parts.append("\n")
    return " ".join(html.unescape("".join(parts)).split())


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of pages.

    A null, empty or wordless page gives an empty text.  Rows are worked on one
    by one, so repeated ids and rows keep their number.
    """
    weights = learn(pages, settings)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract_text(page or "", weights, settings) for page in batch], dtype=object)

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = pages.select("page_id", "url", F.pandas_udf(texts, "string")("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

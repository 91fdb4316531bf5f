"""User regular expressions: the accepted dialect and its Java spelling.

Rules are written in the linear-time dialect (RE2 syntax): no look-around, no
back-references, no possessive repeats, ``$`` is the end of the text and
``\\s`` has no vertical tab.  Spark runs Java patterns, so the few tokens whose
meaning differs are respelled and the ones the dialect lacks are refused.
"""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
_SPELLING = {
    r"\s": r"[\t\n\f\r ]",
    r"\S": r"[^\t\n\f\r ]",
    r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    r"\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank",
    "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
    "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit",
}
_TOKEN = re.compile(
    r"(?P<quote>\\Q.*?(?:\\E|\Z))"
    r"|(?P<escape>\\.)"
    r"|(?P<set>\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\])"
    r"|(?P<name>\(\?P?<(?![=!]))"
    r"|(?P<look>\(\?(?:<?[=!]|>))"
    r"|(?P<flags>\(\?[A-Za-z-]*(?=[:)]))"
    r"|(?P<group>\()"
    r"|(?P<possessive>(?:[*+?]|\{\d+(?:,\d*)?\})\+)"
    r"|(?P<end>\$)",
    re.S,
)
_SET_TOKEN = re.compile(r"\[:(\^?)(\w+):\]|\\.|\[|&&", re.S)


class PatternError(ValueError):
    """A pattern the rule dialect does not have."""


def _java_set(text: str) -> str:
    head = re.match(r"\[\^?\]?", text).group()
    body = text[len(head):-1]

    def spell(match: re.Match[str]) -> str:
        token = match.group()
        if token.startswith("[:"):
            name = _POSIX.get(match.group(2))
            if name is None:
                if match.group(2) == "space":
                    return r"\t-\r " if not match.group(1) else r"[^\t-\r ]"
                if match.group(2) == "word":
                    return r"\W" if match.group(1) else r"\w"
                raise PatternError(f"unknown character class {token}")
            return (r"\P" if match.group(1) else r"\p") + "{" + name + "}"
        if token == r"\s":
            return r"\t\n\f\r "
        if token == r"\S":
            return r"[^\t\n\f\r ]"
        if token == "[":
            return r"\["
        if token == "&&":
            return r"&\&"
        return token

    return head.replace("]", r"\]") + _SET_TOKEN.sub(spell, body) + "]"


def java_pattern(pattern: str) -> str:
    """The Java spelling of a rule pattern, or PatternError."""
    multi_line = bool(re.search(r"\(\?[a-z]*m", pattern))

    def spell(match: re.Match[str]) -> str:
        kind, token = match.lastgroup, match.group()
        if kind == "look" or kind == "possessive":
            raise PatternError(f"{token!r} is not part of the rule dialect: {pattern!r}")
        if kind == "escape":
            if token[1] in "123456789kGZRXhHNe":
                raise PatternError(f"{token!r} is not part of the rule dialect: {pattern!r}")
            return _SPELLING.get(token, token)
        if kind == "flags":
            if re.search(r"[^ims-]", token[2:]):
                raise PatternError(f"flags {token!r} are not supported: {pattern!r}")
            return token
        if kind == "set":
            return _java_set(token)
        if kind == "name":
            return "(?<"
        if kind == "end":
            return "$" if multi_line else r"\z"
        return token

    return "(?d)" + _TOKEN.sub(spell, pattern)


def capture_groups(pattern: str) -> int:
    """How many capture groups a rule pattern has."""
    return sum(
        1
        for match in _TOKEN.finditer(pattern)
        if match.lastgroup == "name"
        or (match.lastgroup == "group" and not pattern.startswith("(?", match.start()))
    )


def compiles(spark, pattern: str) -> bool:
    """Whether Java accepts the spelling of a rule pattern (one literal row)."""
    from pyspark.errors import PySparkException

    try:
        spark.sql("select regexp_like('', :p) as ok", args={"p": java_pattern(pattern)}).first()
    except (PatternError, PySparkException):
        return False
    return True

r"""Regular expressions with RE2's meaning.

Java's matcher differs from RE2: ``$`` also matches before a last line end, ``.`` misses more
characters than the line feed, there are no [[:classes:]], and repeats may take exponential
time. A pattern of a small plain kind is rewritten for Java, where it means the same and
stays within compiled plans; all others go to RE2 itself, in batches of Arrow arrays.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"[A-Za-z0-9 _,;:@#%&=~<>/'\"-]"
_CLASS = r"\[\^?(?:[A-Za-z]-[A-Za-z]|[0-9]-[0-9]|[A-Za-z0-9 _])+\]"
#: One element with an optional repeat: a plain character, an escaped sign, a class, any character.
_ATOM = re.compile(rf"(?P<atom>{_PLAIN}|\\[.^$*+?()\[\]{{}}|\\]|\\[dw]|{_CLASS}|\.)(?P<times>\*|\+|\?|\{{[0-9]{{1,2}}\}})?")


def check(pattern: str) -> None:
    """Raises ValueError for what RE2 does not take."""
    pc.match_substring_regex(pa.array([""]), pattern=pattern)


def for_java(pattern: str, any_case: bool = False) -> str | None:
    """The same search for Java's matcher, which takes linear time for it; None if the pattern is not of the plain kind: elements in a row, at most one of them repeated without bound, between ^ and $."""
    body, start, end = pattern, "", ""
    if any_case:
        return None
    if body.startswith("^"):
        body, start = body[1:], "^"
    if body.endswith("$") and not body.endswith("\\$"):
        body, end = body[:-1], r"\z"
    at, out, unbounded = 0, [], 0
    while at < len(body):
        m = _ATOM.match(body, at)
        if m is None:
            return None
        times = m["times"] or ""
        unbounded += times in ("*", "+") and times != ""
        out.append((r"[^\n]" if m["atom"] == "." else m["atom"]) + times)
        at = m.end()
        if times and body[at : at + 1] in ("?", "+", "*", "{"):
            return None
    return start + "".join(out) + end if unbounded <= 1 else None


def found(text: Column, pattern: str, any_case: bool = False) -> Column:
    """Does the text hold a match? Null for a null text."""
    if (plain := for_java(pattern, any_case)) is not None:
        return text.rlike(plain)

    @F.arrow_udf("boolean")
    def matches(t: pa.Array) -> pa.Array:
        return pc.match_substring_regex(t, pattern=pattern, ignore_case=any_case)

    return matches(text)

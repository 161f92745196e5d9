"""Text as the engine sees it: ASCII case folding and the lexical tokenizer."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of ASCII and everything beyond ASCII make tokens.
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: The same tokens for Python's matcher, of lower-cased text.
TOKEN = "[a-z0-9\x80-\U0010FFFF]+"
#: A document that is longer cannot be indexed where limits are asked for.
MOST_BYTES, MOST_TOKENS = 1 << 20, 65_536


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def lowered(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def tokens(c: Column) -> Column:
    """The tokens of a text, without empty ones."""
    return F.array_remove(F.split(ascii_lower(c), SEPARATORS), "")


def query_tokens(text: str, most_bytes: int = 4096, most: int = 64) -> list[str]:
    """The distinct tokens of a query, in order."""
    if len(text.encode()) > most_bytes:
        raise ValueError(f"a query is at most {most_bytes} bytes")
    out, word = [], ""
    for ch in [*lowered(text), " "]:
        if ch.isascii() and not ch.isalnum():
            out, word = [*out, word] if word else out, ""
        else:
            word += ch
    if len(out) > most:
        raise ValueError(f"a query is at most {most} tokens")
    return list(dict.fromkeys(out))

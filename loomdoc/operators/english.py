"""Plain English questions, read by a small grammar over tokens.

    question    = { word | count | conditions | order }
    count       = ("top" | "first" | "limit") number
    conditions  = ("where" | "with" | "whose") condition { "and" condition }
    condition   = name comparison value
    order       = ("sort" | "sorted" | "order" | "ordered") "by" name [direction]

A comparison is the longest phrase that the next tokens spell, so that "is not" is never
read as "is". A value goes on to the next "and" or order; quotes keep both words inside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.filters import predicate

MOST_ROWS, USUAL_ROWS, MOST_CHARS = 100, 20, 1000

#: What users may say for a comparison.
PHRASES: dict[str, str] = {
    ">=": "$gte", "at least": "$gte", "greater than or equal to": "$gte",
    "<=": "$lte", "at most": "$lte", "less than or equal to": "$lte",
    ">": "$gt", "greater than": "$gt", "above": "$gt",
    "<": "$lt", "less than": "$lt", "below": "$lt",
    "!=": "$ne", "not": "$ne", "not equal to": "$ne",
    "=": "$eq", "equals": "$eq", "equal to": "$eq",
}
#: Words that would write.
WRITES = frozenset({"delete", "drop", "insert", "remove", "truncate", "update", "write"})
COUNTS, OPENINGS, ORDERS = {"top", "first", "limit"}, {"where", "with", "whose"}, {"sort", "sorted", "order", "ordered"}
DIRECTIONS = {"asc": 1, "ascending": 1, "desc": -1, "descending": -1}
NAMED = {"true": True, "false": False, "null": None}

_TOKEN = re.compile(r"""(?P<quoted>"[^"]*"|'[^']*')|(?P<sign>[<>!]=|[<>=])|(?P<word>[^\s<>=!"'][^\s<>=!]*|[!"'])""")
_NAME = re.compile(r"[A-Za-z_][\w.-]*", re.ASCII)


class QuestionError(ValueError):
    """code: INVALID_QUESTION, READ_ONLY or AMBIGUOUS."""

    def __init__(self, code: str, said: str):
        super().__init__(said)
        self.code = code


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    quoted: bool = False

    @property
    def low(self) -> str:
        """What keywords are compared with; a quoted token is none."""
        return "" if self.quoted else self.text.lower()


def tokenize(text: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end(), m.lastgroup == "quoted") for m in _TOKEN.finditer(text)]


def value(text: str) -> Any:
    """A whole number, a decimal one, true, false, null, or the text itself without its quotes."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        return text[1:].removesuffix(text[0])
    digits = text.removeprefix("-")
    if digits.isascii() and digits.isdigit():
        return int(text)
    whole, dot, part = digits.partition(".")
    if dot and (whole + part).isascii() and whole.isdigit() and part.isdigit():
        return float(text)
    return NAMED.get(text.lower(), text)


class Reader:
    """Walks over the tokens of one question."""

    _SPELT = {tuple(said.split()): op for said, op in PHRASES.items()}
    _LONGEST = max(map(len, _SPELT))

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0
        self.count: int | None = None
        self.query: dict[str, Any] = {}
        self.sort: dict[str, int] | None = None

    def low(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].low if self.at + ahead < len(self.tokens) else ""

    def read(self) -> Reader:
        while self.at < len(self.tokens):
            if self.low() in COUNTS and self.low(1).isdecimal():
                self.count = self.count if self.count is not None else int(self.low(1))
                self.at += 2
            elif self.low() in OPENINGS and self.at + 1 < len(self.tokens):
                self.at += 1
                self.conditions()
            elif self.ordering():
                self.order()
            else:
                self.at += 1
        return self

    def ordering(self) -> bool:
        return self.low() in ORDERS and self.low(1) == "by" and bool(_NAME.fullmatch(self.low(2)))

    def order(self) -> None:
        way = DIRECTIONS.get(self.low(3))
        self.sort = self.sort or {self.tokens[self.at + 2].text: way or 1}
        self.at += 3 if way is None else 4

    def conditions(self) -> None:
        while True:
            name = self.tokens[self.at].text if self.at < len(self.tokens) else ""
            if not _NAME.fullmatch(name):
                raise QuestionError("AMBIGUOUS", "a condition starts with the name of a field")
            self.at += 1
            op = self.comparison()
            body = self.operand()
            self.query[name] = body if op == "$eq" else {op: body}  # a field's last condition counts
            if self.low() != "and":
                return
            self.at += 1

    def comparison(self) -> str:
        verb = self.low() == "is"
        self.at += verb
        for n in range(self._LONGEST, 0, -1):
            if op := self._SPELT.get(tuple(self.low(i) for i in range(n))):
                if op == "$ne" and self.low() == "not" and n == 1 and not verb:
                    break
                self.at += n
                return op
        if verb:
            return "$eq"
        raise QuestionError("AMBIGUOUS", "a condition could not be understood")

    def operand(self) -> Any:
        first = self.at
        while self.at < len(self.tokens) and self.low() != "and" and not self.ordering():
            self.at += 1
        if first == self.at:
            raise QuestionError("AMBIGUOUS", "a condition has no value")
        return value(self.text[self.tokens[first].start : self.tokens[self.at - 1].end])


def compile_question(question: str, limit: int | None = None) -> dict:
    """{query, limit, sort} of a question such as "first 5 users where age greater than 18 sort by name"."""
    text = (question or "").strip()
    if not 0 < len(text) <= MOST_CHARS:
        raise QuestionError("INVALID_QUESTION", f"a question has 1 to {MOST_CHARS} characters")
    if WRITES & set(re.split(r"\W+", text.lower())):
        raise QuestionError("READ_ONLY", "questions only read")
    found = Reader(text).read()
    return {"query": found.query, "limit": min(MOST_ROWS, max(1, found.count or limit or USUAL_ROWS)), "sort": found.sort}


def ask(df: DataFrame, question: str, key: str = "id") -> DataFrame:
    """The rows that a question asks for."""
    request = compile_question(question)
    out = df.where(predicate(request["query"], df.schema))
    keys = [F.col(c).desc_nulls_first() if way < 0 else F.col(c).asc_nulls_last() for c, way in (request["sort"] or {}).items()]
    return out.orderBy(*keys, F.col(key)).limit(request["limit"])

"""Values inside documents, as columns: one view of typed columns and one of VARIANT.

Both answer the same questions (is it present, equal, ordered, of which type, some
element), each with a boolean that is never null. In typed tables SQL null stands for a
missing field; VARIANT tells null from missing.
"""

from __future__ import annotations

import json
import operator
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}

#: The codes that stand for type names.
TYPE_CODES = {1: "double", 2: "string", 3: "object", 4: "array", 8: "bool", 10: "null", 16: "int"}


def never() -> Column:
    return F.lit(False)


def always() -> Column:
    return F.lit(True)



def sure(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def dump(v: Any) -> str:
    """The text that values of different types are compared by."""
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def any_of(parts: list[Column]) -> Column:
    return reduce(operator.or_, parts) if parts else never()


def all_of(parts: list[Column]) -> Column:
    return reduce(operator.and_, parts) if parts else always()


class Value(ABC):
    """A value that a path of a document leads to."""

    @abstractmethod
    def present(self) -> Column: ...

    @abstractmethod
    def field(self, name: str) -> Value | None:
        """The field of an object; None if there can be none."""

    @abstractmethod
    def equals(self, v: Any) -> Column: ...

    @abstractmethod
    def ordered(self, op: str, v: Any) -> Column: ...

    @abstractmethod
    def string(self) -> Column | None:
        """The value if it is a string, else null; None if it can't be one."""

    @abstractmethod
    def has_type(self, name: str) -> Column: ...

    @abstractmethod
    def size(self) -> Column | None:
        """The length of an array, else null; None if it can't be one."""

    @abstractmethod
    def some(self, test: Callable[[Value], Column]) -> Column:
        """Does an element of the array pass?"""

    @abstractmethod
    def numbers(self) -> Column | None:
        """The value as array<double> if all its elements are numbers."""

    def path(self, dotted: str) -> Value | None:
        at: Value | None = self
        for name in dotted.split("."):
            at = at.field(name) if at is not None else None
        return at

    def is_in(self, items: list) -> Column:
        """Equal to an item, or an array with an element equal to one."""
        return any_of([self.equals(v) for v in items]) | self.some(lambda e: any_of([e.equals(v) for v in items]))


class Typed(Value):
    """A column of known type."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def present(self) -> Column:
        return self.column.isNotNull()

    def field(self, name: str) -> Value | None:
        if isinstance(self.kind, T.StructType) and name in self.kind.fieldNames():
            return Typed(self.column.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType) and isinstance(self.kind.keyType, T.StringType):
            return Typed(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        return None

    def _temporal(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def equals(self, v: Any) -> Column:
        c, kind = self.column, self.kind
        if isinstance(v, bool):
            same = c == F.lit(v) if isinstance(kind, T.BooleanType) else never()
        elif is_number(v):
            same = c == F.lit(v) if isinstance(kind, T.NumericType) else never()
        elif isinstance(v, str):
            same = c == F.lit(v) if isinstance(kind, T.StringType) else c == F.lit(v).try_cast(kind) if self._temporal() else never()
        elif isinstance(v, list) and isinstance(kind, T.ArrayType):
            same = all_of([F.size(c) == len(v), *(Typed(F.try_element_at(c, F.lit(i + 1)), kind.elementType).equals(x) for i, x in enumerate(v))])
        elif isinstance(v, dict) and isinstance(kind, T.StructType):
            names = kind.fieldNames()
            same = all_of([self.field(k).equals(x) if k in names else never() for k, x in v.items()] + [c.getField(k).isNull() for k in names if k not in v] + [c.isNotNull()])
        else:
            same = never()  # null too: in a typed column it stands for a missing field
        return sure(same)

    def _text(self) -> Column:
        return F.to_json(self.column) if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)) else self.column.cast("string")

    def ordered(self, op: str, v: Any) -> Column:
        if is_number(v) and isinstance(self.kind, T.NumericType):
            return sure(ORDER[op](self.column, F.lit(v)))
        if isinstance(v, str) and self._temporal():
            return sure(ORDER[op](self.column, F.lit(v).try_cast(self.kind)))
        return sure(ORDER[op](self._text(), F.lit(dump(v))))

    def string(self) -> Column | None:
        return self.column if isinstance(self.kind, T.StringType) else None

    def has_type(self, name: str) -> Column:
        kinds = {
            "bool": T.BooleanType, "int": T.IntegralType, "double": (T.FractionalType, T.DecimalType), "string": (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType),
            "array": T.ArrayType, "object": (T.StructType, T.MapType),
        }
        return self.present() if name in kinds and isinstance(self.kind, kinds[name]) else never()

    def size(self) -> Column | None:
        return F.when(self.column.isNotNull(), F.size(self.column)) if isinstance(self.kind, T.ArrayType) else None

    def some(self, test: Callable[[Value], Column]) -> Column:
        if not isinstance(self.kind, T.ArrayType):
            return never()
        return sure(F.exists(self.column, lambda e: test(Typed(e, self.kind.elementType))))

    def numbers(self) -> Column | None:
        if isinstance(self.kind, T.ArrayType) and isinstance(self.kind.elementType, T.NumericType):
            return self.column.cast("array<double>")
        return None


class Row(Typed):
    """The columns of a row as the fields of a document."""

    def __init__(self, schema: T.StructType):
        self.kind = schema

    def field(self, name: str) -> Value | None:
        return Typed(F.col(f"`{name}`"), self.kind[name].dataType) if name in self.kind.fieldNames() else None


class Variant(Value):
    """A VARIANT column; every access is guarded by the value's own type, as casts convert between types."""

    def __init__(self, column: Column):
        self.column = column

    def _tag(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.column), F.lit(""))

    def _is(self, *names: str) -> Column:
        return any_of([self._tag().startswith(n) for n in names])

    def _number(self) -> Column:
        return self._is("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")

    def _as(self, kind: str, tests: Column) -> Column:
        return F.when(tests, F.try_variant_get(self.column, "$", kind))

    def present(self) -> Column:
        return self.column.isNotNull()

    def field(self, name: str) -> Value | None:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return Variant(F.try_variant_get(self.column, f"$['{quoted}']", "variant"))

    def equals(self, v: Any) -> Column:
        if v is None:
            same = F.is_variant_null(self.column)
        elif isinstance(v, bool):
            same = self._as("boolean", self._is("BOOLEAN")) == F.lit(v)
        elif is_number(v):
            whole = isinstance(v, int) and abs(v) >= 1 << 53
            same = self._as("bigint", self._is("BIGINT")) == F.lit(v) if whole else self._as("double", self._number()) == F.lit(float(v))
        elif isinstance(v, str):
            same = self._as("string", self._is("STRING")) == F.lit(v)
        elif isinstance(v, list):
            same = all_of([self.size() == len(v), *(Variant(F.try_variant_get(self.column, f"$[{i}]", "variant")).equals(x) for i, x in enumerate(v))])
        elif isinstance(v, dict):
            keys = F.map_keys(self._as("map<string,variant>", self._is("OBJECT")))
            same = all_of([F.size(keys) == len(v), *(self.field(k).equals(x) for k, x in v.items())])
        else:
            same = never()
        return sure(same)

    def ordered(self, op: str, v: Any) -> Column:
        text = F.when(self._is("STRING"), self._as("string", self._is("STRING"))).otherwise(F.to_json(self.column))
        by_text = ORDER[op](text, F.lit(dump(v)))
        if is_number(v):
            return sure(F.when(self._number(), ORDER[op](self._as("double", self._number()), F.lit(float(v)))).otherwise(by_text))
        return sure(by_text)

    def string(self) -> Column | None:
        return self._as("string", self._is("STRING"))

    def has_type(self, name: str) -> Column:
        tags = {"null": ("VOID",), "bool": ("BOOLEAN",), "int": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "double": ("DOUBLE", "DECIMAL", "FLOAT"), "string": ("STRING",), "array": ("ARRAY",), "object": ("OBJECT",)}
        return self._is(*tags[name]) if name in tags else never()

    def _array(self) -> Column:
        return self._as("array<variant>", self._is("ARRAY"))

    def size(self) -> Column | None:
        a = self._array()
        return F.when(a.isNotNull(), F.size(a))

    def some(self, test: Callable[[Value], Column]) -> Column:
        return sure(F.exists(self._array(), lambda e: test(Variant(e))))

    def numbers(self) -> Column | None:
        return F.when(sure(F.forall(self._array(), lambda e: Variant(e)._number())), F.try_variant_get(self.column, "$", "array<double>"))


class Nothing(Value):
    """What is no object: it has no fields."""

    def present(self) -> Column:
        return never()

    def field(self, name: str) -> Value | None:
        return None

    def equals(self, v: Any) -> Column:
        return never()

    def ordered(self, op: str, v: Any) -> Column:
        return never()

    def string(self) -> Column | None:
        return None

    def has_type(self, name: str) -> Column:
        return never()

    def size(self) -> Column | None:
        return None

    def some(self, test: Callable[[Value], Column]) -> Column:
        return never()

    def numbers(self) -> Column | None:
        return None

"""The filter language over plain Python documents, as an oracle for tests; written from the rules, not from the compiler."""

import json
import math
import re
import string

MISSING = object()
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def same(a, b):
    ka, kb = kind(a), kind(b)
    if {ka, kb} <= {"int", "double"}:
        return float(a) == float(b)
    if ka != kb:
        return False
    if ka == "array":
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if ka == "object":
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def get(doc, path):
    for name in path.split("."):
        if not isinstance(doc, dict) or name not in doc:
            return MISSING
        doc = doc[name]
    return doc


def text(v):
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def compare(a, op, b):
    num = {"int", "double"}
    if kind(a) in num and kind(b) in num:
        x, y = float(a), float(b)
    else:
        x, y = text(a).encode(), text(b).encode()
    return {"$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op]


def matches(q, doc):
    if q is None or q == {}:
        return True
    if not isinstance(q, dict):
        return False
    if "$or" in q:
        kids = [c for c in q["$or"] if isinstance(c, dict) and c] if isinstance(q["$or"], list) else []
        return any(matches(c, doc) for c in kids)
    if "$and" in q:
        return isinstance(q["$and"], list) and all(matches(c, doc) for c in q["$and"])
    if "$nor" in q:
        return isinstance(q["$nor"], list) and not any(matches(c, doc) for c in q["$nor"])
    if "$not" in q:
        return not matches(q["$not"], doc)
    return all(field(k, v, doc) for k, v in q.items())


def field(path, spec, doc):
    if not isinstance(spec, dict):
        return leaf(path, "$eq", spec, doc)
    if "$regex" in spec:
        rest = {k: v for k, v in spec.items() if k not in ("$regex", "$options")}
        v = get(doc, path)
        hit = isinstance(v, str) and re.search(spec["$regex"], v, re.I if spec.get("$options") else 0) is not None
        return hit and all(field(path, {k: x}, doc) for k, x in rest.items())
    if len(spec) != 1:
        return all(field(path, {k: x}, doc) for k, x in spec.items()) if spec else leaf(path, "$eq", spec, doc)
    ((op, x),) = spec.items()
    if op == "$not":
        return not field(path, x, doc)
    known = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$all", "$size", "$elemMatch", "$exists", "$type", "$text"}
    return leaf(path, op, x, doc) if op in known else leaf(path, "$eq", spec, doc)


CODES = {1: "double", 2: "string", 3: "object", 4: "array", 8: "bool", 10: "null", 16: "int"}


def leaf(path, op, x, doc):
    if op in ("$in", "$nin", "$all") and not isinstance(x, list):
        return False
    if op == "$elemMatch":
        v = doc.get(path, MISSING) if isinstance(doc, dict) else MISSING
        return isinstance(v, list) and any(matches(x, e if isinstance(e, dict) else {}) for e in v)
    v = get(doc, path)
    if op == "$exists":
        return (v is not MISSING) == (x if isinstance(x, bool) else True)
    if v is MISSING:
        return False
    if op == "$eq":
        return same(v, x)
    if op == "$ne":
        return not same(v, x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return compare(v, op, x)
    if op in ("$in", "$nin"):
        hit = any(same(v, y) for y in x) or isinstance(v, list) and any(same(e, y) for e in v for y in x)
        return hit == (op == "$in")
    if op == "$all":
        return isinstance(v, list) and all(any(same(e, y) for e in v) for y in x)
    if op == "$size":
        return isinstance(v, list) and kind(x) in ("int", "double") and math.isfinite(x) and len(v) == int(x)
    if op == "$type":
        return kind(v) == (CODES.get(int(x)) if kind(x) in ("int", "double") else x)
    return isinstance(v, str) and x.get("$search", "").translate(FOLD) in v.translate(FOLD)

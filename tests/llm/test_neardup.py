import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import common, neardup
from loomdoc.llm.graph import components

SCHEMA = "doc_id long, text string, score double, class_id string"


def brute(texts: dict[int, str], least: float = 0.8) -> dict[int, int]:
    """The least id of each document's class, by comparing all pairs."""
    bags = {i: neardup.shingles(neardup.word_hashes(t)) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(bags[a][0]) and plain_similarity(bags[a], bags[b]) >= least - 1e-12:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def plain_similarity(a, b):
    """The definition, term by term."""
    x, y = (dict(zip(k.tolist(), c.tolist())) for k, c in (a, b))
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def family(seed: int, n: int, edits: int, repeat: bool) -> list[str]:
    deal = random.Random(seed)
    base = [f"w{seed}x{deal.randrange(5000)}" for _ in range(90)]
    if repeat:
        base += base[:30]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(deal.randrange(edits + 1)):
            words[deal.randrange(len(words))] = f"z{deal.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_similarity_is_the_definition():
    deal = np.random.default_rng(1)
    for _ in range(50):
        a, b = ((np.unique(deal.integers(0, 30, 12)).astype(np.uint64), None) for _ in range(2))
        a, b = ((k, deal.integers(1, 4, len(k)).astype(np.int32)) for k, _ in (a, b))
        assert neardup.similarity(a, b) == pytest.approx(plain_similarity(a, b))


def test_signatures_estimate_the_similarity():
    deal = np.random.default_rng(2)
    keys = deal.integers(0, 1 << 62, 400).astype(np.uint64)
    a = (np.sort(keys[:300]), deal.integers(1, 4, 300).astype(np.int32))
    b = (np.sort(keys[60:360]), deal.integers(1, 4, 300).astype(np.int32))
    sig = neardup.signatures([a, b], places=4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(plain_similarity(a, b), abs=0.03)


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 8)
    texts = {}
    for seed, (n, edits, repeat) in enumerate([(40, 6, False), (30, 5, True), (6, 2, False)]):
        for t in family(seed, n, edits, repeat):
            texts[len(texts)] = t
    texts |= {len(texts) + i: t for i, t in enumerate(["a b", "a b", "A  b!", "one", "two three four five six"])}
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in texts.items()], SCHEMA)
    rows, nodes = neardup.classes(docs)
    got = {r.doc_id: r.class_id for r in rows.join(nodes, ["d1", "d2"]).collect()}
    assert got == brute(texts)


def test_nothing_is_lost_on_an_ordinary_table(spark):
    """All pairs of the table compared one by one: every link of 0.8 or more is within a class."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text}
    bags = {i: neardup.shingles(neardup.word_hashes(t)) for i, t in texts.items()}
    by = {}
    for i, (keys, _) in bags.items():
        for k in keys.tolist():
            by.setdefault(k, []).append(i)
    pairs = {(a, b) for held in by.values() if len(held) > 1 for a in held for b in held if a < b}
    links = {(a, b) for a, b in pairs if neardup.similarity(bags[a], bags[b]) >= 0.8 - 1e-12}
    got = {r.doc_id: r.class_id for r in neardup.op4_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert len(links) > 90 and sum(got[a] == got[b] for a, b in links) == len(links)
    assert len(set(got.values())) == len({min(c) for c in _groups(got, links)})


def _groups(ids, links):
    up = {i: {i} for i in ids}
    for a, b in links:
        if up[a] is not up[b]:
            both = up[a] | up[b]
            for i in both:
                up[i] = both
    return {id(g): g for g in up.values()}.values()


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 8)
    texts = dict(enumerate(family(3, 50, 7, False)))
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in texts.items()], SCHEMA)
    rows, nodes = neardup.classes(docs)
    assert {r.doc_id: r.class_id for r in rows.join(nodes, ["d1", "d2"]).collect()} == brute(texts)


def test_what_is_settled_on_the_way_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: str(tmp_path))
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in enumerate(family(4, 20, 3, False))], SCHEMA)
    kept = neardup.drop_near_copies(docs)
    assert kept.count() >= 1 and 0 < len(list(tmp_path.iterdir())) <= 3


def test_columns_named_like_the_operators_own(spark):
    rows = [(1, "one two three four five six", 1), (1, "other words are here in this text", 2), (2, "one two three four five six", 3), (1, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node int").withColumns({"row": F.lit(1), "id": F.lit("x"), "of": F.lit(2), "d1": F.lit(3)})
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r._node for r in kept.collect()) == [1, 2, 4]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " .. "), (None, "some words here"), (7, "some words here"), (5, "same text twice over again"), (5, "same text twice over again"), (5, "other text"), (9, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1.0, "y") for i, t in rows], SCHEMA)
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, (r.text or "")[:10]) for r in kept.collect()), key=str)
    assert found == sorted([(1, ""), (2, ""), (3, " .. "), (7, "some words"), (5, "same text "), (5, "other text"), (9, "long long ")], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.drop_near_copies(empty).count() == 0


def test_components_of_a_chain(spark):
    deal = random.Random(3)
    ids = deal.sample(range(10**9), 60)
    links = list(zip(ids, ids[1:])) + [(-1, -2), (-2, -3), (5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({roots[i] for i in ids}) == 1 and len({roots[-1], roots[-2], roots[-3]}) == 1 and 5 not in roots
    assert roots[ids[0]] != roots[-1]

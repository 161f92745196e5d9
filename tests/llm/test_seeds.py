"""Seeds of the decontamination against brute force over all alignments."""

import random
from itertools import combinations

import pytest

from loomdoc.llm import decontam


def brute(doc, item):
    d, t = doc.split(), item.split()
    run, best = min(len(t), decontam.WINDOW), -1
    for shift in range(-len(t), len(d)):
        same = [0 <= j + shift < len(d) and d[j + shift] == x for j, x in enumerate(t)]
        best = max(best, *(sum(same[s : s + run]) for s in range(len(t) - run + 1)))
    return (best, run) if best >= decontam.LEAST * run else None


@pytest.mark.parametrize("n", range(decontam.SHORTEST, decontam.WINDOW + 3))
def test_each_accepted_pattern_holds_a_seed(n):
    run = min(n, decontam.WINDOW)
    found = decontam._variants([n] if n < decontam.WINDOW else [], decontam.MASKS, decontam.WINDOW, decontam.LEAST, 0)
    placed = [{x + at for x in m} for _, m, size, own in found if size in (0, n) for at in (range(n - m[-1]) if own < 0 else [own]) if size == n or n >= decontam.WINDOW]
    for others in range(n + 1):
        for way in combinations(range(n), others):
            equal = [i not in way for i in range(n)]
            if any(sum(equal[s : s + run]) >= decontam.LEAST * run for s in range(n - run + 1)):
                assert any(m.isdisjoint(way) for m in placed), way


def test_brute_force_over_all_alignments(spark):
    deal = random.Random(31)
    items = {n: " ".join(f"w{n}x{deal.randint(0, 9)}" for _ in range(n)) for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 22, 40)}
    docs = []
    for n, t in items.items():
        for k in range(40):
            w = t.split()
            for at in deal.sample(range(n), min(n, k % 5)):
                w[at] = "other"
            w = w[deal.choice([0, 0, 0, 1, 2]) : n - deal.choice([0, 0, 0, 1])]
            docs.append(" ".join(["before"] * deal.choice([0, 3]) + w + ["after"] * deal.choice([0, 3])))
        if n == 13:
            docs += [" ".join("other" if i in way else x for i, x in enumerate(t.split())) for way in ((4, 5), (5, 6), (5, 7), (6, 7), (7, 8))]
    want = {(i, n, *hit) for i, d in enumerate(docs) for n, t in items.items() if n >= decontam.SHORTEST and (hit := brute(d, t))}
    asked = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {tuple(r) for r in decontam.overlaps(*asked).select("doc_id", "item_id", "matched", "compared").collect()} == want
    assert {r.doc_id for r in decontam.drop_leaks(*asked).collect()} == set(range(len(docs))) - {x[0] for x in want}


def test_rows_that_share_an_id_with_a_leak_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, item), (1, "clean"), (None, f"so {item}"), (None, "clean too"), (2, None), (3, "x")], "doc_id long, text string")
    kept = decontam.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {tuple(r) for r in kept.collect()} == {(1, "clean"), (None, "clean too"), (2, None), (3, "x")} and kept.columns == docs.columns

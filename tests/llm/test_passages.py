"""Licence notices that are no line of their own, against all runs of words."""

import random
import textwrap

from loomdoc.llm import licenses

FILLER = "def main open the file and read all of it then close it for good while other words follow here in no order at all".split()


def brute(text, templates, threshold):
    w = licenses.normal(text)
    b, near = list(zip(w, w[1:])), []
    for name, body in templates.items():
        t, most = set(licenses.bigrams(body)), int((2 - threshold) / threshold * (len(licenses.normal(body)) - 1) + 1e-9)
        for i in range(len(b)):
            own = []
            for j in range(i, min(len(b), i + most)):
                g = set(b[i : j + 1])
                if b[i] in t and b[j] in t and 2.0 * len(g & t) >= threshold * (len(g) + len(t)):
                    own.append((-2.0 * len(g & t) / (len(g) + len(t)), -len(g), name, i, j + 1))
            near += [min(own)] if own else []
    kept = []
    for x in sorted(near):
        if all(x[3] > k[4] or k[3] > x[4] for k in kept):
            kept.append(x)
    return {(s + 1, e - s + 1, n, round(-d, 9), -g) for d, g, n, s, e in kept}


def test_wrapped_and_inline_notices(spark):
    deal = random.Random(1117)
    words = lambda n: " ".join(deal.choices(FILLER, k=n))
    comment = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 76))
    docs = [f"{words(300)}\n{comment(body)}\n{words(300)}" for body in licenses.TEMPLATES.values()]
    docs += [f"{words(200)}\nCopyright 2024 Acme. Released under the MIT License. {words(40)}\n{words(200)} this work is licensed under cc by 4.0 as {words(9)}", words(500), "", None]
    got = {}
    for r in licenses.passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.template] = r.dice
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[i][name] == 1.0
    assert got[len(docs) - 4] == {"mit-notice": 1.0, "cc-by-4.0-notice": 1.0} and set(got) == set(range(len(docs) - 3))
    lines = licenses.scan(spark.createDataFrame([(1, docs[1]), (2, docs[-4])], "doc_id long, text string"))
    assert lines.count() == 0  # no line and no whole text is near a template


def test_all_runs_of_words(spark):
    deal = random.Random(2026)
    known = {"a": "one two three four five", "b": "two three two three six seven one", "c": "four five one two"}
    docs = [" ".join(deal.choices("one two three four five six seven x".split(), k=deal.randint(0, 60))) for _ in range(150)]
    docs += [" ".join(" ".join(deal.choice(list(known.values())).split()[deal.randint(0, 1) :]) for _ in range(9)) for _ in range(50)]
    for threshold in (0.6, 0.8):
        got = {i: set() for i in range(len(docs))}
        for r in licenses.passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), known, threshold).collect():
            got[r.doc_id].add((r.first_word, r.n_words, r.template, round(r.dice, 9), r.n_bigrams))
        assert got == {i: brute(d, known, threshold) for i, d in enumerate(docs)} and sum(map(len, got.values())) > 100

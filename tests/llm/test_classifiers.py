import random
import re
import zlib

import numpy as np
import pytest
import regex

from loomdoc.llm import common, langid, quality, toxicity

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "sol", "ka") for b in ("da", "ne", "ri", "mon", "tu", "sha")]


def sentence(deal, n=40):
    return " ".join(deal.choice(WORDS) for _ in range(n)) + "."


def crowd(spark, n=400, bad=None, seed=5, label="quality", level=0):
    """Documents of which a third is spoiled by ``bad``, with labels that say so."""
    deal = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        text, spoiled = sentence(deal), i % 3 == 0
        rows.append((i, bad(deal, text) if spoiled else text, "extra", "extra"))
        marks.append((i, level if spoiled else 1 - level))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, label string"), spark.createDataFrame(marks, f"doc_id long, {label} int"), marks


def shout(deal, text):
    return " ".join(w.upper() + "!!" for w in text.split())


def insult(deal, text):
    words = text.split()
    words.insert(deal.randrange(len(words)), "vrak" + deal.choice(WORDS))
    return " ".join(words)


def test_quality_on_held_out_documents(spark):
    docs, labels, marks = crowd(spark, bad=shout)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(spark, model, docs["text"]).alias("s")).collect()}
    held = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= quality.ACCEPT) == (y == 1) for i, y in held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(y for _, y in marks)


def test_bradley_terry_is_the_minimum():
    deal = np.random.default_rng(3)
    better, worse = deal.normal(0.3, 1, (300, 3)), deal.normal(0, 1, (300, 3))
    w = quality.bradley_terry(better, worse)
    loss = lambda v: np.logaddexp(0, -(better - worse) @ v).mean() + 0.005 * v @ v
    assert all(loss(w) <= loss(w + deal.normal(0, 0.05, 3)) for _ in range(50))


def test_all_pairs_are_the_pairs_one_by_one(monkeypatch):
    deal = np.random.default_rng(4)
    better, worse = deal.normal(0.3, 1, (40, 3)), deal.normal(0, 1, (25, 3))
    i, j = (x.ravel() for x in np.meshgrid(range(40), range(25)))
    monkeypatch.setattr(quality, "TILE", 70)
    assert quality.bradley_terry_all(better, worse) == pytest.approx(quality.bradley_terry(better[i], worse[j]), abs=1e-7)


def test_pairs_far_apart_are_summed_too():
    """Utilities lie hundreds of cells apart."""
    deal = np.random.default_rng(6)
    better, worse = deal.standard_t(1.5, (90, 3)) * 9 + 0.5, deal.standard_t(1.5, (70, 3)) * 9
    i, j = (x.ravel() for x in np.meshgrid(range(90), range(70)))
    assert quality.bradley_terry_all(better, worse) == pytest.approx(quality.bradley_terry(better[i], worse[j]), abs=1e-7)


def test_ranks_by_counting_are_those_of_sorting(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 64)
    deal = np.random.default_rng(7)
    x = np.concatenate([deal.normal(0, 1e3, 500), deal.normal(0, 1e-9, 300), np.repeat([0.0, 2.5, -2.5], 50), [-0.0, 1e300, -1e300, 5e-324]])[:, None]
    sums = quality.sums_here(x, np.zeros(len(x), int))
    assert quality.ranked(sums, range(0, len(x), 7), np.zeros(1), np.ones(1), np.ones(1)) == np.sort(x[:, 0])[::7].tolist()


def test_quality_learns_from_all_labelled_documents(spark):
    """More than any bound of a sample: counts and sizes are those of all of them."""
    deal = random.Random(11)
    rows = [(i, " ".join(deal.choice(WORDS) for _ in range(3))) for i in range(26_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 7 > 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    learned = [(int(i % 7 > 0), set(t.split())) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.sizes == tuple(sum(y == k for y, _ in learned) for k in (0, 1))
    assert dict(model.known) == {w: tuple(sum(y == k and w in own for y, own in learned) for k in (0, 1)) for w in WORDS}


def test_quality_model_is_that_of_plain_pairs_and_sorting(spark):
    """Ratios, weights, threshold and slope from lists of the same rows, pair by pair."""
    spoil = lambda deal, text: shout(deal, text) if deal.random() < 0.5 else text + " " + text + " shopda"
    docs, labels, marks = crowd(spark, n=300, bad=spoil)
    model = quality.fit(docs.repartition(3), labels)
    texts, y = {r.doc_id: r.text for r in docs.collect()}, []
    rows, learned = [], [(texts[i], k) for i, k in marks if zlib.crc32(str(i).encode()) % 5]
    own = [set(re.findall(r"[^\W\d_]+", t.lower())) for t, _ in learned]
    for (text, k), words in zip(learned, own):
        others = [(o, w) for (_, o), w in zip(learned, own) if w is not words]
        sizes = [sum(o == kind for o, _ in others) for kind in (0, 1)]
        known = []
        for w in sorted(words):
            seen = [sum(o == kind and w in held for o, held in others) for kind in (0, 1)]
            if sum(seen) + 1 >= 20:
                known.append(np.log((seen[1] + 5) / (sizes[1] + 10)) - np.log((seen[0] + 5) / (sizes[0] + 10)))
        rows.append([*quality.features(text)[:-1], sum(known) / (len(known) + 20)])
        y.append(k)
    x, y = np.array(rows), np.array(y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    i, j = (v.ravel() for v in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    w = quality.bradley_terry(z[i], z[j])
    u, cut = z @ w, int((y == 0).sum())
    threshold = float(np.sort(u)[cut - 1 : cut + 1].mean())
    loss = lambda a: np.logaddexp(0, np.where(y == 1, -1, 1) * (a * (u - threshold) + np.log(0.3 / 0.7))).mean() + 1e-4 * a
    assert model.weights == pytest.approx(w, abs=1e-7) and model.threshold == pytest.approx(threshold, abs=1e-6)
    assert model.slope == min(np.geomspace(0.05, 20, 60), key=loss)


def test_labelled_rows_by_a_shuffle_are_those_by_a_broadcast(spark, odd_tables, monkeypatch):
    docs, labels = (spark.read.parquet(f"{odd_tables}/{t}.parquet") for t in ("documents", "labels"))
    few = common.labelled(docs, labels, "quality", 5, 0)
    monkeypatch.setattr(common, "MOST_SENT", 10)
    many = common.labelled(docs, labels, "quality", 5, 0)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() > 10


def test_words_tell_poor_text_of_ordinary_form(spark):
    """Poor documents look like good ones but for some of their words."""
    swap = lambda deal, text: " ".join(deal.choice(("clickna", "shopda", "freeri")) if deal.random() < 0.2 else w for w in text.split())
    docs, labels, marks = crowd(spark, bad=swap)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(spark, quality.fit(docs, labels), docs["text"]).alias("s")).collect()}
    held = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= quality.ACCEPT) == (y == 1) for i, y in held) / len(held) >= 0.97


def test_toxicity_on_held_out_documents(spark):
    docs, labels, marks = crowd(spark, bad=insult, label="toxic", level=1)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(spark, model, docs["text"]).alias("s")).collect()}
    held = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (y == 1) for i, y in held) / len(held)
    assert right >= 0.97
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_swapping_groups_changes_little():
    """A group term that goes with toxic documents in training weighs no more than its counterparts."""
    known = toxicity.Features({h: i for i, h in enumerate(sorted({x for w in ("women", "men", "vrakda", "lada") for x in toxicity.word_features(w)}))})
    toxic = [sorted(known.of("women vrakda"))] * 30 + [sorted(known.of("women vrakda lada"))] * 20
    clean = [sorted(known.of("lada"))] * 50
    y = np.array([1.0] * 50 + [0.0] * 50)
    n = len(known.among)
    x, z = known.of("women"), known.of("men")
    plain, _ = toxicity.fit_sparse(toxic + clean, y, [], n)
    fair, base = toxicity.fit_sparse(toxic + clean, y, [(sorted(x - z), sorted(z - x))], n)
    gap = lambda w: abs(sum(w[i] for i in x) - sum(w[i] for i in z))
    assert gap(fair) < 0.05 < gap(plain)
    assert base + sum(fair[i] for i in known.of("women lada")) < 0 < base + sum(fair[i] for i in known.of("women vrakda"))


def test_counterfactuals_spare_neutral_mentions(spark):
    """A group is named in all documents that were labelled toxic, a quarter of which have no other mark: only the penalty on swaps keeps neutral mentions clean."""
    deal, stems = random.Random(8), ("krazul", "moftig", "pelnax", "dwurbo", "quissy", "zonkeh")
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = sentence(deal, 20)[:-1].split()
        words[5:5] = (["women"] if bad or i % 30 == 1 else []) + ([stems[i % 18 // 3]] if bad and i % 4 else [])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = [sentence(deal, 10)[:-1] + " women " + sentence(deal, 10) for _ in range(60)]
    toxic = [sentence(deal, 10)[:-1] + " " + deal.choice(stems) + " " + sentence(deal, 10) for _ in range(60)]
    fair, unfair = (toxicity.fit(docs, labels, swap=x).scorer() for x in (toxicity.SWAP, 0.0))
    alarms = lambda of, texts: float((of(texts) >= 0.5).mean())
    assert alarms(fair, neutral) <= 0.1 and alarms(unfair, neutral) >= 0.8 and alarms(fair, toxic) >= 0.95


def test_swaps():
    assert list(toxicity.swaps("No group. Two women met")) == [(" two women met", f" two {o} met") for o in ("men", "girls", "boys", "transgender", "nonbinary")]


def test_language_on_held_out_documents(spark):
    deal = random.Random(9)
    own = {"aa": ["lada", "moni", "rata"], "bb": ["zuxik", "vorpel", "quam"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        words = [deal.choice(own[lang]) + deal.choice(own[lang]) for _ in range(12)]
        rows.append((i, " ".join(words), lang, 1))
    rows += [(1000, None, "aa", 1), (1001, "12 34 !", "bb", 1), (1002, "lada " * 1000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(spark, langid.fit(docs), docs["text"]).alias("p")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:300])
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002].lang_pred == "aa"
    assert all(0 <= p.score <= 1 for p in got.values())


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_without_labels_or_rows(spark, what):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], f"doc_id long, {what} int")
    op = quality if what == "quality" else toxicity
    for rows in (docs, docs.limit(0)):
        scores = [r.s for r in rows.select(op.score(spark, op.fit(rows, none), rows["text"]).alias("s")).collect()]
        assert all(s == pytest.approx(0.5) for s in scores)
    assert langid.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).langs == ()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Documents with nulls, very long, empty, repeated and equal texts, ids that repeat, and columns named like results."""
    at = tmp_path_factory.mktemp("odd")
    deal = random.Random(77)
    rows, marks = [], []
    for i in range(240):
        text = sentence(deal)
        text = shout(deal, text) if i % 4 == 0 else text
        text = insult(deal, text) if i % 5 == 0 else text
        rows.append((i, text, ("aa", "bb")[i % 2]))
        marks.append((i, int(i % 4 != 0), int(i % 5 == 0)))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "½ ² Ⅷ 12", "aa"), (1003, "word " * 60_000, None), (None, "no id here", "bb"), (7, rows[7][1], "aa"), (7, "other text", None), (1004, rows[9][1], "bb")]
    marks += [(7, 0, 1), (None, 1, 1), (1003, None, None), (1000, 0, 1)]
    spark.createDataFrame([(*r, 0.5, 9, True) for r in rows], "doc_id long, text string, lang string, score double, predicted int, held_out boolean").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def expected_rows(at, spark, mod, held, value):
    out = []
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        out.append((r.doc_id, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % mod == held, *value(r.text)))
    return sorted(out, key=str)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_toxicity_query_against_brute_force(spark, odd_tables, where):
    """Each score from the model's weights, feature by feature."""
    at = odd_tables if where == "odd" else where
    model = toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))

    def value(text):
        seen = {h for w in re.findall(r"\w+", (text or "").lower()) for h in toxicity.word_features(w)}
        s = 1 / (1 + np.exp(-(model.base + sum(model.weights[h] for h in seen if h in model.weights))))
        return round(float(s), 9), int(s >= 0.5)

    got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.op1_toxicity(spark, at).collect()]
    assert sorted(got, key=str) == expected_rows(at, spark, 5, 0, value)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_quality_query_against_brute_force(spark, odd_tables, where):
    """Each score from the documents' figures and the model's weights, one by one."""
    at = odd_tables if where == "odd" else where
    m = quality.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))

    def value(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        known = [np.log((m.known[w][1] + 5) / (m.sizes[1] + 10)) - np.log((m.known[w][0] + 5) / (m.sizes[0] + 10)) for w in words if w in m.known]
        x = [*quality.features(text)[:-1], sum(known) / (len(known) + 20)]
        u = sum((a - b) / c * d for a, b, c, d in zip(x, m.mean, m.scale, m.weights))
        s = 1 / (1 + np.exp(-(m.slope * (u - m.threshold) + np.log(0.3 / 0.7))))
        return round(float(s), 6), int(s >= 0.3)

    got = [(r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in quality.op5_quality(spark, at).collect()]
    assert sorted(got, key=str) == expected_rows(at, spark, 5, 0, value)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_language_query_against_brute_force(spark, odd_tables, where):
    """Each prediction from plain counts of words and n-grams of the documents that may be learned from."""
    at = odd_tables if where == "odd" else where
    rows = spark.read.parquet(f"{at}/documents.parquet").collect()
    letters = lambda t: regex.findall(r"\p{L}+", " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())))
    words, pieces = {}, {}
    for r in rows:
        if r.lang is not None and zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 != 2:
            for w in letters(r.text):
                words.setdefault(w, {}).setdefault(r.lang, 0)
                words[w][r.lang] += 1
                for g in langid.grams(w):
                    pieces.setdefault(g, {}).setdefault(r.lang, 0)
                    pieces[g][r.lang] += 1
    langs = sorted({x for w in words.values() for x in w})
    low = [{x: sum(w.get(x, 0) for w in known.values()) + 0.5 * (len(known) + 1) for x in langs} for known in (words, pieces)]

    def word(w, x):
        if w in words:
            return np.log((words[w].get(x, 0) + 0.5) / low[0][x])
        w, i, found = f" {w} ", 0, []
        while i < len(w):
            k = next((k for k in range(4, 0, -1) if w[i : i + k] in pieces and i + k <= len(w)), 0)
            found.append(np.log(((pieces[w[i : i + k]].get(x, 0) if k else 0) + 0.5) / low[1][x]))
            i += max(1, k)
        return sum(found) / len(found)

    cache = {}

    def value(text):
        found = letters(text)
        if not found:
            return "und", 0.0
        counts = {w: found.count(w) for w in set(found)} if len(found) < 3000 else {w: n for w, n in zip(*np.unique(found, return_counts=True))}
        mean = {x: sum(n * cache.setdefault((w, x), word(w, x)) for w, n in counts.items()) / len(found) for x in langs}
        best = max(langs, key=lambda x: (round(mean[x], 9), [-ord(c) for c in x]))
        return best, round(float(1 / sum(np.exp((mean[x] - mean[best]) * min(len(found), 50)) for x in langs)), 6)

    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.op9_langid(spark, at).collect()]
    assert sorted(got, key=str) == expected_rows(at, spark, 4, 2, value)


def test_no_language_and_no_word_is_left_out():
    counts = langid.words_of("½ ² Ⅷ 3x été")
    assert dict(counts) == {"x": 1, "été": 1}


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}q once", f"l{i % 450:03d}") for i in range(1350)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 450 and "once" in model.words.rows


def test_filters_keep_null_ids_and_empty_tables(spark, odd_tables):
    docs, labels = (spark.read.parquet(f"{odd_tables}/{t}.parquet") for t in ("documents", "labels"))
    for op in (quality.keep_good, toxicity.drop_toxic):
        kept = op(docs, labels)
        assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
        assert op(docs.limit(0), labels).count() == 0

"""The operators that SQL can express, over ordinary tables and over tables of edge cases."""

import base64
import hashlib
import sys
from pathlib import Path

import pytest

from loomdoc.llm import chat, decontam, licenses, mixing, topk, warc

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import from_spark, same  # noqa: E402

PAIRS = {
    "op2": (licenses.op2_licenses, licenses.ORACLE),
    "op3": (decontam.op3_decontam, decontam.ORACLE),
    "op6": (topk.op6_topk, topk.ORACLE),
    "op7": (warc.op7_warc, warc.ORACLE),
    "op8": (mixing.op8_mixing, mixing.ORACLE),
    "op10": (chat.op10_chat, chat.ORACLE),
}
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew a potent storm over distant hills"


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated rows and columns named like results."""
    at = tmp_path_factory.mktemp("edges")
    words = ITEM.split()
    changed = " ".join("x" if i in (4, 11) else w for i, w in enumerate(words))
    docs = [
        (1, None, "b"), (2, "", "a"), (3, " \t\n", None), (4, "Released under the MIT License.\nplain line\nReleased under the MIT License.", "a"),
        (5, f"before it. {ITEM} and after", "b"), (5, f"before it. {ITEM} and after", "b"), (6, f"Some {changed}. More", "c"), (7, " ".join(words[3:18]), "é"),
        (8, "word " * 30_000 + ITEM.upper(), "a"), (None, "null id here", "b"), (9, "licensed under the apache license version 2 0", None), (10, "tie\x0bone two", "zz"),
        (11, "short one two three four", "a"), (12, "a b c d e", "𝄞"), (13, "x y z\n * Licensed under CC\n * BY 4.0. And: released under the MIT\nLicense, and released under the mit license.", "b"),
    ]
    rows = [(i, t, s, "de", 1.5, "x") for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, source string, template string, size double, item_id string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "one two three four five"), (3, None), (4, "too short"), (1, ITEM), (5, "short one two three four")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(3, "u", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "a\r\nb", None), (5, "u", ""), (7, "v", "x" * 300_000), (8, "v", "y\r\n\r\nz")]
    spark.createDataFrame([(*p, "response") for p in pages], "page_id long, url string, html string, record_type string").write.parquet(f"{at}/pages.parquet")
    nan = float("nan")
    vectors = [(i, [((i * 7 + j * 3) % 5) / 4 - 0.5 for j in range(4)]) for i in range(120)] + [(200, None), (250, [nan, 0.0, 0.0, 1.0]), (251, [None, 1.0, 1.0, 1.0])]
    spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int").write.parquet(f"{at}/embeddings.parquet")
    turns = [
        (1, 0, "user", "hi <|im_end|> <\\| <\\\\|"), (1, 1, "assistant", "ho <"), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "first"),
        (4, 0, None, "no role"), (5, None, "user", "x"), (5, 0, "user", "y"), (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "system", "s" * 100_000), (None, 0, "user", "n"),
    ]
    spark.createDataFrame([(*t, True) for t in turns], "conv_id long, turn long, role string, text string, valid boolean").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", PAIRS)
def test_ordinary_tables(spark, name):
    got, want = same(spark, "/root/testdata/sf0.001", *PAIRS[name])
    assert got == want


@pytest.mark.parametrize("name", PAIRS)
def test_edge_cases(spark, edges, name):
    got, want = same(spark, edges, *PAIRS[name])
    assert got == want


@pytest.mark.parametrize("name", PAIRS)
def test_empty_tables(spark, edges, tmp_path, name):
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{edges}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = same(spark, tmp_path, *PAIRS[name])
    assert got == want and len(got[1]) == (1 if name == "op10" else 0)


def test_decontamination_finds_substitutions(spark, edges):
    docs, items = (spark.read.parquet(f"{edges}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()}
    assert {(5, 1), (6, 1), (7, 1), (8, 1), (11, 5)} <= hit and not {i for i, _ in hit} & {1, 2, 3, 4, 9, 12, None}
    assert decontam.drop_leaks(docs, items).columns == docs.columns
    assert {r.doc_id for r in decontam.drop_leaks(docs, items).collect()} == {1, 2, 3, 4, 9, 10, 12, 13, None}


def test_benchmark_in_parts(spark, edges, monkeypatch):
    docs, items = (spark.read.parquet(f"{edges}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = from_spark(decontam.overlaps(docs, items))
    monkeypatch.setattr(decontam, "MOST_SEEDS", 5)
    monkeypatch.setattr(decontam, "MOST_HITS", 0)
    assert from_spark(decontam.overlaps(docs, items)) == whole


def test_top_k_in_blocks(spark, edges, monkeypatch):
    vectors = spark.read.parquet(f"{edges}/embeddings.parquet")
    asked = vectors.where("vec_id % 3 = 0")
    whole = from_spark(topk.search(vectors, asked, 4))
    monkeypatch.setattr(topk, "FEW", 4)
    assert from_spark(topk.search(vectors.repartition(7), asked, 4, block=10)) == whole


def test_top_k_of_equal_and_large_scores(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(900, [1e6, -1e6]), (901, [1e6, 1e6]), (None, [1.0, 1.0]), (902, [1.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(5, [1.0, 2.0]), (901, [1e6, 1e6]), (902, [1.0])], "vec_id long, embedding array<double>"), 3).collect()]
    one = 256 * 10**6
    assert sorted(got) == [(5, 1, 901, one * 256 * 3), (5, 2, 0, 256 * 256 * 5), (5, 3, 1, 256 * 256 * 5), (901, 1, 0, one * 256 * 3), (901, 2, 1, one * 256 * 3), (901, 3, 2, one * 256 * 3)]


def test_mix_keeps_columns_and_budgets(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken"]
    by = {}
    for r in out.collect():
        assert 0 < r.taken <= 3 * r.size_
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    for target, size, taken in by.values():
        assert abs(taken - target) <= 0.5 + 1e-9 and target <= 3 * size
    assert from_spark(mixing.mix(docs)) == from_spark(out)


def test_ties_at_the_cut(spark, tmp_path):
    """Rows alike in id and size, among which the budget ends: as in SQL, and to the word."""
    rows = [(None, "a b c", "s")] * 40 + [(1, "a b", "s")] * 25 + [(i, "w " * (i % 7), "t") for i in range(30)] + [(9, "x y", "u")] * 3
    spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, taken int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = same(spark, tmp_path, *PAIRS["op8"])
    assert got == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for weights in ((5, 2, 1), (1, 7, 3), (1, 1, 9)):
        by = {}
        for r in mixing.mix(docs, weights).collect():
            by.setdefault(r.source, [r.target, 0])[1] += r.taken_
        assert by and all(abs(target - n) <= 0.5 + 1e-9 for target, n in by.values())


def test_mix_of_nothing(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("doc_id in (1, 2)")).count() == 0


def test_items_of_one_word_are_searched_if_asked_for(spark, edges):
    docs = spark.createDataFrame([(1, "plain words here"), (2, "a magic Word")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word!"), (2, "magic word"), (3, "")], "item_id long, text string")
    assert decontam.overlaps(docs, items).count() == 0
    assert {(r.doc_id, r.item_id, r.matched) for r in decontam.overlaps(docs, items, shortest=1).collect()} == {(2, 1, 1), (2, 2, 2)}


def test_archives_of_many_copies(spark, tmp_path, monkeypatch):
    """Groups beyond what is broadcast, one of them hot, come out as the broadcast has them."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i % 40}") for i in range(300)] + [(None, "u", "hot")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = from_spark(warc.op7_warc(spark, str(tmp_path)))
    monkeypatch.setattr(warc, "MOST_COPIES", 0)
    monkeypatch.setattr(warc, "LEAST_HOT", 50)
    assert from_spark(warc.op7_warc(spark, str(tmp_path))) == whole


def test_chat_round_trip(spark, edges):
    turns = spark.read.parquet(f"{edges}/conversations.parquet").where("conv_id in (1, 2, 4)")
    odd = spark.createDataFrame([(9, 0, "ro\nle <|x|> %0A%", "t"), (9, 1, "assistant", "<|im_start|>assistant\nno<|im_end|>")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read(chat.format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(odd))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hi <|im_end|> <\\| <\\\\|"), ("assistant", "ho <")]
    assert [tuple(t) for t in back[9].turns] == [("ro\nle <|x|> %0A%", "t"), ("assistant", "<|im_start|>assistant\nno<|im_end|>")]
    assert back[9].loss_texts == ["<|im_start|>assistant\nno<|im_end|>"] and back[2].loss_texts == [""]
    assert back[1].valid and back[2].valid and not back[4].valid
    assert back[1].formatted.count("<|im_start|>") == 2


def test_archives(spark, edges, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    pages = spark.read.parquet(f"{edges}/pages.parquet")
    warc.write(pages.coalesce(1), f"{tmp_path}/w")
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 1
    for p in files:
        data = p.read_bytes()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.records(data))
    back = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert bytes(back[8].payload) == b"y\r\n\r\nz" and back[8].payload_digest == base64.b32encode(hashlib.sha1(b"y\r\n\r\nz").digest()).decode()
    assert back[3].record_type == "revisit" and back[3].refers_to == 1 and back[2].url == "a%0D%0Ab"


@pytest.mark.parametrize("harm", ["cut", "length", "version", "digest", "late dictionary"])
def test_broken_archives(harm):
    import zstandard

    coder = zstandard.ZstdCompressor()
    good = warc.record(1, "u", b"abc", 3, warc.base32(hashlib.sha1(b"abc").digest()), None)
    bad = {"length": good.replace(b"abc\r\n\r\n", b"abcd\r\n\r\n"), "version": good.replace(b"WARC/1.1", b"WARC/9.9"), "digest": good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")}
    data = coder.compress(good) + coder.compress(bad.get(harm, good)) + warc.END
    if harm == "cut":
        data = data[:-12]
    if harm == "late dictionary":
        data += warc.dictionary_frame(b"words")
    with pytest.raises(warc.ArchiveError):
        for headers, block in warc.records(data):
            warc.read_record(headers, block)

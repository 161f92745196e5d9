import base64

import pytest
from pyspark.sql import functions as F

from loomdoc.operators.vector_search import VectorError
from loomdoc.sources import media
from loomdoc.sources.store import Store, StoreError
from loomdoc.streaming import changes


def test_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.create_database("shop", "Binary")
    store.create_database("shop")
    db = store.database("shop")
    rows = spark.createDataFrame([("a", 1, [1.0, 0.0], "red fox"), ("b", 2, [0.0, 1.0], "blue hen")], "id string, n int, vector array<double>, text string")
    things = db.create_collection("things", rows, spaces={"vector": {"dimensions": 2}})
    assert store.databases() == {"shop": "binary"} and db.collections() == ["things"] and things.version == 1
    things.insert({"id": "c", "n": 3, "vector": [1.0, 1.0], "text": "red hen"})
    things.insert({"id": "a", "n": 9, "vector": [1.0, 0.0], "text": "red fox"})
    things.update_one({"id": "b"}, {"$inc": {"n": 5}})
    assert {r.id: r.n for r in things.find().collect()} == {"a": 9, "b": 7, "c": 3} and things.read(1).count() == 2
    with pytest.raises(VectorError):
        things.insert({"id": "d", "n": 1, "vector": [1.0], "text": ""})
    assert things.count({"n": {"$gt": 3}}).first().n == 2 and things.find_one({"text": {"$regex": "hen"}}).first().id == "b"
    assert things.aggregate([{"$sort": {"n": -1}}, {"$limit": 1}]).first().id == "a" and things.ask("top 1 where n below 9 sort by n desc").first().id == "b"
    assert [r.id for r in things.query_vector([1.0, 0.0], 1)[0].collect()] == ["a"] and things.query_hybrid([1.0, 0.0], "hen", k=2).count() == 2
    things.create_index("text")
    assert things.explain({"text": "hen"})["plan"] == "INDEX_LOOKUP" and things.find({"text": "red hen", "n": {"$gt": 1}}).first().id == "c" and things.counts_agree({"text": "red fox"})
    assert things.indexes() == {"text": "text"} and things.validate_index("text").first().asDict() == {"valid": 3, "stale": 0, "extra": 0, "missing": 0}
    index = things.create_vector_index(cells=1)
    things.create_lexical_index()
    assert {(b["name"], b["kind"], b["state"]) for b in things.index_status()} == {("text", "lexical", "READY"), ("default", "vector", "READY")}
    things.create_index("text")
    assert things.query_vector([0.0, 1.0], 1, "ann", index)[1]["executed_mode"] == "ann"
    things.delete_many({"n": {"$lt": 5}})
    assert things.explain({"text": "hen"})["plan"] == "FULL_SCAN" and {b["state"] for b in things.index_status()} == {"STALE"}
    assert things.refresh_vector_index().state == "READY" and things.query_vector([0.0, 1.0], 5)[1]["executed_mode"] == "ann"
    assert {r.id for r in things.query_vector([0.0, 1.0], 5)[0].collect()} == {"a", "b"}
    assert things.query_vector([0.0, 1.0], 1, "auto", index)[1]["executed_mode"] == "exact"
    assert things.validate_index("text").first().extra == 1
    things.drop_index("text")
    assert things.indexes() == {}
    assert things.bulk_write([{"deleteOne": {"filter": {"id": "a"}}}, {"odd": 1}])["status"] == "partial"
    store.backup(f"{tmp_path}/b").collect()
    assert store.verify(f"{tmp_path}/b", "shop", "things")
    things.update_many({}, {"n": 0})
    assert not store.verify(f"{tmp_path}/b", "shop", "things")
    store.restore(f"{tmp_path}/b", "shop", "things")
    assert store.verify(f"{tmp_path}/b", "shop", "things") and things.history().count() >= 6
    with pytest.raises(StoreError):
        things.read(consistency="strong", floor=99)
    assert store.backups(str(tmp_path)) == ["b"] and store.sound(f"{tmp_path}/b")
    store.export_backup(f"{tmp_path}/b", f"{tmp_path}/c")
    store.delete_backup(f"{tmp_path}/b")
    assert store.backups(str(tmp_path)) == ["c"] and store.sound(f"{tmp_path}/c")
    db.drop_collection("things")
    with pytest.raises(StoreError):
        db["things"]
    again = db.create_collection("things", rows)
    assert again.read().count() == 2 and again.version == 1 and again.indexes() == {}
    store.drop_database("shop")
    assert store.databases() == {}


def test_versions_of_a_collection(spark, tmp_path, monkeypatch):
    """Writes add deltas, a version has one writer, and large deltas become a base."""
    from loomdoc.sources import store as module

    store = Store(spark, f"{tmp_path}/s")
    store.create_database("d")
    held = store.database("d").create_collection("c", spark.range(100).select("id", (F.col("id") % 5).alias("g"), F.lit(0).alias("n")))
    held.update_one({"id": 7}, {"$inc": {"n": 3}})
    held.insert({"id": 500, "g": 1, "n": 1})
    held.delete_one({"id": 8})
    body = held._body()
    assert len(body["deltas"]) == 3 and body["delta_rows"] == 3 and held.read().count() == 100
    assert held.read(2).where("n = 3").count() == 1 and held.read(2).count() == 100 and held.read(1).where("n = 0").count() == 100 and held.history().count() == 4
    assert held.insert_once(spark.createDataFrame([(500, 1, 1), (501, 0, 0), (7, 2, 9)], "id long, g long, n int"))["conflicts"] == 1
    stale = held._row()
    held.insert({"id": 502, "g": 1, "n": 1})
    monkeypatch.setattr(held, "_row", lambda: stale)
    with pytest.raises(module.ConflictError):
        held.insert({"id": 503, "g": 1, "n": 1})
    monkeypatch.undo()
    monkeypatch.setattr(module, "MOST_DELTA_ROWS", 5)
    held.update_many({"g": 1}, {"$set": {"n": 8}})
    assert held._body()["deltas"] == [] and held.read().where("n = 8").count() == 22
    monkeypatch.setattr(module, "MOST_NOTES", 2)
    for i in range(6):
        held.insert({"id": 600 + i, "g": 9, "n": i})
    assert len(store._epochs()) > 1 and held.read().where("g = 9").count() == 6 and store.databases() == {"d": "binary"}


def test_media(spark):
    body = bytes(range(256)) * 5
    files = spark.createDataFrame([("whole", bytearray(body)), ("short", bytearray(body)), ("clash", bytearray(body)), ("empty", bytearray())], "media_id string, content binary")
    manifests, chunks = media.chunked(files, 300)
    chunks = chunks.where("not (media_id = 'short' and index = 2)")
    other = base64.b64encode(b"other").decode()
    chunks = chunks.union(chunks.where("media_id = 'whole' and index = 1")).union(spark.createDataFrame([("clash", 0, other, "0")], chunks.schema))
    states = {r.media_id: (r.state, r.reason) for r in media.verified(manifests, chunks).collect()}
    assert states == {"whole": ("ready", None), "short": ("uploading", "media_chunks_missing"), "clash": ("failed", "media_chunk_conflict"), "empty": ("ready", None)}
    done = media.verified(manifests, chunks)
    assert {r.media_id: bytes(r.content) for r in media.content(done, chunks).collect()} == {"whole": body}
    assert {r.media_id for r in media.orphans(done, chunks).collect()} == {"clash"}
    assert media.moved("uploading", "verifying") == "verifying" and media.inline(files).where("size = 1280").count() == 3
    with pytest.raises(ValueError):
        media.moved("ready", "uploading")


def test_upkeep_of_media(spark):
    manifests = spark.createDataFrame([("a", 2, "uploading", 5), ("b", 1, "ready", 1), ("c", 2, "ready", 9), ("d", 1, "failed", 2), ("e", 1, "uploading", 90)], "media_id string, chunks int, state string, updated_at_ms long")
    chunks = spark.createDataFrame([("a", 0, "", "x"), ("b", 0, "", "x"), ("c", 0, "", "x"), ("d", 0, "", "x"), ("z", 0, "", "x")], "media_id string, index int, data string, sha256 string")
    ids = spark.createDataFrame([("a",), ("b",)], "media_id string")
    assert {r.media_id: r.state for r in media.aborted(manifests, ids).collect()} == {"a": "aborted", "b": "ready", "c": "ready", "d": "failed", "e": "uploading"}
    left = [{r.media_id for r in t.collect()} for t in media.deleted(manifests, chunks, ids)]
    assert left == [{"c", "d", "e"}, {"c", "d", "z"}]
    left = [{r.media_id for r in t.collect()} for t in media.cleaned(manifests, chunks, 50)]
    assert left == [{"b", "c", "e"}, {"b", "c"}]
    assert {r.media_id: (r.state, r.reason) for r in media.reconciled(manifests, chunks).collect() if r.state != "uploading"} == {"b": ("ready", None), "c": ("failed", "media_chunks_missing"), "d": ("failed", None)}


def test_queued_writes(spark, tmp_path):
    import time

    store = Store(spark, f"{tmp_path}/s")
    store.create_database("d")
    held = store.database("d").create_collection("c", spark.createDataFrame([("a", 1)], "id string, n int"))
    good, bad = held.insert_async({"id": "b", "n": 2}), held.insert_async({"id": "c", "n": "no number"})
    for _ in range(300):
        if store.op_status(bad)["status"] != "pending":
            break
        time.sleep(0.1)
    assert store.op_status(good) == {"status": "done", "version": 2} and store.op_status(bad)["status"] == "failed" and held.read().count() == 2
    with pytest.raises(StoreError):
        store.op_status("nothing")


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "id string, version long, value int, _deleted boolean"
    batches = [[("a", 1, 10, None), ("b", 1, 1, None)], [("a", 3, 30, None), ("b", 2, None, True)], [("a", 2, 20, None), ("b", 1, 1, None), ("c", 1, 5, None)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = changes.changes(spark, f"{tmp_path}/log", spark.createDataFrame([], schema).schema, 1)
        changes.upkeep(stream, f"{tmp_path}/now", f"{tmp_path}/cp", shards=2, then=lambda d, n: seen.append(d.count())).awaitTermination()
    assert {r.id: r.value for r in changes.current(spark, f"{tmp_path}/now").collect()} == {"a": 30, "c": 5}
    assert seen == [2, 2, 3]


def test_journal(spark):
    log = spark.range(5, 25).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("id"))
    assert changes.journal(log, 2)[0] == "Gap" and changes.journal(log, 24)[0] == "Covered"
    state, ids, cursor = changes.journal(log, 10, most=4)
    assert state == "More" and cursor == 14 and ids.count() == 3
    assert changes.journal(log, 14, most=100)[0] == "Covered"


def test_shell(spark, tmp_path):
    from loomdoc.sources.shell import CommandError, Shell

    sh = Shell(Store(spark, f"{tmp_path}/s"))
    with pytest.raises(StoreError):
        sh.run("find things")
    sh.run("create database shop")
    sh.run("use shop")
    sh.store.database("shop").create_collection("things", spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0])], "id string, n int, vector array<double>"))
    sh.run('update things {"id": "a"} {"$inc": {"n": 4}}')
    sh.run("put vector things b [0.5, 0.5]")
    assert sh.run("list databases") == ["shop"] and sh.run("list collections") == ["things"] and sh.run("show database") == "shop"
    assert [r.n for r in sh.run('find things {"n": {"$gt": 3}}').collect()] == [5] and sh.run("count things").first().n == 2
    assert [r.id for r in sh.run("query vector things [1, 1] --k 1 --metric cosine").collect()] == ["b"]
    assert sh.run('aggregate things [{"$sort": {"n": -1}}, {"$limit": 1}]').first().id == "a" and sh.run('explain things {"id": "a"}')["plan"] == "FULL_SCAN"
    sh.run('delete things {"id": "a"}')
    assert [r.id for r in sh.run("findOne things").collect()] == ["b"] and sh.run("ask things where n is 2").count() == 1
    for bad in ("dance", "find", "find things {", 'find things {} more', 'update things {"id": 1}', "query vector things [1] --odd 3"):
        with pytest.raises((CommandError, ValueError)):
            sh.run(bad)
    sh.run("drop database shop")
    assert sh.using is None


def test_windows_leave_late_rows_out(spark, tmp_path):
    """Windowed counts of a stream: rows later than the watermark are not counted."""
    schema = "at timestamp, kind string"
    for i, rows in enumerate(([("2024-01-01 00:05:00", "a"), ("2024-01-01 00:06:00", "a"), ("2024-01-01 00:07:00", "b")], [("2024-01-01 03:00:00", "a")], [("2024-01-01 00:08:00", "a"), ("2024-01-01 05:00:00", "b")], [("2024-01-01 09:00:00", "z")])):
        spark.createDataFrame(rows, "at string, kind string").select(F.to_timestamp("at").alias("at"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = changes.changes(spark, f"{tmp_path}/log", spark.createDataFrame([], schema).schema, 1)
        out = changes.windowed_counts(stream, "at", "kind").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        out.awaitTermination()
    got = {(r.start.hour, r.kind): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a"): 2, (0, "b"): 1, (3, "a"): 1, (5, "b"): 1}

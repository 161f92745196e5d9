"""Databases and collections as a base of Parquet and a log of changes.

Each write claims the next version of its collection, writes only the rows it changes (and
tombstones) as a delta, and then names the version in the manifest. A read is the base
without the changed keys, and their latest rows; a collection whose deltas are many or large
is written as a new base. Readers of an older version go on undisturbed, and time travel is
a read of an older manifest row. A version can be claimed once: of two writers one fails.
Everything goes through Spark's own readers, writers and file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import ann, english, filters, indexes, lexical, pipeline, vector_search, versions, writes

CONSISTENCY = {"strong": "strong", "linearizable": "strong", "sequential": "strong", "bounded": "bounded", "eventual": "eventual", "stale-ok": "stale-ok"}
#: Deltas, and rows of them (or a quarter of the base), beyond which a collection is written anew; manifest rows beyond which it is.
MOST_DELTAS, MOST_DELTA_ROWS, MOST_NOTES = 16, 10_000, 64
#: States of derived indexes.
STALE, READY = "STALE", "READY"
_MANIFEST = "seq long, kind string, database string, collection string, version long, body string"


class StoreError(ValueError):
    """A name or version that does not exist."""


class ConflictError(StoreError):
    """Another writer has taken the version."""


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """In files and row groups by ranges of the key, so that a read of few keys skips the others by their bounds."""
    return rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)


class Files:
    """The few things that are asked of a file system beside tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def claim(self, path: str) -> bool:
        """Create a file that must not be there yet: one of several callers succeeds."""
        at, fs = self._at(path)
        try:
            fs.create(at, False).close()
        except Exception as e:
            if fs.exists(at):
                return False
            raise StoreError(str(e)) from e
        return True

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)


class Store:
    """All databases below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._queue, self._tickets = ThreadPoolExecutor(1, "loomdoc-writes"), {}
        self._seen: tuple = ((), [])

    def later(self, write, *what) -> str:
        """Queue a write; one at a time runs. Returns a ticket for ``op_status``."""
        ticket = uuid.uuid4().hex
        self._tickets[ticket] = self._queue.submit(write, *what)
        return ticket

    def op_status(self, ticket: str) -> dict:
        """{status: pending, done or failed, with the version or the error}."""
        if ticket not in self._tickets:
            raise StoreError(f"no operation {ticket!r}")
        held = self._tickets[ticket]
        if not held.done():
            return {"status": "pending"}
        error = held.exception()
        return {"status": "failed", "error": str(error)} if error else {"status": "done", "version": held.result()}

    def _epochs(self) -> list[int]:
        return sorted(int(n.removeprefix("epoch=")) for n in self.files.names(f"{self.root}/_manifest") if n.startswith("epoch="))

    def manifest(self, all_epochs: bool = True) -> DataFrame:
        """Its rows; without ``all_epochs`` those of the last two, which hold the state."""
        epochs = self._epochs()
        paths = [f"{self.root}/_manifest/epoch={e}" for e in (epochs if all_epochs else epochs[-2:])]
        if not paths:
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(*paths)
        return rows.distinct() if all_epochs and len(epochs) > 1 else rows  # a new epoch repeats the state

    def _note(self, kind: str, database: str, collection: str | None = None, version: int = 0, body: Any = None) -> None:
        epoch = (self._epochs() or [0])[-1]
        path = f"{self.root}/_manifest/epoch={epoch}"
        row = [(time.time_ns(), kind, database, collection, version, json.dumps(body))]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(path)
        if len(self.files.names(path)) > MOST_NOTES and self.files.claim(f"{self.root}/_manifest/claim-{epoch + 1}"):
            # A new epoch starts with the state; a row that another writer adds to the last one meanwhile is still read.
            state = [tuple(r) for rows in self._states(("database", "collection", "index")).values() for r in rows]
            self.spark.createDataFrame(state, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest/epoch={epoch + 1}")

    def _rows(self) -> list:
        """The manifest rows that hold the state, read again only when there are other files than before."""
        files = tuple(sorted((e, n) for e in self._epochs()[-2:] for n in self.files.names(f"{self.root}/_manifest/epoch={e}")))
        if files != self._seen[0]:
            self._seen = (files, sorted(self.manifest(False).collect(), key=lambda r: r.seq))
        return self._seen[1]

    def _states(self, kinds: tuple[str, ...]) -> dict[str, list]:
        """The last manifest row of each object of the kinds that is not dropped, also not with what holds it."""
        state: dict[tuple, Any] = {}
        for r in self._rows():
            name = json.loads(r.body)["name"] if r.kind in ("index", "drop-index") else None
            if not r.kind.startswith("drop-"):
                state[r.kind, r.database, r.collection, name] = r
                continue
            here = (r.kind.removeprefix("drop-"), r.database, r.collection, name)
            inside = {"drop-database": lambda k, r=r: k[1] == r.database, "drop-collection": lambda k, r=r: k[1:3] == (r.database, r.collection)}.get(r.kind, lambda k, here=here: k == here)
            state = {k: v for k, v in state.items() if not inside(k)}
        return {kind: [v for k, v in state.items() if k[0] == kind] for kind in kinds}

    def _state(self, kind: str) -> list:
        return self._states((kind,))[kind]

    def create_database(self, name: str, kind: str = "binary") -> None:
        if name not in self.databases():
            self._note("database", name, body={"type": kind.lower()})

    def drop_database(self, name: str) -> None:
        self._note("drop-database", name)

    def databases(self) -> dict[str, str]:
        return {r.database: json.loads(r.body)["type"] for r in self._state("database")}

    def database(self, name: str) -> Database:
        if name not in self.databases():
            raise StoreError(f"no database {name!r}")
        return Database(self, name)

    # Backups: a folder with the rows of each collection and a table of their digests.

    def backup(self, target: str) -> DataFrame:
        """Copy the current rows of every collection; one row for each with its digest."""
        held = self._state("collection")
        if not held:
            raise StoreError("nothing to back up")
        rows = []
        for r in held:
            c = Collection(self, r.database, r.collection)
            c.read().write.mode("overwrite").parquet(f"{target}/{r.database}/{r.collection}")
            found = indexes.digest(self.spark.read.parquet(f"{target}/{r.database}/{r.collection}"), c.key).first()
            rows.append((r.database, r.collection, r.version, c.key, found.status, found.documents, found.digest))
        self.spark.createDataFrame(rows, "database string, collection string, version long, key string, status string, documents long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{target}/_digests")
        return self.backup_info(target)

    def backup_info(self, target: str) -> DataFrame:
        if not self.files.exists(f"{target}/_digests"):
            raise StoreError(f"no backup at {target}")
        return self.spark.read.parquet(f"{target}/_digests")

    def backups(self, folder: str) -> list[str]:
        return [n for n in sorted(self.files.names(folder)) if self.files.exists(f"{folder}/{n}/_digests")]

    def export_backup(self, target: str, to: str) -> None:
        """Copy a backup elsewhere, its digests last."""
        for r in self.backup_info(target).collect():
            self.spark.read.parquet(f"{target}/{r.database}/{r.collection}").write.mode("overwrite").parquet(f"{to}/{r.database}/{r.collection}")
        self.backup_info(target).coalesce(1).write.mode("overwrite").parquet(f"{to}/_digests")

    def delete_backup(self, target: str) -> None:
        self.backup_info(target)
        self.files.delete(target)

    def sound(self, target: str) -> bool:
        """Do the rows of a backup still have the digests that it names?"""
        for r in self.backup_info(target).collect():
            found = indexes.digest(self.spark.read.parquet(f"{target}/{r.database}/{r.collection}"), r.key).first()
            if (found.documents, found.digest) != (r.documents, r.digest):
                return False
        return True

    def verify(self, target: str, database: str, collection: str) -> bool:
        """Does a backup equal the collection?"""
        c = Collection(self, database, collection)
        saved = self.spark.read.parquet(f"{target}/{database}/{collection}")
        return indexes.digest(saved, c.key).first() == indexes.digest(c.read(), c.key).first()

    def restore(self, target: str, database: str, collection: str) -> None:
        Collection(self, database, collection).replace(self.spark.read.parquet(f"{target}/{database}/{collection}"))


class Database:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def collections(self) -> list[str]:
        return sorted(r.collection for r in self.store._state("collection") if r.database == self.name)

    def create_collection(self, name: str, rows: DataFrame, key: str = "id", spaces: dict | None = None) -> Collection:
        """A collection with its first rows, whose types it keeps; of equal keys the last counts. Creating it again changes nothing; after a drop it starts anew in a folder of its own."""
        c = Collection(self.store, self.name, name)
        if name not in self.collections():
            path = f"{self.store.root}/{self.name}/{name}/{uuid.uuid4().hex}"
            base = f"{path}/base=1"
            by_key(writes.newest(rows, key), key).write.parquet(base)
            self.store._note("collection", self.name, name, 1, {"key": key, "spaces": spaces or {}, "path": path, "base": base, "base_rows": self.store.spark.read.parquet(base).count(), "deltas": [], "delta_rows": 0})
        return c

    def drop_collection(self, name: str) -> None:
        self.store._note("drop-collection", self.name, name)

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections():
            raise StoreError(f"no collection {name!r}")
        return Collection(self.store, self.name, name)


class Collection:
    """Reads and writes of one collection. Reads are lazy DataFrames; each write makes a version."""

    def __init__(self, store: Store, database: str, name: str):
        self.store, self.database, self.name, self.spark = store, database, name, store.spark

    def _row(self):
        row = next((r for r in self.store._state("collection") if (r.database, r.collection) == (self.database, self.name)), None)
        if row is None:
            raise StoreError(f"no collection {self.name!r}")
        return row

    def _body(self) -> dict:
        return json.loads(self._row().body)

    @property
    def version(self) -> int:
        return self._row().version

    @property
    def key(self) -> str:
        return self._body()["key"]

    def history(self) -> DataFrame:
        """The versions written so far."""
        path = self._body()["path"]
        rows = self.store.manifest().where((F.col("kind") == "collection") & (F.col("database") == self.database) & (F.col("collection") == self.name))
        return rows.where(F.get_json_object("body", "$.path") == path).select("version", "seq", "body")

    def read(self, version: int | None = None, consistency: str = "eventual", floor: int | None = None) -> DataFrame:
        """The current rows, or those of an older version. A strong read raises if the version is below the floor."""
        now = self._row()
        at = version or now.version
        if CONSISTENCY.get(consistency, "eventual") == "strong" and floor is not None and at < floor:
            raise StoreError(f"version {at} is below {floor}")
        if at != now.version:
            now = self.history().where(F.col("version") == at).orderBy("seq").first()
            if now is None:
                raise StoreError(f"no version {at}")
        return self._resolved(json.loads(now.body))

    def _resolved(self, body: dict) -> DataFrame:
        base = self.spark.read.parquet(body["base"])
        if not body["deltas"]:
            return base
        key = body["key"]
        log = self._log(body)
        changed = versions.latest(log, key, seq="_seq", deleted=None, by=F.col("_version"))
        live = changed.where(~F.col("_deleted")).drop("_deleted", "_version", "_seq")
        return base.join(changed.select(key), key, "left_anti").unionByName(live, allowMissingColumns=True).select(*dict.fromkeys([*base.columns, *live.columns]))

    def _log(self, body: dict) -> DataFrame:
        parts = [self.spark.read.parquet(p).withColumn("_version", F.lit(int(p.rsplit("=", 1)[1]))) for p in body["deltas"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _write(self, upserts: DataFrame | None, gone: DataFrame | None = None) -> int:
        """Claim the next version and write rows and the keys of removed ones as its delta."""
        now = self._row()
        body, at = json.loads(now.body), now.version + 1
        parts = []
        if upserts is not None:
            parts.append(upserts.withColumn("_deleted", F.lit(False)))
        if gone is not None:
            parts.append(gone.select(body["key"]).withColumn("_deleted", F.lit(True)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("_seq", F.monotonically_increasing_id())
        path = self._claimed(body, at, "delta")
        rows.write.parquet(path)
        body["deltas"].append(path)
        body["delta_rows"] += self.spark.read.parquet(path).count()
        if len(body["deltas"]) > MOST_DELTAS or body["delta_rows"] > max(MOST_DELTA_ROWS, body["base_rows"] // 4):
            body = self._based(body, self._resolved(body), f"{body['path']}/base={at}")
        self.store._note("collection", self.database, self.name, at, body)
        return at

    def _claimed(self, body: dict, at: int, kind: str) -> str:
        if not self.store.files.claim(f"{body['path']}/claims/{at}"):
            raise ConflictError(f"version {at} of {self.name!r} was taken by another writer")
        return f"{body['path']}/{kind}={at}"

    def _based(self, body: dict, rows: DataFrame, path: str) -> dict:
        by_key(rows, body["key"]).write.parquet(path)
        return body | {"base": path, "base_rows": self.spark.read.parquet(path).count(), "deltas": [], "delta_rows": 0}

    def replace(self, rows: DataFrame) -> int:
        """A new base with these rows alone."""
        now = self._row()
        body, at = json.loads(now.body), now.version + 1
        body = self._based(body, writes.newest(rows, body["key"]), self._claimed(body, at, "base"))
        self.store._note("collection", self.database, self.name, at, body)
        return at

    def compact(self) -> int:
        return self.replace(self.read())

    def insert(self, document: dict) -> int:
        return self.insert_many(self.spark.createDataFrame([document], self.read().schema))

    def insert_many(self, rows: DataFrame) -> int:
        body = self._body()
        rows = writes.with_id(rows, body["key"]) if dict(rows.dtypes).get(body["key"]) == "string" else rows
        if body["spaces"]:
            good, bad = vector_search.split_by_schema(rows, {n: vector_search.Space(**s) for n, s in body["spaces"].items()})
            if not bad.isEmpty():
                raise vector_search.VectorError("a row does not fit the vector spaces")
            rows = good
        return self._write(writes.newest(rows, body["key"]))

    insert_vector = insert

    def insert_async(self, document: dict) -> str:
        """A ticket for an insert that is written in the background."""
        return self.store.later(self.insert, document)

    def insert_once(self, rows: DataFrame) -> dict:
        """Idempotent insert: {new, conflicts, version}; nothing is written if all rows are known."""
        new, clash = writes.insert_once(self.read(), rows, self.key)
        conflicts, fresh = clash.count(), new.count()
        return {"new": fresh, "conflicts": conflicts, "version": self._write(new) if fresh else self.version}

    def _changed(self, hit: DataFrame, update: dict) -> int:
        return self._write(hit.withColumns(writes.changed(update, hit.schema, F.lit(True))))

    def update_one(self, query: Any, update: dict) -> int:
        return self._changed(self.find_one(query), update)

    def update_many(self, query: Any, update: dict) -> int:
        return self._changed(self.find(query), update)

    def delete_one(self, query: Any) -> int:
        return self._write(None, self.find_one(query))

    def delete_many(self, query: Any) -> int:
        return self._write(None, self.find(query))

    def bulk_write(self, operations: list[dict]) -> dict:
        rows, errors = writes.bulk(self.read(), operations, self.key)
        return {"status": "partial" if errors else "ok", "errors": errors, "version": self.replace(rows)}

    # Reads. An index that is as new as the collection, on a field that the filter fixes, gives the ids.

    def _filtered(self, query: Any) -> DataFrame:
        rows = self.read()
        ready = {b["field"]: b for b in self._ready("field")}
        at = filters.access_path(query, ready)
        if at is not None:
            value = filters.fixed(filters.parse(query))[at]
            rows = indexes.narrowed(rows, self.spark.read.parquet(ready[at]["path"]), value, self.key, ready[at]["buckets"])
        return rows

    def find(self, query: Any = None, limit: int = -1, offset: int = 0) -> DataFrame:
        return filters.find(self._filtered(query), query, limit, offset, self.key)

    def find_one(self, query: Any = None) -> DataFrame:
        return filters.find_one(self._filtered(query), query, self.key)

    def count(self, query: Any = None) -> DataFrame:
        return filters.count(self._filtered(query), query)

    def counts_agree(self, query: Any = None) -> bool:
        """Do an indexed count and a scan find as many rows?"""
        return self.count(query).first().n == filters.find(self.read(), query).count()

    def aggregate(self, stages: list) -> DataFrame:
        return pipeline.aggregate(self.read(), stages, self.key)

    def aggregate_counted(self, stages: list) -> tuple[DataFrame, DataFrame]:
        return pipeline.aggregate_counted(self.read(), stages, self.key)

    def explain(self, query: Any = None, limit: int = -1, offset: int = 0, consistency: str = "eventual") -> dict:
        return filters.explain(query, limit, offset, consistency, [b["field"] for b in self._ready("field")])

    def ask(self, question: str) -> DataFrame:
        return english.ask(self.read(), question, self.key)

    def query_vector(self, vector: list[float], k: int = 10, mode: str = "auto", index: ann.Index | None = None, **how) -> tuple[DataFrame, dict]:
        """Exact or approximate search, by the index given or the ready one over the column. A filter with an indexed field narrows the rows first."""
        index = index or self._vector_index(how.get("name") or how.get("column", "vector"))
        if index is not None and index.source_version != self.version:
            index.state = STALE
        return ann.route(self._filtered(how.get("query")), vector, index, mode, k=k, key=self.key, **how)

    def query_hybrid(self, vector: list[float], text: str, **how) -> DataFrame:
        words = next((lexical.LexicalIndex.of(b["manifest"]) for b in self._ready("lexical") if b["field"] == how.get("text_column", "text")), None)
        return lexical.hybrid(self.read(), vector, text, key=self.key, index=words, **how)

    # Derived indexes of three kinds: field (postings), vector (cells) and lexical.

    def _entries(self) -> Iterator[dict]:
        for r in self.store._state("index"):
            if (r.database, r.collection) == (self.database, self.name):
                yield json.loads(r.body) | {"built": r.version}

    def _ready(self, kind: str) -> list[dict]:
        now = self.version
        return [b for b in self._entries() if b["kind"] == kind and b["built"] == now]

    def index_status(self) -> list[dict]:
        """name, kind, field and state (READY or STALE) of each index."""
        now = self.version
        return [{"name": b["name"], "kind": b["kind"], "field": b["field"], "state": READY if b["built"] == now else STALE} for b in sorted(self._entries(), key=lambda b: b["name"])]

    def _add_index(self, kind: str, name: str, field: str, **body) -> None:
        self.store._note("index", self.database, self.name, self.version, {"kind": kind, "name": name, "field": field, **body})

    def _index_path(self) -> str:
        return f"{self._body()['path']}/index/{uuid.uuid4().hex}"

    def create_index(self, field: str, name: str | None = None) -> str:
        options, path = indexes.IndexOptions(field, name or field), self._index_path()
        buckets = indexes.write_postings(self.read(), path, field, self.key)
        self._add_index("field", options.name, field, path=path, buckets=buckets)
        return options.name

    def rebuild_index(self, name: str) -> str:
        b = self._entry(name)
        if b["kind"] == "field":
            return self.create_index(b["field"], name)
        if b["kind"] == "lexical":
            self.create_lexical_index(b["field"], name)
        else:
            self.create_vector_index(name, b["field"], ann.Index.of(b["manifest"]).metric)
        return name

    def _entry(self, name: str) -> dict:
        found = next((b for b in self._entries() if b["name"] == name), None)
        if found is None:
            raise StoreError(f"no index {name!r}")
        return found

    def indexes(self) -> dict[str, str]:
        """Name and field of the field indexes; ``index_status`` tells of all kinds."""
        return {b["name"]: b["field"] for b in self._entries() if b["kind"] == "field"}

    def validate_index(self, name: str) -> DataFrame:
        b = self._entry(name)
        return indexes.validate(self.read(), self.spark.read.parquet(b["path"]).select("id", "value"), b["field"], self.key)

    def drop_index(self, name: str) -> None:
        self._entry(name)
        self.store._note("drop-index", self.database, self.name, self.version, {"name": name})

    def create_vector_index(self, name: str = "default", column: str = "vector", metric: str = "cosine", **how) -> ann.Index:
        index = ann.build(self.read(), self._index_path(), name, column, metric, self.key, version=self.version, **how)
        self._add_index("vector", name, column, manifest=index.manifest())
        return index

    def _vector_index(self, column: str) -> ann.Index | None:
        return next((ann.Index.of(b["manifest"]) for b in self._ready("vector") if b["field"] == column), None)

    def refresh_vector_index(self, name: str = "default") -> ann.Index:
        """Bring a vector index up to now by the deltas since it was built; a gap (a new base) makes it FAILED, and it must be rebuilt."""
        b, body = self._entry(name), self._body()
        index = ann.Index.of(b["manifest"])
        missed = [p for p in body["deltas"] if int(p.rsplit("=", 1)[1]) > b["built"]]
        if len(missed) != self.version - b["built"]:
            index.state = "FAILED"
            return index
        if missed:
            log = versions.latest(self._log(body | {"deltas": missed}), body["key"], seq="_seq", deleted=None, by=F.col("_version"))
            now = self.read().join(log.where(~F.col("_deleted")).select(body["key"]), body["key"], "left_semi")
            ann.upsert_index(self.spark, index, now, self.version, log.select(body["key"]))
            self._add_index("vector", name, b["field"], manifest=index.manifest())
        return index

    def create_lexical_index(self, column: str = "text", name: str = "text") -> lexical.LexicalIndex:
        index = lexical.build_lexical(self.read(), self._index_path(), self.key, column, version=self.version)
        self._add_index("lexical", name, column, manifest=index.manifest())
        return index

    def digest(self) -> DataFrame:
        return indexes.digest(self.read(), self.key)

    def merge_log(self, log: DataFrame, seq: str | None = None) -> int:
        """Resolve a change log and write its latest versions as the next base."""
        return self.replace(versions.latest(versions.visible(log), self.key, seq))

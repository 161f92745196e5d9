r"""WARC archives in Zstandard, written by Spark and read back record by record.

An archive starts with a skippable frame that holds the dictionary; each record is one
frame of its own, made with it. Archives are written as values of Spark's text sink, one to
a file and about ``ARCHIVE_BYTES`` long: the line end that the sink adds is an empty
skippable frame, so each file is a plain sequence of frames, goes to any file system that
Spark knows, and is committed with the job. The binary value becomes a string without any
change of its bytes: Spark's strings are byte arrays, casts between the two share them, and
the text sink writes them as they are, valid UTF-8 or not. The reader walks the frames by their headers,
takes the dictionary from the first, decodes record by record and validates version,
headers, lengths and digests.

Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id
is the response, the others are revisits of it, whose block is the HTTP head alone.

Defined cases: null html is an empty payload; null urls have no target header, line ends in
urls are written as %0D and %0A; rows with equal page_id and payload are all responses if
theirs is the smallest id; a null page_id revisits any other id and is the response if there
is none; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import LEAST_HOT, MOST_HOT, bound_batches, scratch, settle, share, table, tidy

#: Bytes of an archive before it is closed (one record more at most).
ARCHIVE_BYTES = 8 << 20
#: The dictionary's bytes, and the whole payloads, and bytes of them together, that it is trained on at most; only compression depends on them.
DICTIONARY_BYTES, MOST_SAMPLES, SAMPLE_BYTES = 32 << 10, 400, 8 << 20
#: Rows (about 60 bytes each) of repeated payloads that are broadcast; more go through a join.
MOST_COPIES = 100_000
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the formats.
MAGIC, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
END = struct.pack("<II", SKIPPABLE, 0)  # an empty skippable frame, which is also valid UTF-8


class ArchiveError(ValueError):
    """What the reader found wrong, and where."""


def train(pages: DataFrame) -> bytes:
    """A dictionary of a bounded sample of payloads; raw bytes if they are too few to train on."""
    n = pages.count()
    some = pages.where(share(F.col("page_id").cast("string")) < 2 * MOST_SAMPLES / max(1, n)) if n > 2 * MOST_SAMPLES else pages
    some = some.select(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("b")).select("b", F.sha1("b").alias("h"), F.length("b").alias("n")).where("n > 0")
    sizes = some.select("h", "n").distinct().orderBy("h").limit(MOST_SAMPLES).collect()
    chosen, left = [], SAMPLE_BYTES
    for r in sizes:
        if r.n <= left:
            chosen, left = [*chosen, r.h], left - r.n
    samples = [bytes(r.b) for r in some.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).orderBy("h").collect()] if chosen else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(s[:256] for s in samples) + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\n")[-DICTIONARY_BYTES:]


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: tuple[int | None] | None) -> bytes:
    """One WARC record; refers: the page that a revisit refers to, as a tuple of one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers:
        lines += [f"WARC-Refers-To: {_urn(refers[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is it skippable) of each frame, from the frames' and blocks' headers alone."""
    at = 0
    while at < len(data):
        start = at
        if at + 8 > len(data):
            raise ArchiveError(f"a frame is cut at {start}")
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIPPABLE <= magic <= SKIPPABLE + 15:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == MAGIC:
            checksum = data[at + 4] >> 2 & 1
            at += zstandard.frame_header_size(data[at : at + 18])
            last = 0
            while not last:
                if at + 3 > len(data):
                    raise ArchiveError(f"the frame at {start} is cut")
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ArchiveError(f"the frame at {start} has a reserved block")
                at += 3 + (1 if kind == 1 else size)
            at += 4 * checksum
        else:
            raise ArchiveError(f"no frame starts at {start}")
        if at > len(data):
            raise ArchiveError(f"the frame at {start} is cut")
        yield start, at, magic != MAGIC


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"no WARC record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"no header: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip(" \t")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"a record lacks {name}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"a record of {len(rest) - 4} bytes says {size}")
    return headers, rest[:-4]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive."""
    walk = frames(data)
    coder = zstandard.ZstdDecompressor()
    for i, (start, end, skip) in enumerate(walk):
        if skip:
            if struct.unpack_from("<I", data, start)[0] == DICTIONARY:
                if i:
                    raise ArchiveError("the dictionary is not in the leading frame")
                body = data[start + 8 : end]
                if body[:4] == struct.pack("<I", MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            continue
        try:
            raw = coder.decompressobj().decompress(data[start:end])
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the frame at {start} is broken: {e}") from e
        yield parse(raw)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def read_record(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; lengths and digests are checked."""
    head, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not head.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        raise ArchiveError(f"{headers['warc-record-id']} has no HTTP head")
    size = int(sizes[0])
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ArchiveError(f"{headers['warc-record-id']}: the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ArchiveError(f"{headers['warc-record-id']}: a revisit with a payload or without a reference")
    refers = _page_of(headers["warc-refers-to"]) if kind == "revisit" else None
    return _page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), payload if kind == "response" else None, size, digest, kind, refers


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write page_id, url, html as archives below ``path``.

    Groups of equal payloads go to the pages by broadcast: all of them up to MOST_COPIES, and
    always those that hold over a MOST_HOT-th of the pages. Only beyond that are payloads
    shuffled, and then without any key that holds more than such a part.
    """
    bound_batches(pages.sparkSession)
    with tidy(pages.sparkSession):
        _write(pages, path, least)


def _write(pages: DataFrame, path: str, least: int) -> None:
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train(pages))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = settle(groups, "copies")
    if groups.count() <= MOST_COPIES:
        joined = rows.join(F.broadcast(groups.drop("n")), "sha1", "left")
    else:
        limit = max(LEAST_HOT, pages.count() // MOST_HOT)
        hot = F.broadcast(groups.where(F.col("n") > limit).select("sha1", F.col("first").alias("_hot"), F.lit(True).alias("_is_hot")))  # MOST_HOT rows at most
        joined = rows.join(hot, "sha1", "left")
        others = joined.where("_is_hot is null").join(groups.where(F.col("n") <= limit).drop("n"), "sha1", "left")
        joined = joined.where("_is_hot").withColumn("first", F.col("_hot")).unionByName(others)
    joined = joined.selectExpr("page_id", "url", "first", "first is not null and not (first <=> page_id) as again", "length(payload) as size", "sha1", "payload")

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = dictionary.value
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known), write_checksum=True)
        lead = dictionary_frame(known)
        held, size = [lead], 0
        for b in batches:
            for page, url, first, again, n, sha1, body in b.itertuples(index=False, name=None):
                page = None if pd.isna(page) else int(page)
                text = record(page, url if isinstance(url, str) else None, bytes(body), int(n), base32(bytes.fromhex(sha1)), (int(first),) if again else None)
                held.append(frame := coder.compress(text))
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"value": [b"".join(held)]})
                    held, size = [lead], 0
        if size:
            yield pd.DataFrame({"value": [b"".join(held)]})

    made = joined.mapInPandas(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).mode("append").text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (only if asked for), payload_bytes, payload_digest, record_type, refers_to of each record. Archives come to Python one or a few at a time."""
    bound_batches(spark)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out, size = [], 0
                for headers, block in records(bytes(content)):
                    if headers["warc-type"] in ("response", "revisit"):
                        row = read_record(headers, block)
                        out.append(row if payloads else (*row[:2], None, *row[3:]))
                        size += len(row[2] or b"") if payloads else 0
                        if size > ARCHIVE_BYTES:
                            yield _framed(out, names)
                            out, size = [], 0
                yield _framed(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(decoded, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long").select(*names if payloads else [n for n in names if n != "payload"])


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"), payload_bytes=out["payload_bytes"].astype("int64"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, payloads=False).drop("url")


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex from pages),
bits as (
    select *, array_to_string(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') as b from p),
digests as (
    select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (
        16 * substr(b, (5 * i + 1)::int, 1)::int + 8 * substr(b, (5 * i + 2)::int, 1)::int + 4 * substr(b, (5 * i + 3)::int, 1)::int + 2 * substr(b, (5 * i + 4)::int, 1)::int + substr(b, (5 * i + 5)::int, 1)::int)::int + 1, 1)), '') as digest from bits),
firsts as (select *, min(page_id) over (partition by digest) as first from digests)
select page_id, strlen(h)::bigint as payload_bytes, digest as payload_digest,
       case when first = page_id then 'response' else 'revisit' end as record_type, case when first != page_id then first end as refers_to
from firsts
"""

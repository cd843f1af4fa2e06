"""WARC archives with a two-level capture index.

Writing.  Payload digests are folded to the groups that occur more than once;
a join tells every page its response, and the tasks of that join write one
gzip member per record into archive files of their own, together with a table
of captures.  A file carries the attempt's number and only files of successful
tasks are named in the table, so a lost executor leaves no trace in it.

Index.  Captures are sorted by reversed-host key across the cluster; each task
writes one shard: compressed blocks of lines, and a sparse directory with the
first key, place and length of every block.

Reading.  Keys are routed to shards by the shards' first and last keys (one
pair per shard), binary-searched in the shard's directory, and only the blocks
that can hold them are read.  The captures found are then sorted by file and
place, so neighbouring records are fetched by one range read.

Tasks reach the archive folder through ``pyarrow.fs``, so it may be any store
that has a URI there (local and mounted paths, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, short_batches

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
NAMELESS_ID = "urn:x-place:"

#: Captures a shard holds at least, and shards an index has at most: the driver's list of
#: them, which every look-up task gets, stays at a few megabytes and shards grow instead.
ROWS_PER_SHARD = 16_384
MOST_SHARDS = 16_384
ROWS_PER_BLOCK = 512
MOST_FILE_BYTES = 1 << 30
MOST_RANGE_BYTES = 4 << 20

CAPTURE = "key string, page_id string, file string, offset long, length long, record_type string, payload_digest string"


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder and, per index shard, ``(first key, last key, file)`` in key order."""

    folder: str
    shards: tuple[tuple[str, str, str], ...]


def store(folder: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!//)/?", "file:///", folder)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query.  Null counts as empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    tail = F.regexp_replace(rest, r"^[^/?#:]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str, place: str = "") -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block is the HTTP header alone.

    A record without an id is named by its ``place`` in the archive.
    """
    name = NAMELESS_ID + place if page_id is None else RECORD_ID + page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
            f"WARC-Target-URI: {_header_text(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response"]
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record: ids, type, digest, full payload length and the payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    own = lambda name: fields[name][len(RECORD_ID) + 1:-1] if fields.get(name, "").startswith("<" + RECORD_ID) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    sound = revisit or (len(payload) == length and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return {"page_id": own("WARC-Record-ID"), "uri": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": own("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": length,
            "payload": None if revisit else payload, "sound": sound}


def with_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Pages with their digest and, for those that revisit another page, that page's id.

    Payloads are equal when SHA-1, SHA-256 and length agree: files are known
    that differ and share a SHA-1.  Digests are folded before the shuffle; only
    groups of two or more are joined back, so a payload shared by very many
    pages is a skewed join key.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=payload_col).select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = (rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
            .withColumn("sha256", F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    same = ["sha", "sha256", "bytes"]
    shared = (rows.filter(F.col("bytes") >= least_bytes).groupBy(*same)
              .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return rows.join(shared, same, "left").select(
        "page_id", "url", "html", "sha",
        F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
        .cast("string").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one record per row and the capture index into ``folder``; runs at once, as any writer.

    Of payloads that are equal and at least ``least_bytes`` long the one with
    the largest id is the response, the others are revisits of it.

    * null payload: empty; null url: empty key;
    * null id: never the largest unless all ids of the group are null, then all are responses; read back as null;
    * repeated rows: one record each; those that share the largest id are all responses;
    * empty table: no file and no shard.  Other columns are ignored.
    """
    spark = pages.sparkSession
    short_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        task, out, files, name, at = TaskContext.get(), None, 0, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= MOST_FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0
                    system.create_dir(f"{path}/archive", recursive=True)
                    out, files = system.open_output_stream(f"{path}/archive/{name}", compression=None), files + 1
                    info = _gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\n"
                                 f"WARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                    out.write(info)
                    at += len(info)
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                page = None if row["page_id"] is None else str(row["page_id"])
                data = _gzip(record(page, row["url"] or "", row["html"].encode(), digest, row["refers_to"], date, f"{name}:{at}"))
                out.write(data)
                rows.append({"key": row["key"], "page_id": page, "file": name, "offset": at, "length": len(data),
                             "record_type": "response" if row["refers_to"] is None else "revisit", "payload_digest": digest})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=_CAPTURE)
        if out is not None:
            out.close()

    typed = with_responses(pages, id_col, url_col, payload_col, least_bytes).select("*", surt(F.col("url")).alias("key"))
    typed.mapInArrow(write, CAPTURE).write.parquet(f"{folder}/captures")
    captures = spark.read.schema(CAPTURE).parquet(f"{folder}/captures")
    return Archive(folder, write_index(captures, folder))


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                      ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])


def write_index(captures: DataFrame, folder: str) -> tuple[tuple[str, str, str], ...]:
    """Sort the captures by key and write the shards; returns ``(first key, last key, file)`` of each.

    The driver sees one row per shard, at most ``MOST_SHARDS``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, directory, lines, first, last = None, 0, [], [], None, None

        def close_block():
            nonlocal at
            data = _gzip("".join(line for _, line in lines).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(f"{path}/index", recursive=True)
                    out, first = system.open_output_stream(f"{path}/index/{name}.cdx.gz", compression=None), row["key"]
                last = row.pop("key")
                lines.append((last, json.dumps([last, row]) + "\n"))
                if len(lines) == ROWS_PER_BLOCK:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        out.close()
        with system.open_output_stream(f"{path}/index/{name}.idx") as sparse:
            sparse.write("".join(json.dumps(d) + "\n" for d in directory).encode())
        yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "file": name}])

    shards = min(MOST_SHARDS, max(1, -(-captures.count() // ROWS_PER_SHARD)))
    order = ["key", "page_id", "file", "offset"]
    done = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(
        write, "first string, last string, file string").collect()
    return tuple(sorted((r["first"], r["last"], r["file"]) for r in done))


def _lines(system: fs.FileSystem, path: str, blocks: list, number: int) -> tuple[list[str], list[dict]]:
    """Keys and captures of one block, by a range read."""
    _, offset, length = blocks[number]
    with system.open_input_file(path) as f:
        data = f.read_at(length, offset)
    rows = [json.loads(line) for line in zlib.decompress(data, 31).splitlines()]
    return [k for k, _ in rows], [r for _, r in rows]


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """Captures of the keys (:func:`surt`) in ``keys(key)``, every capture once.

    Null or repeated keys are folded first; keys without a capture give no row.
    """
    short_batches(spark)
    firsts, lasts = [s[0] for s in archive.shards], [s[1] for s in archive.shards]
    folder, files = archive.folder, [s[2] for s in archive.shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                shard = bisect_left(lasts, key)
                while shard < len(firsts) and firsts[shard] <= key:
                    found.append((shard, key))
                    shard += 1
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())],
                                             names=["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        shard, blocks, starts, number, keys_in, rows_in = -1, [], [], -1, [], []
        for batch in batches:
            for want, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if want != shard:
                    shard, number = want, -1
                    with system.open_input_file(f"{path}/index/{files[shard]}.idx") as f:
                        blocks = [json.loads(line) for line in f.read().splitlines()]
                    starts = [b[0] for b in blocks]
                block, found = max(0, bisect_left(starts, key) - 1), []
                while block < len(blocks) and starts[block] <= key:
                    if block != number:
                        number, (keys_in, rows_in) = block, _lines(system, f"{path}/index/{files[shard]}.cdx.gz", blocks, block)
                    at = bisect_left(keys_in, key)
                    while at < len(keys_in) and keys_in[at] == key:
                        found.append(rows_in[at] | {"key": key})
                        at += 1
                    if len(found) >= ROWS_PER_BLOCK:
                        yield pa.RecordBatch.from_pylist(found, schema=_CAPTURE)
                        found = []
                    block += 1
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_CAPTURE)

    wanted = pick(keys, key="key").filter("key is not null").distinct()
    routed = wanted.mapInArrow(route, "shard int, key string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


RECORD = ("page_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, "
          "payload binary, sound boolean")
_RECORD = pa.schema([("page_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("sound", pa.bool_())])


def read_records(spark: SparkSession, archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of the captures, read from the archive files in order of place.

    ``sound`` tells whether a response's payload has the length and digest its headers state.
    """
    short_batches(spark)
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        name, source = None, None
        for batch in batches:
            rows, at = batch.to_pylist(), 0
            while at < len(rows):
                run, end = [rows[at]], rows[at]["offset"] + rows[at]["length"]
                while at + len(run) < len(rows):
                    after = rows[at + len(run)]
                    if after["file"] != run[0]["file"] or after["offset"] != end or end - run[0]["offset"] >= MOST_RANGE_BYTES:
                        break
                    run.append(after)
                    end += after["length"]
                if run[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = run[0]["file"]
                    source = system.open_input_file(f"{path}/archive/{name}")
                begin = run[0]["offset"]
                data = source.read_at(end - begin, begin)
                yield pa.RecordBatch.from_pylist(
                    [parse_record(zlib.decompress(data[r["offset"] - begin:r["offset"] - begin + r["length"]], 31)) for r in run],
                    schema=_RECORD)
                at += len(run)
        if source is not None:
            source.close()

    places = captures.select("file", "offset", "length")
    return places.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS r FROM p GROUP BY h),
b AS (SELECT p.page_id, p.h, g.r, CAST(unhex(sha1(p.h)) AS BIT)::VARCHAR AS bits FROM p JOIN g ON p.h = g.h)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, i + 1, 1) AS INT) + 8 * CAST(substr(bits, i + 2, 1) AS INT) + 4 * CAST(substr(bits, i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, i + 4, 1) AS INT) + CAST(substr(bits, i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r <> page_id THEN r END AS refers_to
FROM b
"""

"""WARC archives: written by Spark's writer, indexed, and read back in coalesced byte ranges of the records asked for."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, spread_join

END = "\r\n\r\n"
#: Digits of base 32 as numbers are written, and as RFC 4648 writes them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, type string, record_id string, url string, digest string, refers_to string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits are 4 digits of base 32."""
    sha1 = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def write_archives(
    rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """One WARC 1.1 record per row, in as many archives as the job has tasks.

    Of the rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id is a response, and the
    others are revisits that name it and hold its HTTP headers alone. All smaller payloads are responses. A record's
    id is an URN of the row's id, the digest, a hash of the url, and the number of the copy.

    The archives are text files whose lines end as WARC records do, so Spark's own committer writes them: a task that
    is lost and run again leaves one copy of its records. Payloads are shuffled only if more of them repeat than a
    broadcast may hold; then hot ones are salted.

    Defined cases: a null payload is empty; a null url writes no target; a null id is the smallest; line breaks in urls
    are percent-encoded; of rows with one id and one payload the largest url is the response, and of rows equal in all
    three one is; an empty table writes no record; other columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    mine = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    mine = mine.withColumn("digest", payload_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    same = mine.where(F.col("bytes") >= min_bytes).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("n"))
    heads = same.groupBy("digest").agg(F.max(F.struct("id", "url", "n")).alias("head"), F.sum("n").alias("all")).where("all > 1").select("digest", "head")
    heads = cut_lineage(heads)
    joined = spread_join(mine, heads, ["digest"], "id", "left")
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & F.col("url").eqNullSafe(F.col("head.url"))
    repeats = not heads.where("head.n > 1").isEmpty()
    alone = joined.withColumn("copy", F.lit(0)).withColumn("revisit", F.col("head").isNotNull() & ~is_head)
    written = alone.where(F.col("head").isNull() | ~is_head | (F.col("head.n") == 1)) if repeats else alone
    if repeats:  # rows equal in id, url and payload: one is the response, the others are numbered copies
        equal = joined.where(is_head & (F.col("head.n") > 1)).groupBy("digest").agg(F.first(F.struct("id", "url", "payload", "bytes", "head")).alias("x"))
        copies = equal.select("x.id", "x.url", "x.payload", "digest", "x.bytes", "x.head", F.explode(F.sequence(F.lit(0), F.col("x.head.n").cast("int") - 1)).alias("copy"))
        written = written.unionByName(copies.withColumn("revisit", F.col("copy") > 0).select(written.columns))
    # Records that none refers to are numbered where they are written, as rows equal in id, url and payload need it.
    number = F.when((F.col("revisit") & ~is_head) | (F.col("bytes") < min_bytes), F.monotonically_increasing_id()).otherwise(F.col("copy"))
    written.withColumn("copy", number).select(record(date).alias("value")).write.option("lineSep", END).text(folder)


def urn(kind: str) -> Column:
    """The record id of a row, or of the response that it revisits."""
    own = kind == "own"
    row, url, copy = (F.col("id"), F.col("url"), F.col("copy")) if own else (F.col("head.id"), F.col("head.url"), F.lit(0))
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(row.cast("string")), F.lit("")), F.lit(":"), F.col("digest"), F.lit(":"), F.hex(F.xxhash64(url)), F.lit(":"), copy.cast("string"), F.lit(">"))


def record(date: str) -> Column:
    """A row's record without the two line breaks that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    target = lambda name, url: F.coalesce(F.concat(F.lit(f"{name}: "), F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n")), F.lit(""))
    of = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("head"), F.lit("\r\n"), target("WARC-Refers-To-Target-URI", F.col("head.url")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn("own"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"), target("WARC-Target-URI", F.col("url")), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("revisit"), of).otherwise(""), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END),
        http, F.when(F.col("revisit"), "").otherwise(F.col("payload").cast("string")),
    )


def opened(path: str):
    """A file for reads at any place, on the stores that Arrow reaches (local and shared folders, HDFS, S3, GCS)."""
    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with white space go on."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def head_end(data: bytes, at: int = 0) -> int:
    """Where the block begins, or -1."""
    found = data.find(b"\r\n\r\n", at)
    return found + 4 if found >= 0 else -1


def entries(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header fields) of every record of an archive; blocks are passed over, not read.

    In an archive of gzip members (one a record) offsets and lengths are those of the members.
    """
    with opened(path) as f:
        size = f.size()
        if size and f.read_at(min(2, size), 0) == b"\x1f\x8b":
            yield from members(f, size, chunk)
            return
        at, begin, data = 0, 0, b""
        while at < size:
            end = head_end(data, at - begin) if begin <= at < begin + len(data) else -1
            want = chunk
            while end < 0:
                begin, data = at, f.read_at(min(want, size - at), at)
                end = head_end(data)
                if end < 0 and len(data) < want:
                    if not data.strip():
                        return
                    raise ValueError(f"no record at {at} of {path}")
                want *= 2
            head = fields(data[at - begin : end])
            length = begin + end - at + int(head["content-length"]) + 4
            if at + length > size:
                raise ValueError(f"the record at {at} of {path} is cut off")
            yield at, length, head
            at += length


def members(f, size: int, chunk: int, most: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str]]]:
    """The same for an archive whose records are gzip members; up to ``most`` bytes of each are held for its header."""
    at, data, begin = 0, b"", 0
    while at < size:
        unpack, head, used = zlib.decompressobj(31), b"", at
        while not unpack.eof:
            if not begin <= used < begin + len(data):
                begin, data = used, f.read_at(min(chunk, size - used), used)
                if not data:
                    raise ValueError(f"the member at {at} is cut off")
            given = data[used - begin :]
            made = unpack.decompress(given)
            head += made[: max(0, most - len(head))]
            used += len(given) - len(unpack.unused_data)
        yield at, used - at, fields(head[: head_end(head)])
        at = used


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, length, type, record_id, url, digest, refers_to) of every record of the archives in a folder.

    Spark lists the files and deals them by size; a task reads one header after another. Null where a field is missing;
    digests stand without their algorithm."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for offset, length, h in entries(path):
                    digest = h.get("warc-payload-digest")
                    out.append((path, offset, length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), digest and digest.rpartition(":")[2], h.get("warc-refers-to")))
                    if len(out) >= 4096:
                        yield table_of(out)
                        out = []
        yield table_of(out)

    def table_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.types[k]) for k in range(len(names))], schema=schema)

    return spark.read.format("binaryFile").load(folder).where("length > 0").select("path").mapInArrow(run, INDEX)


READ = "record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, verified boolean"


def read_records(index: DataFrame, payloads: bool = True, gap: int = 1 << 16, most: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that the rows of an index select: record_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest, verified.

    Rows are dealt by ranges of (file, offset), so that a task has neighbours, and read in that order: records less than
    ``gap`` bytes apart are one read of up to ``most`` bytes; a longer record is one read. HTTP headers are taken off.
    payload_bytes and payload_digest are those of the payload read; verified tells whether the digest is the declared
    one (null: none was declared). A revisit has no payload: its size and digest are declared, verified is null.
    ``index`` should be written (it is sampled for the ranges). No selected row: no record.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select(*[x.split()[0] for x in INDEX.split(", ")]).repartitionByRange(1 + total // task_bytes, "file", "offset").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.bool_() if n == "verified" else pa.string() for n in names]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for one in records(ranges((r for b in batches for r in b.to_pylist()), gap, most)):
            out.append(one if payloads else {**one, "payload": None})
            size += len(one["payload"] or b"") if payloads else 0
            if len(out) >= 2048 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, READ)


def ranges(rows: Iterator[dict], gap: int, most: int) -> Iterator[list[dict]]:
    """Sorted index rows in runs that one read covers."""
    run: list[dict] = []
    for r in rows:
        if run:
            end = max(x["offset"] + x["length"] for x in run[-1:])
            if r["file"] != run[0]["file"] or r["offset"] - end > gap or r["offset"] + r["length"] - run[0]["offset"] > most:
                yield run
                run = []
        run.append(r)
    if run:
        yield run


def records(runs: Iterator[list[dict]]) -> Iterator[dict]:
    """The records of each run, cut out of one read."""
    path, f = None, None
    for run in runs:
        if run[0]["file"] != path:
            if f is not None:
                f.close()
            path = run[0]["file"]
            f = opened(path)
        begin = run[0]["offset"]
        data = f.read_at(run[-1]["offset"] + run[-1]["length"] - begin, begin)
        for r in run:
            yield parsed(data[r["offset"] - begin : r["offset"] - begin + r["length"]], r)
    if f is not None:
        f.close()


def parsed(data: bytes, row: dict) -> dict:
    """A record's fields and payload."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    end = head_end(data)
    head = fields(data[:end])
    payload = data[end : end + int(head["content-length"])]
    http: dict[str, str] = {}
    if head.get("content-type", "").startswith("application/http") and (cut := head_end(payload)) >= 0:
        http, payload = fields(payload[:cut]), payload[cut:]
    declared = row["digest"]
    if head.get("warc-type") == "revisit":
        size = http.get("content-length")
        found, length, digest, verified = None, int(size) if size else None, declared, None
    else:
        found, length, digest = payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        verified = None if declared is None else digest == declared
    return {"record_id": row["record_id"], "url": row["url"], "record_type": row["type"], "refers_to": row["refers_to"], "payload": found, "payload_bytes": length, "payload_digest": digest, "verified": verified}


def row_id(record_id: Column, kind: str) -> Column:
    """The row's id out of a record id that ``write_archives`` made; null where there is none."""
    text = F.regexp_extract(record_id, "^<urn:record:([^:]*):", 1)
    return F.when(text != "", F.url_decode(text)).cast(kind)


"""WARC files of individually compressed records with a shared Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame a record.
The dictionary is trained on at most `SAMPLE` records, chosen by a hash of their id, of at most `PIECE` bytes each.
Files are written in the shared folder under a name of their task attempt, and a table lists those of the tasks that
ended well: files that a lost or repeated task leaves behind aren't in it and are never read.

Of records with equal payloads of at least `least` bytes the one with the smallest id is a response and the others
are revisits that refer to it. The join that finds them meets a table with one row a repeated digest, written before, so
that Spark can split a digest with very many pages.

Cases: null html is an empty payload; null url an empty target; a null id is written empty and read as null, and never
is the one referred to unless all are null; repeated rows (same id, same payload) count as one first record: the first
of them in the file is no revisit of itself, each is a response. An empty table gives an empty result. Line ends in a
URL are percent-encoded, and in a text id percent signs too, so that it is read back as it was. Ids may be of any type that text casts
to, such as whole numbers, text, dates or decimals; an empty text id is not a null one.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved

MAGIC = (0x184D2A5D).to_bytes(4, "little")
SAMPLE, PIECE, DICTIONARY = 1000, 32 << 10, 64 << 10
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 256 << 20


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for local and remote shared folders."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def dictionary(pages: DataFrame, payload: str = "payload", key: str = "page_id") -> bytes:
    """A trained dictionary, or with very few records the records themselves (a raw one)."""
    n = pages.count()
    some = pages.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(n, 1))))  # so that no task sends many
    rows = some.filter(F.length(payload) > 0).select(F.substring(payload, 1, PIECE).alias("p"), F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).collect()
    samples = [bytes(r["p"]) for r in rows]
    try:
        return zstd.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def shown(key) -> str:
    """An id as a header's value; unquote() reads it."""
    return str(key).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(key, url: str | None, body: bytes, size: int, digest: str, refers) -> bytes:
    """One record, uncompressed. A revisit has an empty block and names what it refers to."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if key is not None:
        head.append(f"X-Page-ID: {shown(key)}")
    if refers is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    else:
        http = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page: {shown(refers)}", "Content-Length: 0"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a file."""
    if stream.read(4) != MAGIC:
        raise ValueError("no dictionary frame")
    size = int.from_bytes(stream.read(4), "little")
    data = stream.read(size)
    plain = io.BufferedReader(zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data)).stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("no record where one is due")
        head = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.rstrip(":")] = value
        want = int(head["Content-Length"])
        block = plain.read(want)
        if len(block) != want or plain.read(4) != b"\r\n\r\n":
            raise ValueError("cut short")
        yield head, block


def revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, first): first is null unless the payload is a repeated one."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    twice = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    return rows.join(saved(twice, "repeated"), "digest", "left")


def write(spark: SparkSession, rows: DataFrame, path: str, trained: bytes, level: int = 3) -> DataFrame:
    """Writes rows (from revisits()) as files under path; (file, n_records, n_bytes) of the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        fs.create_dir(at, recursive=True)
        ctx = TaskContext.get()
        packer = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(trained))
        out, done, n, size = None, [], 0, 0
        for b in batches:
            for key, url, body, n_bytes, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "n_bytes", "digest", "first")), strict=True):
                refers = first if first is not None and first != key else None
                if out is None:
                    name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{len(done)}.warc.zst"
                    out, n = fs.open_output_stream(f"{at}/{name}"), 0
                    size = out.write(MAGIC + len(trained).to_bytes(4, "little") + trained)
                frame = packer.compress(record(key, url, body if refers is None else b"", n_bytes, digest, refers))
                size += out.write(frame) or len(frame)
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{path}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "n_records", "n_bytes"])

    return saved(rows.select("page_id", "url", "payload", "n_bytes", "digest", "first").mapInArrow(run, "file string, n_records long, n_bytes long"), "warc_files")


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), from the bytes of archive()'s files."""
    key_type = files.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, want in zip(b.column("file").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                fs, at = filesystem(name)
                rows: list[tuple] = []
                seen = 0
                with fs.open_input_stream(at) as f:
                    for head, block in read_records(f):
                        if head["WARC-Type"] == "response":
                            body = block[block.index(b"\r\n\r\n") + 4 :]
                            size, digest, refers = len(body), hashlib.sha256(body).hexdigest(), None
                            if head["WARC-Payload-Digest"] != "sha256:" + digest:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        else:
                            size, digest, refers = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), unquote(head["X-Refers-To-Page"])
                        seen += 1
                        key = head.get("X-Page-ID")
                        rows.append((None if key is None else unquote(key), size, digest, head["WARC-Type"], refers))
                        if len(rows) == 10_000:
                            yield packed(rows)
                            rows = []
                if seen != want:
                    raise ValueError(f"{name}: {seen} records where {want} were written")
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = files.select("file", "n_records").repartition(max(1, files.count()))
    out = spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def archive(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives of pages and lists their files: (file, n_records, n_bytes, page_id); page_id is null, its type is the ids'."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    files = write(spark, revisits(pages, key, url, html), path or new_path(spark, "warc"), dictionary(rows))
    return files.withColumn("page_id", F.lit(None).cast(pages.schema[key].dataType))

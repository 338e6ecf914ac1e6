"""WARC archives: written with one gzip member per record, indexed first, read by coalesced byte ranges.

Writing is one task per partition.  A task's files carry a name of their own attempt, and the manifest
(a Parquet table that Spark commits) lists the files of the attempts that counted, so that a retried or
lost task leaves at most files that nobody reads.  Indexing walks the listed archives and notes offset,
length, URL and digest of each record.  Reading sorts the selected index rows by file and offset,
joins ranges that are close to one read, and cuts the records out of it.

Archives are reached through pyarrow's file systems (file, hdfs, s3, gs), since byte ranges are asked for.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, shuffle_partitions, small_batches, table, written

#: The profile of a revisit and the line ends of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Payloads shorter than this are never replaced by a revisit.
SMALLEST_SHARED = 100
#: Bytes after which a task opens its next file; of a joined read, and between ranges that it may join.
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
#: Rows up to which the table of shared payloads is broadcast (about 100 bytes a row); beyond, a salted join.
BROADCAST_ROWS, SALTS = 100_000, 16


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


# writing


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of record ``refers_to`` with none, as one gzip member."""
    name = str(page_id) if page_id is not None else "none"
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:x-page:{name}>".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._{}|^`\"\\<>").encode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}".encode())
    head.append(f"X-Payload-Length: {len(payload)}".encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>".encode(), b"WARC-Profile: " + REVISIT.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + END + block + END) + packer.flush()


def with_originals(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with digest and refers_to: the smallest key among equal payloads, null for that row itself,
    for payloads under SMALLEST_SHARED bytes, and where no row of the group has a key."""
    text = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.withColumn("digest", F.sha2(text.cast("binary"), 256))
    long = F.octet_length(text) >= SMALLEST_SHARED
    shared = written(
        pages.where(long).groupBy("digest").agg(F.min(key).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original"), "warc-shared"
    )
    if shared.count() <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(shared), "digest", "left")
    else:  # a payload that fills a third of all rows is dealt to SALTS tasks
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    return joined.withColumn("refers_to", F.when(~F.col("original").eqNullSafe(F.col(key)), F.col("original"))).drop("original")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record per row in gzipped archives under ``path``; the manifest: file, records, bytes.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal payloads of at least
    SMALLEST_SHARED bytes, that with the smallest key is the response and the others revisit it; rows that
    repeat that key are responses too, and null keys revisit if any row of the group has a key.  Null
    URLs leave out the header.  An empty table gives no file.  Other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = with_originals(pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")), "key", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for b in batches:
            for k, u, d, p, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                made = record(k, u, d, (p or "").encode(), r, date)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{path}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])

    return written(rows.select("key", "url", "digest", "payload", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


# the index


def headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    return {n.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for n, _, v in (x.partition(b":") for x in lines[1:])}


def members(stream, head_bytes: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and the first bytes of each gzip member of a stream (the whole header at least), read in pieces."""
    offset, held = 0, b""
    while True:
        unpack, head, used = zlib.decompressobj(31), b"", 0
        while not unpack.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    if used:
                        raise ValueError(f"the gzip member at {offset} is cut off")
                    return
            data = held
            used += len(data)
            while data and not unpack.eof:
                plain = unpack.decompress(data, 1 << 20)
                data = unpack.unconsumed_tail
                if len(head) < head_bytes or END not in head:
                    head += plain
            held = unpack.unused_data
        used -= len(held)
        yield offset, used, head
        offset += used


def plain_records(stream, size: int) -> Iterator[tuple[int, int, bytes]]:
    """The same of an archive that isn't compressed: headers are read, blocks are skipped."""
    offset = 0
    while offset < size:
        stream.seek(offset)
        head = b""
        while END not in head:
            more = stream.read(4096)
            if not more:
                raise ValueError(f"the record at {offset} is cut off")
            head += more
        top = head.index(END) + len(END)
        length = top + int(headers(head[:top])["content-length"]) + len(END)
        yield offset, length, head
        offset += length


INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string, refers_to string, payload_bytes long"


def index_warc(files: DataFrame, column: str = "file") -> DataFrame:
    """A row per record of the archives named in a column: where it lies, its URL, digest, type and ids.

    Takes gzipped archives of a member per record (names ending in .gz) and plain ones.  Null names give
    nothing; a damaged archive is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = INDEX.replace(" string", "").replace(" long", "").split(", ")
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = file_system(name)
                rows: list[tuple] = []
                with system.open_input_file(at) as f:
                    found = members(f) if name.endswith(".gz") else plain_records(f, f.size())
                    for offset, length, head in found:
                        h = headers(head[: head.index(END)])
                        size = h.get("x-payload-length")
                        rows.append(
                            (name, offset, length, h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), int(size) if size else None)
                        )
                        if len(rows) >= 5000:
                            yield batch(rows, names)
                            rows = []
                if rows:
                    yield batch(rows, names)

    def batch(rows, names):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.select(column).where(F.col(column).isNotNull()).mapInArrow(run, INDEX)


# reading


def joined_ranges(rows: list[tuple[int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """For sorted (offset, length): reads as (first row, row after the last, begin, end)."""
    i = 0
    while i < len(rows):
        begin, end, j = rows[i][0], rows[i][0] + rows[i][1], i + 1
        while j < len(rows) and rows[j][0] - end <= gap and rows[j][0] + rows[j][1] - begin <= most:
            end = max(end, rows[j][0] + rows[j][1])
            j += 1
        yield i, j, begin, end
        i = j


def payload_of(raw: bytes) -> bytes:
    """The payload of a record: its block without the HTTP head."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    top = raw.index(END) + len(END)
    h = headers(raw[:top])
    block = raw[top : top + int(h["content-length"])]
    if h.get("content-type", "").startswith("application/http"):
        block = block[block.index(END) + len(END) :]
    return block


def read_records(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """The selected index rows with ``payload`` (binary): empty for a revisit; ``resolved`` follows those to their originals.

    Rows are dealt by file and stretch of it, sorted, and read in joined ranges.
    """
    schema = index.select("*", F.lit(None).cast("binary").alias("payload")).schema
    names = schema.names
    f, o, n = (names.index(x) for x in ("file", "offset", "length"))
    stretch = F.floor(F.col("offset") / F.lit(8 * READ_BYTES))
    dealt = index.repartition(partitions or shuffle_partitions(index.sparkSession), F.col("file"), stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in (f, o, n))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                system, at = file_system(files[lo])
                with system.open_input_file(at) as stream:
                    for i, j, begin, end in joined_ranges(list(zip(offsets[lo:hi], lengths[lo:hi]))):
                        raw = stream.read_at(end - begin, begin)
                        payloads = [payload_of(raw[offsets[lo + k] - begin : offsets[lo + k] - begin + lengths[lo + k]]) for k in range(i, j)]
                        yield pa.RecordBatch.from_arrays([*b.slice(lo + i, j - i).columns, pa.array(payloads, pa.binary())], names=names)
                lo = hi

    return dealt.mapInArrow(run, schema)


def resolved(read: DataFrame) -> DataFrame:
    """The records read, without payload, with found and size: digest and length of the payload that was
    read, for a revisit that of the response it refers to (null where none of its digest is there)."""
    seen = read.withColumn("found", F.concat(F.lit("sha256:"), F.sha2("payload", 256))).withColumn("size", F.octet_length("payload").cast("long"))
    seen = written(seen.drop("payload"), "warc-read")
    revisit = F.col("record_type") == "revisit"
    wanted = seen.where(revisit).select(F.col("refers_to").alias("record_id"), F.col("digest").alias("found")).distinct()
    originals = seen.where(~revisit).select("record_id", "found", "size").join(wanted, ["record_id", "found"], "left_semi").distinct()
    originals = written(originals.select(F.col("record_id").alias("refers_to"), F.col("found").alias("digest"), F.col("found").alias("original"), F.col("size").alias("original_size")), "warc-originals")
    if originals.count() <= BROADCAST_ROWS:
        joined = seen.join(F.broadcast(originals), ["refers_to", "digest"], "left")
    else:  # an original that a third of all rows revisits is dealt to SALTS tasks
        salted = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = seen.withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)).cast("int")).join(salted, ["refers_to", "digest", "salt"], "left")
    return joined.withColumn("found", F.when(revisit, F.col("original")).otherwise(F.col("found"))).withColumn("size", F.when(revisit, F.col("original_size")).otherwise(F.col("size")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page written to archives and read back."""
    path = fresh_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), path)
    files = manifest.select("file").repartition(max(1, manifest.count()))
    index = written(index_warc(files), "warc-index")
    read = resolved(read_records(index))
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    matches = (F.col("found") == F.col("digest")) & F.col("size").eqNullSafe(F.col("payload_bytes"))
    return read.select(
        number("record_id").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.regexp_replace("found", "^sha256:", "").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "url",
        F.coalesce(matches, F.lit(False)).alias("digest_matches"),
    )


def digest_of(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()

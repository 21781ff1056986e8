"""WARC archives and a two-level capture index.

Writing: every page becomes one WARC/1.1 record, a gzip member of its own. Of equal payloads of at least ``SHARED`` bytes the capture of the
smallest id is a response, the others are revisit records that name it. Tasks write archives of up to ``ARCHIVE`` bytes into the shared folder; the table of what they wrote (the
manifest) counts, so what a lost or repeated task leaves behind is never read.

Index: captures are sorted by key (the host reversed, then the rest of the url) over ranges and written as segment files of compressed
blocks of ``LINES`` captures, each segment with a sparse directory of its blocks at its end. The upper level, one row for each segment with its first key, is a table
as long as the number of ranges (``SEGMENTS`` at most). Looking up: wanted captures are sorted over ranges of the same key, so a task reads
neighbouring blocks; it finds the segment, then the block, then the capture, each by binary search. What is found is
sorted by place, and records are read by ranges, neighbours in one read of at most ``READ`` bytes.

Files are opened by their urls through Arrow's file systems (local, HDFS, S3, GCS), in the folder that driver and executors share.

Defined results: a null html is empty; a null url is the empty key and has no target header; a null page_id counts as larger than any other; rows that repeat a page_id are
captures of their own, all of them responses where that id is the smallest of its payload (payloads of fewer than ``SHARED`` bytes always are);
an empty table gives an empty archive and index; other columns are not read. A task holds one record, one block and one range at a time.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import removed, scratch_path, written

#: Bytes from which equal payloads are shared; of an archive; lines of a block; segments of an index; bytes of one read.
SHARED, ARCHIVE, LINES, SEGMENTS, READ = 100, 1 << 30, 1024, 10_000, 4 << 20
LEVEL = 6
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = "page_id long, key string, file string, offset long, length long"
CAPTURE = [c.split()[0] for c in MANIFEST.split(", ")]


def quoted(url: str) -> str:
    """Bytes outside printable ASCII as %XX; quoting twice changes nothing."""
    return quote_from_bytes(url.encode(), safe=PRINTABLE)


def capture_key(url: str | None) -> str:
    """``com,example,www)/path?query`` in printable ASCII: hosts of one domain stand together, then its paths in order."""
    if not url:
        return ""
    scheme, found, rest = quoted(url).partition("://")
    rest = rest if found else scheme
    at = re.search(r"[/?#]|$", rest).start()
    host, _, port = rest[:at].lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (rest[at:].split("#")[0] or "/")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def payload_digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target: str | None) -> bytes:
    """A response with its payload, or, with ``refers_to``, a revisit without."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", EPOCH)]
    head += [("WARC-Target-URI", quoted(url))] if url else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
        head += [("WARC-Refers-To-Target-URI", quoted(target))] if target else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a gzip member with one record; an error where it is not whole."""
    unpack = zlib.decompressobj(31)
    data = unpack.decompress(member)
    if not unpack.eof:
        raise ValueError("a record is cut off")
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def packed(data: bytes) -> bytes:
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _own_name(kind: str, k: int) -> str:
    """A name that no other attempt of any task has."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():05d}-{k:03d}-{uuid.uuid4().hex}"


def _writer(folder: str, archive: int):
    """Rows (page_id, url, html, digest, refers_to, target) to archives; gives the manifest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, k = None, "", 0, 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                ids, urls, texts, digests, refs, targets = batch.columns
                for i in range(len(batch)):
                    page, url, ref, text = ids[i].as_py(), urls[i].as_py(), refs[i].as_py(), texts[i].as_py()
                    member = packed(warc_record(page, url, (text or "").encode(), digests[i].as_py(), ref, targets[i].as_py()))
                    if out is not None and at + len(member) > archive:
                        out.close()
                        out = None
                    if out is None:
                        name, at, k = _own_name("archive", k) + ".warc.gz", 0, k + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((page, capture_key(url), name, at, len(member)))
                    at += len(member)
                yield _manifest_batch(rows)
        finally:
            if out is not None:
                out.close()

    return of


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=CAPTURE)


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, target) of every page; refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    known = written(known, "payloads")
    first = F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0).cast("long")), F.coalesce("url", F.lit(""))))
    shared = known.filter(F.col("n") >= SHARED).groupBy("digest").agg(first.alias("response"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marked = known.filter(F.col("n") >= SHARED).join(shared, "digest").filter("response.page_id IS NOT NULL AND NOT response.page_id <=> page_id")
    marked = marked.select("page_id", "digest", "response").distinct()
    # html goes along once; a page's revisit is found by its id and digest
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    m = marked.select(F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), "response")
    met = rows.join(m, F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left")
    return met.select("page_id", "url", F.when(F.col("response").isNull(), F.col("html")).alias("html"), "digest", F.col("response.page_id").alias("refers_to"), F.col("response.url").alias("target"))


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes all pages as WARC records into ``folder``; returns the manifest."""
    return written(captures_of(pages).mapInArrow(_writer(folder, archive), MANIFEST), "manifest")


def _order(key: str, page_id: int | None) -> tuple[str, bool, int]:
    return key, page_id is not None, page_id or 0


def _segment(folder: str, lines: int):
    """Captures in order to one segment file a task; gives its first capture and name."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out, name, first, at, directory, waiting = None, "", None, 0, [], []

        def block(rows: list[list]) -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), LEVEL)
            out.write(data)
            directory.append([rows[0][0], rows[0][1], at, len(data)])
            at += len(data)

        for batch in batches:
            rows = [[r["key"], r["page_id"], r["file"], r["offset"], r["length"]] for r in batch.to_pylist()]
            if rows and out is None:
                name, first = _own_name("segment", 0) + ".idx", rows[0]
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            waiting += rows
            while len(waiting) >= lines:
                block(waiting[:lines])
                waiting = waiting[lines:]
        if out is not None:
            if waiting:
                block(waiting)
            end = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(end)
            out.write(len(end).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], names=["key", "page_id", "segment"])

    return of


class CaptureIndex:
    """Two levels over the captures of a manifest: ``segments`` names each segment file by its first capture; the rest is in the files."""

    def __init__(self, manifest: DataFrame, folder: str, lines: int = LINES, segments: int | None = None):
        spark = manifest.sparkSession
        self.folder = folder
        count = segments or min(SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.count = count
        order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
        dealt = manifest.select(*CAPTURE).repartitionByRange(count, *order).sortWithinPartitions(*order)
        self.segments = written(dealt.mapInArrow(_segment(folder, lines), "key string, page_id long, segment string"), "segments")

    def locate(self, wanted: DataFrame) -> DataFrame:
        """Manifest rows of all captures with the (key, page_id) of a row of ``wanted``; an error for one that is not there."""
        upper = sorted(((*_order(r["key"], r["page_id"]), r["segment"]) for r in self.segments.collect()), key=lambda r: r)  # at most SEGMENTS rows
        order = ["key", F.col("page_id").asc_nulls_first()]
        asked = wanted.select("key", "page_id").distinct().repartitionByRange(self.count, *order).sortWithinPartitions(*order)
        return asked.mapInArrow(_finder(self.folder, [r[:3] for r in upper], [r[3] for r in upper]), MANIFEST)


class Segment:
    """One segment file: its directory, and the block read last."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.starts = [_order(k, p) for k, p, _, _ in self.directory]
        self.held, self.rows, self.orders = -1, [], []

    def block(self, k: int) -> None:
        if k != self.held:
            _, _, at, n = self.directory[k]
            self.rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
            self.orders = [_order(r[0], r[1]) for r in self.rows]
            self.held = k

    def find(self, want: tuple) -> Iterator[list]:
        """All captures that equal ``want``: from the block before the first that begins at or after it."""
        k = max(bisect.bisect_left(self.starts, want) - 1, 0)
        while k < len(self.starts) and (self.starts[k] <= want):
            self.block(k)
            for row in self.rows[bisect.bisect_left(self.orders, want) : bisect.bisect_right(self.orders, want)]:
                yield row
            k += 1


def _finder(folder: str, firsts: list[tuple], names: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        held: dict[int, Segment] = {}
        for batch in batches:
            rows: list[tuple] = []
            for key, page in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                want, before = _order(key, page), len(rows)
                k = max(bisect.bisect_left(firsts, want) - 1, 0)
                while k < len(firsts) and firsts[k] <= want:
                    if k not in held:
                        held = {j: s for j, s in held.items() if j == k - 1} | {k: Segment(fs, f"{root}/{names[k]}")}  # wanted captures come in order
                    rows += [(r[1], r[0], r[2], r[3], r[4]) for r in held[k].find(want)]
                    k += 1
                if len(rows) == before:
                    raise LookupError(f"no capture of {key!r} {page}")
            yield _manifest_batch(rows)

    return of


def _reader(folder: str):
    """Located records, sorted by file and offset, read by ranges: page_id, record_type, payload_bytes, payload_digest, refers_to, target_key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        name, file = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            ids, out, i = batch.column("page_id").to_pylist(), [], 0
            while i < len(files):
                j, start = i + 1, offsets[i]
                while j < len(files) and files[j] == files[i] and offsets[j] + lengths[j] - start <= READ and offsets[j] - offsets[j - 1] - lengths[j - 1] < READ // 8:
                    j += 1
                if files[i] != name:
                    if file is not None:
                        file.close()
                    name, file = files[i], fs.open_input_file(f"{root}/{files[i]}")
                data = file.read_at(offsets[j - 1] + lengths[j - 1] - start, start)
                for k in range(i, j):
                    out.append(_read_record(ids[k], data[offsets[k] - start : offsets[k] - start + lengths[k]]))
                i = j
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "target_key"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
        if file is not None:
            file.close()

    return of


def _read_record(page_id: int | None, member: bytes) -> tuple:
    headers, payload = parsed_record(member)
    if headers["warc-record-id"] != record_id(page_id):
        raise ValueError(f"the index leads to {headers['warc-record-id']} for page {page_id}")
    told = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "revisit":
        target = int(headers["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
        return page_id, "revisit", None, told, target, capture_key(headers.get("warc-refers-to-target-uri"))
    if payload_digest(payload) != told:
        raise ValueError(f"the payload of page {page_id} is not the one that was written")
    return page_id, "response", len(payload), told, None, None


def read_records(located: DataFrame, folder: str, count: int) -> DataFrame:
    order = ["file", "offset"]
    dealt = located.select("page_id", "file", "offset", "length").repartitionByRange(count, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_reader(folder), "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_key string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([capture_key(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), keys], names=["page_id", "key"])


def keys_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(_keys, "page_id long, key string")


def replayed(pages: DataFrame, index: CaptureIndex, archives: str) -> DataFrame:
    """What the archives hold for each of ``pages``: the record found by its key; a revisit takes its payload's size from the response it names, found by the index as well."""
    own = written(read_records(index.locate(keys_of(pages)), archives, index.count), "records")
    asked = own.filter("record_type = 'revisit'").select(F.col("target_key").alias("key"), F.col("refers_to").alias("page_id"))
    named = read_records(index.locate(asked), archives, index.count).filter("record_type = 'response'")
    named = written(named.select(F.col("page_id").alias("t_id"), F.col("payload_digest").alias("t_digest"), F.col("payload_bytes").alias("t_bytes")).distinct(), "named")
    met = own.join(named, (F.col("refers_to") == F.col("t_id")) & (F.col("payload_digest") == F.col("t_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response behind page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    size = F.coalesce("payload_bytes", "t_bytes")
    return met.select("page_id", F.when(size.isNull(), lost).otherwise(size).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives, folder = scratch_path(spark, "archives"), scratch_path(spark, "capture-index")
    manifest = write_archives(pages, archives)
    index = CaptureIndex(manifest, folder)
    removed(manifest)
    return replayed(pages, index, archives)


OP11_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM m
"""

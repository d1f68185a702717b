"""WARC archives with a two-level index of captures.

Records are compressed one by one, so that a range of bytes is a record. The index is sorted by reversed
host and path; its lines stand in compressed blocks, and each index file ends with a sparse directory of
the first key of each block. A lookup searches the first keys of the files, the directory of one file and
one block, each by bisection, and then reads a range of an archive.

Archives and index go to the shared folder through the file system its URI names. A task that runs again
writes a file of another name; only files named in the rows that Spark kept are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import slices
from verdictframe.session import materialize, scratch_path

#: Payloads of at least so many bytes are written once; equal ones become revisits.
LEAST_REVISIT = 0
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 3000
#: Ranges of one archive that lie this close are read at once, up to the second number of bytes.
GAP, AT_ONCE = 1 << 16, 8 << 20

_url = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?(.*)$", re.DOTALL)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, comma-joined, then ``)`` and path and query without the fragment."""
    if not url:
        return ""
    m = _url.match(url)
    if not m:
        return url
    host = ",".join(reversed(m[1].lower().split(".")))
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{host}{port}){m[3].split('#')[0] or '/'}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(str(page_id).encode()).digest())}>"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit names the response and has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        *(
            [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            if revisit
            else ["Content-Type: application/http; msgtype=response"]
        ),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else b""


def _output(folder: str, name: str):
    """An open stream and the full URI of a new file in ``folder``."""
    system, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def _input(uri: str):
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return system.open_input_file(path)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``refers_to``: of equal payloads the largest ``page_id`` is the response.

    Only digests met more than once take part in the join; the largest id of each is found before the shuffle.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = source.withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.encode("html", "utf-8")))))
    groups = keyed.select("digest", "page_id").where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    shared = materialize(groups.where("n > 1").select("digest", "top"), "payloads")
    return keyed.join(shared, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write the archives; ``page_id``, ``url``, ``url_key``, ``refers_to``, ``digest``, ``file``, ``start``, ``size`` of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, uri, at = None, None, 0
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for page_id, url, page, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= ARCHIVE_BYTES:
                    if stream:
                        stream.close()
                    (stream, uri), at = _output(folder, f"{uuid.uuid4().hex}.warc.gz"), 0
                payload = page.encode()
                data = gzip.compress(record(page_id, url, payload, refers_to), compresslevel=4, mtime=0)
                stream.write(data)
                rows.append((page_id, url, url_key(url), refers_to, base32(hashlib.sha1(payload).digest()), uri, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if stream:
            stream.close()

    names = ["page_id", "url", "url_key", "refers_to", "digest", "file", "start", "size"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    source = revisits(pages, least).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("refers_to").cast("long").alias("refers_to"))
    return source.mapInArrow(run, "page_id long, url string, url_key string, refers_to long, digest string, file string, start long, size long")


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """Write the index; first key, file, and place of its directory, for each file in order of keys.

    This list has one entry for each shuffle partition, whatever the number of captures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, uri, at, directory, lines = None, None, 0, [], []

        def flush() -> None:
            nonlocal stream, uri, at, lines
            if not lines:
                return
            if stream is None:
                stream, uri = _output(folder, f"{uuid.uuid4().hex}.cdx.gz")
            data = gzip.compress("\n".join(map(json.dumps, lines)).encode(), compresslevel=4, mtime=0)
            directory.append((lines[0][:2], at, len(data)))
            stream.write(data)
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        flush()
        if stream:
            data = gzip.compress(json.dumps(directory).encode(), mtime=0)
            stream.write(data)
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(directory[0][0])]), pa.array([uri]), pa.array([at]), pa.array([len(data)])], names=["first", "file", "start", "size"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.coalesce("page_id", F.lit(-(1 << 63)))
    lines = captures.select("url_key", id_.alias("id"), "refers_to", "digest", "file", "start", "size")
    ordered = lines.repartitionByRange(parts, "url_key", "id").sortWithinPartitions("url_key", "id")
    files = materialize(ordered.mapInArrow(run, "first string, file string, start long, size long"), "index")
    return sorted(((json.loads(r["first"]), r["file"], r["start"], r["size"]) for r in files.collect()), key=lambda x: _order(x[0]))


def _order(key: list) -> tuple[bytes, int]:
    """Keys in the order in which Spark sorts them."""
    return key[0].encode(), key[1]


class Index:
    """Lookups in key order; the last directory and block stay open."""

    def __init__(self, root: list[tuple[list, str, int, int]]) -> None:
        self.root, self.first = root, [_order(x[0]) for x in root]
        self.file = self.block = None
        self.directory, self.lines, self.keys = [], [], []

    def find(self, key: tuple[str, int]) -> list[list]:
        """All lines of ``key``."""
        wanted = key[0].encode(), key[1]
        found = []
        # equal keys may have been divided between files and blocks: from the last that begins before the key
        i = max(0, bisect.bisect_left(self.first, wanted) - 1)
        while i < len(self.root) and self.first[i] <= wanted:
            self._open(i)
            starts = [_order(d[0]) for d in self.directory] if self.starts is None else self.starts
            self.starts = starts
            j = max(0, bisect.bisect_left(starts, wanted) - 1)
            while j < len(starts) and starts[j] <= wanted:
                self._read(i, j)
                a = bisect.bisect_left(self.keys, wanted)
                while a < len(self.keys) and self.keys[a] == wanted:
                    found.append(self.lines[a])
                    a += 1
                j += 1
            i += 1
        return found

    def _open(self, i: int) -> None:
        if self.file != i:
            _, uri, start, size = self.root[i]
            self.source = _input(uri)
            self.directory = json.loads(gzip.decompress(self.source.read_at(size, start)))
            self.file, self.block, self.starts = i, None, None

    def _read(self, i: int, j: int) -> None:
        if self.block != (i, j):
            _, start, size = self.directory[j]
            self.lines = [json.loads(x) for x in gzip.decompress(self.source.read_at(size, start)).decode().split("\n")]
            self.keys = [_order(x) for x in self.lines]
            self.block = i, j


def look_up(spark, keys: DataFrame, root: list) -> DataFrame:
    """Index lines of all ``url_key``, ``page_id``; keys are sorted first, so each task goes through the index once."""
    shared = spark.sparkContext.broadcast(root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(shared.value), None
        for batch in batches:
            rows = []
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:  # repeated keys come once
                    rows += index.find(key)
                    last = key
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["url_key", "id", "refers_to", "digest", "file", "start", "size"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    ordered = keys.select("url_key", F.coalesce("page_id", F.lit(-(1 << 63))).alias("id")).repartitionByRange(parts, "url_key", "id").sortWithinPartitions("url_key", "id")
    return ordered.mapInArrow(run, "url_key string, id long, refers_to long, digest string, file string, start long, size long")


def fetch(captures: DataFrame) -> DataFrame:
    """Read the records of index lines: ``page_id``, ``record_type``, ``refers_to``, ``payload``, ``digest`` of what was read.

    Ranges are sorted by file and place; close ones are read together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, uri, held, base = None, None, b"", 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows, size_now = [], 0
            for n, (id_, refers_to, digest, file, start, size) in enumerate(zip(*columns, strict=True)):
                if file != uri:
                    source, uri, held, base = _input(file), file, b"", 0
                if not (base <= start and start + size <= base + len(held)):
                    end = start + size
                    for f, s, z in zip(columns[3][n + 1 :], columns[4][n + 1 :], columns[5][n + 1 :], strict=True):
                        if f != file or s > end + GAP or s + z > start + AT_ONCE:
                            break
                        end = max(end, s + z)
                    held, base = source.read_at(end - start, start), start
                fields, payload = parse(gzip.decompress(held[start - base : start - base + size]))
                kind = fields["warc-type"]
                read = fields["warc-payload-digest"].removeprefix("sha1:")
                if read != digest or kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"record of {id_} in {file} differs from the index")
                rows.append((None if id_ == -(1 << 63) else id_, kind, refers_to, payload if kind == "response" else None, digest))
                size_now += len(payload)
                if size_now > 4 << 20:
                    yield out(rows)
                    rows, size_now = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "record_type", "refers_to", "payload", "digest"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("id", "refers_to", "digest", "file", "start", "size").repartitionByRange(parts, "file", "start").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(run, "page_id long, record_type string, refers_to long, payload binary, digest string")


def keys_of(pages: DataFrame) -> DataFrame:
    """``url_key`` and ``page_id`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], type=pa.string()), batch.column(1)], names=["url_key", "page_id"])

    return pages.select("url", F.col("page_id").cast("long")).mapInArrow(run, "url_key string, page_id long")


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archive every page, then look every page up and read it back: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``.

    Null pages have an empty payload, null urls the empty key. Of rows repeated with one id and payload all are
    responses. Rows without an id are archived too; they are responses unless a row with an id has their payload.
    An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    captures = materialize(write(pages, folder, least), "captures")
    root = build_index(captures, folder)
    lines = materialize(look_up(spark, keys_of(pages), root), "lines")
    read = materialize(fetch(lines).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n")), "read")
    # a revisit's payload is that of the response it names
    full = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("n").alias("full"), F.col("digest").alias("there")).where(F.col("refers_to").isNotNull())
    full = materialize(full.dropDuplicates(["refers_to", "there"]), "responses")
    both = read.join(full, (read["refers_to"] == full["refers_to"]) & (read["digest"] == full["there"]), "left")
    return both.select(
        "page_id",
        F.coalesce("n", "full").alias("payload_bytes"),
        read["digest"].alias("payload_digest"),
        "record_type",
        read["refers_to"],
    )

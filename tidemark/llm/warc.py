"""WARC archives of a page table and a two-level capture index over them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.session import cut_lineage, ensure_checkpoint_dir

#: Captures of a compressed index block.
BLOCK_ROWS = 1000
DATE = "2024-01-01T00:00:00Z"
BYTES_PER_FILE = 1 << 30
#: Record bytes that one task reads back, and the least that are worth a task where there are fewer tasks than cores.
READ_BYTES, LEAST_READ_BYTES = 1 << 28, 1 << 20

CAPTURE = "key string, page_id long, file string, offset long, length long"


def reversed_key(url: str) -> str:
    """The sort key of a URL: host labels from the right, then port, path and query, in lower case."""
    parts = urlsplit(url.strip())
    host, _, port = parts.netloc.rpartition("@")[2].partition(":")
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def _safe_key(url: str | None) -> str:
    try:
        return reversed_key(url or "")
    except ValueError:  # not a URL: it sorts as it is
        return (url or "").lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member: a response, or a revisit of an identical payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = "none" if page_id is None else page_id
    body = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, payload, and the payload length that the HTTP header names."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    headers = {name.lower(): value.strip() for name, value in pairs}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return headers, payload, int(sizes[0])


def _open(uri: str):
    """File system and path of a folder; any scheme that Arrow knows, or a plain local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own below the one that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): of pages with the same payload, all but that with the largest id refer to it.

    Pages are compared by the SHA-256 of the payload. Of equal ids with the same payload one is the response. Nothing
    can refer to a page without id: where no page with an id has its payload, each is a response.
    """
    # the numbers are joined on, so they are stored with the rows
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows.withColumn("sha", F.unhex(F.sha2("html", 256))))
    groups = rows.groupBy("sha").agg(F.max(F.struct("page_id", -F.col("row"))).alias("best"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select(F.col("sha").alias("g"), F.col("best.page_id").alias("last"), (-F.col("best.col2")).alias("first"))
    # kept apart, so that the join has a shuffle of its own on either side and can split a hot payload
    joined = rows.join(cut_lineage(groups), F.col("sha") == F.col("g"), "left")
    refers = F.when(F.col("row") != F.col("first"), F.col("last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, bytes_per_file: int = BYTES_PER_FILE) -> DataFrame:
    """Write the records below ``folder``, a file or more per task; one capture row per record.

    A file name holds the attempt of its task, so a task that runs again leaves the files of a lost attempt unread.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        number, out, name = 0, None, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or out.tell() >= bytes_per_file:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, number = store.open_output_stream(f"{path}/{name}", compression=None), number + 1
                    at = out.tell()
                    out.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers))
                    rows.append((_safe_key(url), page_id, name, at, out.tell() - at))
                yield _captures(rows)
        finally:
            if out is not None:
                out.close()

    return cut_lineage(marked.mapInArrow(write, CAPTURE))


def _captures(rows):
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def write_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sort captures by key into shards of compressed blocks; one row per shard with its first key.

    A shard has two files: the blocks, and a sparse directory with the first key, place and length of each block.
    Captures of one key may run over shards.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}"
        first, directory, block = None, [], []
        out = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out, first = store.open_output_stream(f"{path}/{name}.blocks.gz", compression=None), row[:2]
                block.append(row)
                if len(block) >= block_rows:
                    directory.append(_put(out, block))
                    block = []
        if out is None:
            return
        if block:
            directory.append(_put(out, block))
        out.close()
        with store.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
            f.write("".join(json.dumps(d) + "\n" for d in directory).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((first[0], pa.string()), (first[1], pa.int64()), (name, pa.string()))],
            ["key", "page_id", "shard"],
        )

    # the page id spreads a key with very many captures over shards
    dealt = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return cut_lineage(dealt.mapInArrow(write, "key string, page_id long, shard string"))


def _put(out, block):
    at = out.tell()
    out.write(gzip.compress("".join(json.dumps(r) + "\n" for r in block).encode(), 6, mtime=0))
    return [block[0][0], block[0][1], at, out.tell() - at]


def _place(key: str, page_id: int | None) -> tuple:
    """Order of a capture in the index: by key, then by page id, none first."""
    return key, page_id is not None, page_id or 0


class CaptureIndex:
    """Finds captures by binary search: shard by first key, block by the shard's directory, line in the block.

    ``top`` has (key, page id, shard) of each shard; the shards are as many as partitions, whatever they hold. A
    directory and a block are read when a search first needs them, by a range read, and the last ones are kept.
    """

    def __init__(self, folder: str, top: list[tuple[str, int | None, str]]):
        self.store, self.path = _open(folder)
        self.top = sorted(top, key=lambda t: _place(*t[:2]))
        self.firsts = [_place(*t[:2]) for t in self.top]
        self.shard = self.block = self.blocks = None
        self.directory: list = []
        self.files: dict = {}

    def _shard(self, number: int):
        if self.shard != number:
            name = self.top[number][2]
            with self.store.open_input_stream(f"{self.path}/{name}.directory", compression=None) as f:
                self.directory = [json.loads(line) for line in f.read().decode().splitlines()]
            if self.blocks is not None:
                self.blocks.close()
            self.blocks = self.store.open_input_file(f"{self.path}/{name}.blocks.gz")
            self.shard, self.block = number, None

    def _block(self, number: int):
        if self.block is None or self.block[0] != number:
            at, length = self.directory[number][2:]
            lines = gzip.decompress(self.blocks.read_at(length, at)).decode().splitlines()
            rows = [tuple(json.loads(line)) for line in lines]
            self.block = (number, rows, [_place(*r[:2]) for r in rows])
        return self.block

    def find(self, key: str, page_id: int | None) -> list[tuple]:
        """All captures of a key and page id."""
        wanted, found = _place(key, page_id), []
        # equal keys may begin before the last first key at or below the wanted one
        shard = max(0, bisect_left(self.firsts, wanted) - 1)
        while shard < len(self.firsts) and self.firsts[shard] <= wanted:
            self._shard(shard)
            starts = [_place(*d[:2]) for d in self.directory] if self.block is None else self.starts
            self.starts = starts
            block = max(0, bisect_left(starts, wanted) - 1)
            while block < len(starts) and starts[block] <= wanted:
                _, rows, keys = self._block(block)
                at = bisect_left(keys, wanted)
                while at < len(keys) and keys[at] == wanted:
                    found.append(rows[at])
                    at += 1
                block += 1
            shard += 1
        return found

    def read(self, capture: tuple) -> bytes:
        """The record of a capture, by a range read."""
        _, _, name, at, length = capture
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.path}/{name}")
        return self.files[name].read_at(length, at)


def checked_record(member: bytes) -> tuple[str, int, str, int | None]:
    """(type, payload bytes, payload digest, page referred to) of a record.

    Size and digest of a response are those of the payload that was read; a response whose headers say otherwise is
    damaged and raises. A revisit holds no payload, so its headers say what it refers to.
    """
    headers, payload, length = parse_record(member)
    named = headers["warc-payload-digest"].removeprefix("sha1:")
    refers = headers.get("warc-refers-to")
    if refers:
        return headers["warc-type"], length, named, int(refers.rpartition(":")[2].rstrip(">"))
    found = digest_of(payload)
    if (len(payload), found) != (length, named):
        raise ValueError(f"{headers['warc-record-id']}: payload of {len(payload)} bytes, {found}; its headers say {length}, {named}")
    return headers["warc-type"], len(payload), found, None


def read_tasks(captures: DataFrame) -> int:
    """How many tasks read the records back, by the bytes of the records."""
    size = captures.agg(F.sum("length")).first()[0] or 0
    cores = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // READ_BYTES), min(cores, -(-size // LEAST_READ_BYTES)))


def read_captures(wanted: DataFrame, folder: str, shards: DataFrame, tasks: int | None = None) -> DataFrame:
    """Look up (page_id, url) rows in the index, read their records and check them; one row per capture found.

    Requests are sorted as the index is, so that a task opens few blocks and reads each once. Their keys say nothing
    of the size of their records, so the number of ``tasks`` is given.
    """
    top = [(r.key, r.page_id, r.shard) for r in shards.collect()]  # one entry per partition of the index

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, top)
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for capture in index.find(key, page_id):
                    kind, size, digest, refers = checked_record(index.read(capture))
                    rows.append((page_id, size, digest, kind, refers))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    keyed = wanted.mapInArrow(_keys, "key string, page_id long").distinct()
    ranges = keyed.repartitionByRange(*[tasks] if tasks else [], "key", "page_id")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.sortWithinPartitions("key", "page_id").mapInArrow(read, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_safe_key(u) for u in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, batch.column(0)], ["key", "page_id"])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files with an index, and read every record back through it.

    The files go to ``folder``, by default a new one below ``spark.checkpoint.dir``. A null page is empty, a null
    URL is the empty key. A page without id is a record too, found by its URL: a revisit of the page with an id that
    has the same payload, else a response. Repeated rows are records of their own. An empty table gives no rows.
    Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark)
    captures = write_archives(mark_revisits(pages), folder)
    shards = write_index(captures, folder)
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    return read_captures(wanted, folder, shards, read_tasks(captures))

"""Deterministic sharded WARC archives of web pages (operator 5).

Pages are numbered in ascending order of page_id, then of the payload's digest; ``SHARD_RECORDS`` numbers make a shard. A
shard is written as gzip members, one for each record, into files that roll once they exceed ``FILE_BYTES`` compressed.
Headers, digests and record ids are made from the rows alone (the date is a parameter), so the same rows
give the same files under the same names whatever the partitions. A file is written under a temporary name and renamed;
the manifest, written last, lists what counts.

Numbers come from sorted ranges of ids and digests. They give the first record of each shard (the driver gets these, one
for each shard), by which payloads are dealt to the shards: they are shuffled once. Revisits travel as short rows
that are sorted in front of the page they belong to.

Of the records whose payloads are equal and have at least ``min_bytes`` bytes, the one with the
smallest page_id is a response and the others are revisits that name it.

Defined results: null html is an empty payload; a null url is written as urn:page:<page_id>, control
characters in a url are percent-encoded; ids are percent-encoded in headers, an empty id stays apart from none;
rows that repeat a page_id are records of their own, all responses if it is the smallest of its payload; pages
without an id come first, are never named by a revisit and are one only of a page with an id; an empty table
makes no file and no row. Copies of one page_id and payload stay in one shard, beyond its number of records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import portable, staged, work_dir
from tidelog.llm.token_files import filesystem

SHARD_RECORDS = 4096
FILE_BYTES = 4 << 20
MOST_TASKS = 1 << 15  # beyond, a task writes several neighbouring shards one after the other
DATE = "2020-01-01T00:00:00Z"
NAMES = uuid.UUID("7b6e4f0e-3f0a-5d2b-9c63-2f1f2f6f5a10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{sha}')}>"


def _header(page_id) -> str:
    return urllib.parse.quote(str(page_id), safe="")


def _uri(url: str | None, page_id) -> str:
    url = url or f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, first_id, date: str) -> bytes:
    """One WARC record; ``first_id`` is the page a revisit refers to, None for a response."""
    sha = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first_id is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first_id is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.insert(-1, ("X-Page-ID", _header(page_id)))
    if first_id is not None:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id, sha)), ("X-Refers-To-Page-ID", _header(first_id))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip header without a time
    return packer.compress(raw) + packer.flush()


class _Files:
    """Rolling files of one shard."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.base = filesystem(folder)
        self.fs.create_dir(self.base)
        self.folder, self.shard, self.limit, self.out, self.number, self.done = folder, shard, limit, None, 0, []

    def add(self, raw: bytes) -> None:
        member = _member(raw)
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.temporary = posixpath.join(self.base, f"_tmp-{uuid.uuid4().hex}")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"{self.shard:09d}-{self.number:05d}.warc.gz"
        final = posixpath.join(self.base, name)
        if self.fs.get_file_info(final).size == self.size:  # a task that ran before has written the same
            self.fs.delete_file(self.temporary)
        else:
            self.fs.move(self.temporary, final)
        self.done.append((self.folder, name, self.shard, self.records, self.size, self.sha.hexdigest()))
        self.out, self.number = None, self.number + 1


def numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with ``start``, the number of rows (column ``n``) before each in ascending order; ranges are sorted in parallel."""
    parts = staged(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "page-ranges")
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("own", F.coalesce(own, F.lit(0))).join(before, "part").select(*keys.columns, (F.col("own") + F.col("before")).alias("start"))


def _place(page_id, sha: bytes) -> tuple:
    """Sorts as the columns do: no id first, texts by their bytes."""
    return (page_id is not None, page_id.encode() if isinstance(page_id, str) else page_id if page_id is not None else 0, sha)


def write_warc(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, shard_records: int = SHARD_RECORDS, file_bytes: int = FILE_BYTES,
    date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write the archives and return their manifest: folder, file, shard, records, bytes, sha256."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("sha", F.unhex(F.sha1("html")))
    # Numbers and first pages are found over ids and digests.
    keys = base.groupBy("page_id", "sha").agg(F.count("*").alias("n"), F.max(F.octet_length("html") >= min_bytes).alias("counts"))
    places = staged(numbered(keys, ["page_id", "sha"]).withColumn("shard", F.floor(F.col("start") / shard_records)), "page-places")
    lead = places.groupBy("shard").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "sha")).alias("first")).collect()
    starts = sorted((_place(r["first"]["page_id"], bytes(r["first"]["sha"])), r["shard"]) for r in lead)
    bounds, shards = [p for p, _ in starts], [k for _, k in starts]
    firsts = places.where("counts AND page_id IS NOT NULL").groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
    again = places.where("counts").join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id")))

    @F.arrow_udf("int")
    def dealt(page_id: pa.Array, sha: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, _place(i, h)) - 1 for i, h in zip(page_id.to_pylist(), sha.to_pylist())], pa.int32())

    kind = base.schema["page_id"].dataType
    none = F.lit(None)
    rows = base.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", none.cast(kind).alias("first_id")).unionByName(
        again.select("page_id", "sha", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "first_id")
    )
    rows = rows.withColumn("range", dealt("page_id", "sha")).select("range", *rows.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, revisit = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for place, page_id, sha, kind, url, html, first_id in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if not kind:
                        revisit = (page_id, sha, first_id)
                        continue
                    shard = shards[place]
                    if files is None or files.shard != shard:
                        if files is not None:
                            files.close()
                            done += files.done
                        files = _Files(folder, shard, file_bytes)
                    known = revisit is not None and revisit[:2] == (page_id, sha)
                    files.add(record(page_id, url, html.encode(), revisit[2] if known else None, date))
        if files is not None:
            files.close()
            done += files.done
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["folder", "file", "shard", "records", "bytes", "sha256"])

    tasks = max(1, min(len(bounds), MOST_TASKS))
    task = F.floor(F.col("range") * tasks / max(1, len(bounds))).cast("int")  # neighbours stay together
    ordered = rows.repartitionById(tasks, task).sortWithinPartitions("range", "page_id", "sha", "kind", "url")
    manifest = ordered.mapInArrow(portable(write), "folder string, file string, shard bigint, records bigint, bytes bigint, sha256 string")
    return staged(manifest, "warc-manifest")


def _members(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one at a time."""
    waiting, unpack, parts = b"", None, []
    while True:
        waiting = waiting or stream.read(piece)
        if not waiting:
            return
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(waiting))
        waiting = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = None, []


def parse(raw: bytes) -> dict:
    """Headers, kind and payload of one record; raises if lengths or digests disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError("payload does not match its digest")
    return {"fields": fields, "payload": payload, "size": size, "sha": sha}


def read_warc(manifest: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record in the files."""
    payload = ", payload binary" if with_payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(*(c.to_pylist() for c in batch.columns)):
                store, base = filesystem(folder)
                rows = []
                with store.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for raw in _members(stream):
                        got = parse(raw)
                        f = got["fields"]
                        page_id, first_id = (None if f.get(n) is None else urllib.parse.unquote(f[n]) for n in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page_id, f["WARC-Target-URI"], got["size"], got["sha"], f["WARC-Type"], first_id, got["payload"]))
                        if len(rows) == 512:
                            yield _rows(rows, with_payload)
                            rows = []
                if rows:
                    yield _rows(rows, with_payload)

    files = manifest.select("folder", "file").repartition(max(1, manifest.count()))  # a task for each file
    found = files.mapInArrow(portable(read), f"page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string{payload}")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _rows(rows: list, with_payload: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    width = len(names) if with_payload else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows), kinds))[:width]], names=names[:width])

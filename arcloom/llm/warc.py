"""WARC: a deterministic sharded writer of web archives, and their reader."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stable

#: Rows whose places and sizes reach the driver to cut the shards; more are drawn from by a hash.
SAMPLE = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def gzip_member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, row, url, payload: bytes, keep_id, keep_row, date: str, level: int) -> bytes:
    """A page's record: its headers and digests are made anew from the payload."""
    revisit = keep_row is not None and keep_row != row
    head = HTTP.format(len(payload)).encode()
    block = head if revisit else head + payload
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_urn(keep_id, keep_row) if revisit else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", keep_id if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return gzip_member(fields, block, level)


class Roller:
    """Writes records under temporary names and starts a new file when a shard changes or a file is large enough."""

    def __init__(self, root: str, date: str, level: int, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.folder = f"_tmp/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.base}/{self.folder}")
        self.date, self.level, self.roll = date, level, roll_bytes
        self.shard, self.part, self.out = None, 0, None

    def add(self, shard: int, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.roll):
            yield self.close()
        if self.out is None:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sum = shard, 0, 0, hashlib.sha1()
            self.name = f"part-{shard:06d}-{self.part:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.folder}/{self.name}", compression=None)
            info = f"software: arcloom\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self.put(gzip_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.level))
        self.put(data)
        self.records += 1

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        self.out = None
        return {"temporary": f"{self.folder}/{self.name}", "name": self.name, "bytes": self.size, "records": self.records, "sha1": self.sum.hexdigest()}


class Edges:
    """The first rows (page_id, row; null first) of all shards but the first."""

    def __init__(self, rows: DataFrame, shard_bytes: int):
        size = F.octet_length("payload") + 512
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        share = 1 << 20 if n <= SAMPLE else (SAMPLE << 20) // n + 1
        drawn = rows.filter(F.pmod(F.xxhash64("page_id", "row"), F.lit(1 << 20)) < share).select("page_id", "row", size.alias("size")).collect()
        drawn.sort(key=lambda r: (r.page_id is not None, r.page_id or 0, r.row))
        ends = np.cumsum([r.size for r in drawn])
        n_shards = max(1, min(-(-total // shard_bytes), SAMPLE // 16))
        at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, n_shards) / n_shards, side="right")) if n else []
        first = [drawn[k] for k in at if 0 < k < len(drawn)]
        self.n_null = sum(r.page_id is None for r in first)
        self.ids = np.array([r.page_id or 0 for r in first], np.int64)
        self.rows = np.array([r.row for r in first], np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def shard(self, ids: np.ndarray, null: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of the edges come before or with each row."""
        k = self.n_null
        own = self.ids[k:]
        out = np.where(null, np.searchsorted(self.rows[:k], rows, side="right"), k + np.searchsorted(own, ids, side="left"))
        for i in np.unique(own):  # an id that may be in several shards
            a, b = np.searchsorted(own, [i, i + 1]) if i < np.iinfo(np.int64).max else (np.searchsorted(own, i), len(own))
            at = np.flatnonzero(~null & (ids == i))
            out[at] = k + a + np.searchsorted(self.rows[k + a : k + b], rows[at], side="right")
        return out.astype(np.int32)


def write_archives(
    pages: DataFrame,
    path: str | None = None,
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 4 << 20,
    level: int = 6,
    date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Write a WARC record for each row of pages (page_id, url, html) and return the archives' folder.

    Rows are range-sorted by page_id: shards of about shard_bytes are cut at quantiles of (page_id, row), taken from at
    most some SAMPLE rows that a hash draws (all rows, where these are no more), weighed by their bytes; so far-off
    page_ids move no edge, a hot or the null one may span shards, and beyond SAMPLE / 16 shards they are larger. A task
    writes its shard in page_id order, starts a new file before one gets larger than roll_bytes (compressed), uses
    temporary names in a folder of its own and returns a manifest row a file; the driver then moves the files of the
    attempts that succeeded to their names and writes MANIFEST.json last, so a lost or repeated task leaves nothing
    behind. Names, order, headers and bytes depend on the rows and their partitioning only.

    Of records with equal payloads the one with the largest page_id (the last row of it, if it repeats) is the
    response, the others are revisits that refer to it; a small row that says so goes ahead of each page that has copies, so
    the pages themselves are shuffled once. A null html is an empty payload, a null url leaves out the
    target, a null page_id sorts first. An empty table gives a folder with an empty manifest; very long texts are records like any
    other, larger than a file's limit if need be. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = stable(pages.select("page_id", "url", "html"), "pages").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    edges = Edges(rows, shard_bytes)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, null: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(edges.shard(ids.to_numpy(), null.to_numpy(zero_copy_only=False), row.to_numpy()))

    kept = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("keep")).filter("n > 1").drop("n")
    told = rows.select("page_id", "row", "digest").join(kept, "digest").select("page_id", "row", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("keep.page_id").alias("keep_id"), F.col("keep.row").alias("keep_row"))
    pages = rows.select("page_id", "row", "url", "payload", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"))
    shard = shard_of(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), F.col("row"))
    dealt = (
        pages.unionByName(told)
        .select(shard.alias("shard"), "page_id", "row", "url", "payload", "keep_id", "keep_row")
        .repartitionById(len(edges) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "row", F.col("payload").isNotNull())
    )
    root = (path or scratch(spark, "warc")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, keep = None, [], (None, None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                s, page_id, row, url, payload, *told = (col[i].as_py() for col in batch.columns)
                if payload is None:
                    keep = (row, *told)
                    continue
                rest = (page_id, row, url, payload, *(keep[1:] if keep[0] == row else (None, None)))
                roller = roller or Roller(root, date, level, roll_bytes)
                done.extend(roller.add(s, page_record(*rest, date, level)))
        if roller is not None:
            done.append(roller.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base)
    files = [r.asDict() for r in dealt.mapInArrow(run, "temporary string, name string, bytes long, records long, sha1 string").collect()]
    for f in files:
        store.move(f"{base}/{f.pop('temporary')}", f"{base}/{f['name']}")
    with store.open_output_stream(f"{base}/MANIFEST.json.tmp") as out:
        out.write(json.dumps({"files": sorted(files, key=lambda f: f["name"])}, indent=1).encode())
    store.move(f"{base}/MANIFEST.json.tmp", f"{base}/MANIFEST.json")
    if files:
        store.delete_dir(f"{base}/_tmp")
    return root


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(1 << 20)):
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")
    return fields, block


def read_archives(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """The page records of the archives that the folder's manifest lists, a task for each file and one record in memory at a time.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to (page_id of the response), record_id and
    payload (null unless payloads, and for revisits). Every block is held against its digest.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/MANIFEST.json") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        rows: list[dict] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for fields, block in map(parse_record, members(f)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["WARC-Type"]
                        rows.append(
                            {
                                "page_id": int(fields["Page-Id"]) if "Page-Id" in fields else None,
                                "url": fields.get("WARC-Target-URI"),
                                "payload_bytes": int(re.search(rb"Content-Length: (\d+)", head)[1]),
                                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "record_type": kind,
                                "refers_to": int(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None,
                                "record_id": fields["WARC-Record-ID"],
                                "payload": payload if payloads and kind == "response" else None,
                            }
                        )
                        if len(rows) >= (64 if payloads else 5000):
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary")

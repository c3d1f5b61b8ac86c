"""WARC archives: a deterministic sharded writer with revisits of equal payloads, and a reader.

A first pass writes each page's key, digest and size to the shared folder. From these follow the revisits (records of equal payloads)
and the shards (ranges of sorted records of about equal size, from sums over the sorted sizes of all records). A second pass
compresses records where pages are read, so only compressed records are shuffled; they meet in their shard, are sorted, and are
appended to files that roll at a compressed size. The same pages give the same files, byte for byte, whatever the partitioning.

A task writes under a name of its own attempt and reports its files as rows; only the rows of attempts that succeeded make the
manifest, by which files are renamed, so what lost or repeated attempts leave behind is never seen. Readers go by the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import utf8
from .shared import remove, shared_folder, small_batches, unique

#: Compressed bytes after which a file ends, and bytes before compression of a shard, which one task writes. Archives of many terabytes want larger ones.
ROLL_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: What a record's headers count for in a shard.
HEADER_BYTES = 600
BROADCAST_ROWS = 100_000
LEVEL = 6
#: Fixed values of the format.
VERSION, IDENTICAL = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
_PREPARED = "url string, sha256 binary, sha1 string, size long, member binary"
_MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha256 string"
_RECORD = "id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    """A URL for a header line: spaces and control characters as percent codes; without any, a name of its own."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"


def _record_id(key: str | None, sha256: bytes, copy: int) -> str:
    """Of the key, the payload and which of equal rows it is."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}:{sha256.hex()}:{copy}'.encode()).digest()[:16])}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member of its own, without a time, so that equal records are equal bytes."""
    digest = [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, *digest])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}\r\n".encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _headers(kind: str, key: str | None, url: str, sha256: bytes, sha1: str, copy: int, date: str, owner: tuple[str, str] | None = None) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(key, sha256, copy)), ("WARC-Date", date), ("WARC-Target-URI", _safe(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if owner:
        out += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _record_id(owner[0], sha256, 0)), ("WARC-Refers-To-Target-URI", _safe(owner[1])), ("X-Refers-To-Key", owner[0])]
    return out + ([("X-Record-Key", key)] if key is not None else [])


def _texts(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("key"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))


def described(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(key, url, sha256, size) of each page: its id and its payload's digest and bytes."""
    return _texts(pages, id_col, url_col, payload_col).select("key", "url", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)).alias("sha256"), F.octet_length("payload").cast("long").alias("size"))


def prepare(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: str = DATE) -> DataFrame:
    """(key, url, sha256, sha1, size, member): each page's payload digests and its compressed response record."""
    small_batches(pages.sparkSession)
    rows = _texts(pages, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("payload"))
            data, out = memoryview(raw), []
            keys, urls = batch.column("key").cast(pa.string()).to_pylist(), batch.column("url").to_pylist()
            for i, (key, url) in enumerate(zip(keys, urls, strict=True)):
                payload = bytes(data[bounds[i] : bounds[i + 1]])
                sha256, sha1 = hashlib.sha256(payload).digest(), base32_sha1(payload)
                out.append((sha256, sha1, len(payload), member(_headers("response", key, url, sha256, sha1, 0, date), HTTP.format(len(payload)).encode() + payload)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int64(), pa.binary()), strict=True))], names=["key", "url", "sha256", "sha1", "size", "member"])

    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *T.StructType.fromDDL(_PREPARED).fields]))


def revisits(narrow: DataFrame, least_bytes: int) -> DataFrame:
    """(key, sha256, owner, owner_url): keys and payloads that occur more than once, with the greatest key of that payload, which is the response.

    Payloads below least_bytes, and pages without a key, take no part. Counts are summed before the shuffle, so a payload that many
    pages share is a row by task; the join back is broadcast up to BROADCAST_ROWS payloads, beyond which Spark splits frequent ones.
    """
    known = narrow.where(F.col("key").isNotNull() & (F.col("size") >= least_bytes))
    groups = known.groupBy("sha256").agg(F.max(F.struct("key", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").select("sha256", F.col("top.key").alias("owner"), F.col("top.url").alias("owner_url"))
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return known.select("key", "sha256").distinct().join(F.broadcast(groups) if few else groups, "sha256").select("key", "sha256", "owner", "owner_url")


def shard_starts(narrow: DataFrame, folder: str, shard_bytes: int) -> list:
    """The keys at which shards 1, 2.. begin: where the bytes of all records before, in the order of keys, pass a multiple of shard_bytes.

    Sums over sorted ranges, which are written once; a row by range gives what is before it. Only the starts reach the driver.
    """
    spark = narrow.sparkSession
    sizes = narrow.where("key is not null").groupBy("key").agg(F.sum(F.col("size") + HEADER_BYTES).alias("size"))
    sizes.repartitionByRange("key").sortWithinPartitions("key").withColumn("range", F.spark_partition_id()).write.parquet(f"{folder}/sizes")
    written = spark.read.parquet(f"{folder}/sizes")
    totals = written.groupBy("range").agg(F.sum("size").alias("n"))
    before = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(before), "range").withColumn("at", F.col("before") + F.col("own"))
    crossed = F.floor(F.col("at") / shard_bytes) != F.floor((F.col("at") + F.col("size")) / shard_bytes)
    return [r["key"] for r in placed.where(crossed).select("key").orderBy("key").collect()]  # a key by shard


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder: local paths and what Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "/", folder))


def _sorted_into_shards(prepared: DataFrame, decisions: DataFrame, starts: list) -> DataFrame:
    """Records and decisions with their shard, in the order (key, sha256, decision first, url) within it."""
    nulls = lambda kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    told = decisions.select("key", F.lit("").alias("url"), "sha256", F.lit(0).alias("kind"), F.col("owner").cast("string").alias("owner"), "owner_url", *nulls((("sha1", "string"), ("size", "long"), ("member", "binary"))))
    records = prepared.select("key", "url", "sha256", F.lit(1).alias("kind"), *nulls((("owner", "string"), ("owner_url", "string"))), "sha1", "size", "member")
    both = records.unionByName(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [0 if k is None else bisect_right(starts, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    dealt = both.mapInArrow(run, T.StructType([*both.schema.fields, T.StructField("shard", T.IntegerType())]))
    return dealt.repartition(len(starts) + 1, "shard").sortWithinPartitions("shard", "key", "sha256", "kind", "url")


class _Writer:
    """Appends records to files of one shard, each under a temporary name."""

    def __init__(self, folder: str, roll_bytes: int):
        self.store, self.root = _store(folder)
        self.roll_bytes = roll_bytes
        self.attempt = uuid.uuid4().hex
        self.file, self.shard, self.done = None, None, []

    def add(self, shard: int, data: bytes) -> None:
        if self.file and (shard != self.shard or self.bytes >= self.roll_bytes):
            self.close()
        if not self.file:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.records, self.bytes, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"{shard:07d}-{self.part:04d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.file = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.file.write(data)
        self.sha.update(data)
        self.records += 1
        self.bytes += len(data)

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.done.append((self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest()))
            self.file = None


def _write_shards(rows: DataFrame, folder: str, roll_bytes: int, date: str) -> DataFrame:
    """The files that tasks have written, under temporary names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, roll_bytes)
        last, copy, owner = None, 0, None
        for batch in batches:
            b = {n: batch.column(n) for n in batch.schema.names}
            keys = b["key"].cast(pa.string()).to_pylist()
            for i in range(batch.num_rows):
                key, sha256 = keys[i], b["sha256"][i].as_py()
                if (key, sha256) != last:
                    last, copy, owner = (key, sha256), 0, None
                if not b["kind"][i].as_py():
                    owner = (b["owner"][i].as_py(), b["owner_url"][i].as_py())
                    continue
                if owner and (owner[0] != key or copy):
                    block = HTTP.format(b["size"][i].as_py()).encode()
                    data = member(_headers("revisit", key, b["url"][i].as_py(), sha256, b["sha1"][i].as_py(), copy, date, owner), block)
                else:
                    data = b["member"][i].as_buffer()
                out.add(b["shard"][i].as_py(), data)
                copy += 1
        out.close()
        columns = list(zip(*out.done, strict=True)) if out.done else [[]] * 7
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    return rows.mapInArrow(run, _MANIFEST)


def _committed(staged: DataFrame, folder: str) -> DataFrame:
    """Renames the files of the manifest. A file that already has its name was renamed by an earlier attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{old}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{old}", f"{root}/{new}")
                elif store.get_file_info(f"{root}/{new}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{old}")
            yield batch

    return staged.mapInArrow(run, staged.schema).drop("temporary")


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE,
) -> DataFrame:
    """Writes a record for each row of pages to a new folder and gives the manifest (shard, part, name, records, bytes, sha256).

    Of rows with equal payloads of at least revisit_bytes the one with the greatest id is the response, of several such rows the first by
    url; the others are revisits that refer to it. Rows without an id are responses. Null payloads and URLs are empty, and other columns
    are left out. Rows that repeat an id and payload stand together in one shard. A second call needs another folder. No rows give no files.
    """
    spark = pages.sparkSession
    work = f"{shared_folder(spark)}/{unique('warc')}"
    described(pages, id_col, url_col, payload_col).write.parquet(f"{work}/described")
    narrow = spark.read.parquet(f"{work}/described")
    rows = _sorted_into_shards(prepare(pages, id_col, url_col, payload_col, date), revisits(narrow, revisit_bytes), shard_starts(narrow, work, shard_bytes))
    store, root = _store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    _write_shards(rows, folder, roll_bytes, date).write.parquet(f"{folder}/_staged")
    remove(spark, work)
    _committed(spark.read.schema(_MANIFEST).parquet(f"{folder}/_staged"), folder).write.parquet(f"{folder}/_manifest")
    remove(spark, f"{folder}/_temporary")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files of an archive."""
    return spark.read.parquet(f"{folder}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive; one record at a time is in memory. Raises where a record is cut short or its block digest is wrong."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line.strip() != VERSION.encode():
                raise ValueError(f"not a record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := f.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(":")
                headers[k] = v.strip()
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
            yield headers, block


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} does not hold its payload")
    return headers.get("X-Record-Key"), headers["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, headers.get("X-Refers-To-Key")


def read_archives(spark: SparkSession, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records of the committed files, ids as text.

    A file is read by one task, record by record, and its digests are checked. Revisits have no payload of their own: bytes and digest are those they refer to.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    files = manifest(spark, folder).select("name")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for given in batches:
            for name in given.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for headers, block in records(stream):
                        rows.append(_parsed(headers, block))
                        held += len(block) + 200
                        if held >= batch_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, files.count())
    return files.repartition(n, "name").mapInArrow(run, _RECORD)


def digest(found: DataFrame, id_type: str, id_col: str = "page_id") -> DataFrame:
    """The contract's columns."""
    return found.select(F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))

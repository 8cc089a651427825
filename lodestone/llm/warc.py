"""Deterministic sharded WARC archives of pages, and their reader (operator 12)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged

#: A file is closed once it has so many compressed bytes.
ROLL_BYTES = 1 << 30
#: Payload bytes of one shard, about, and rows whose keys are looked at for each border between shards.
SHARD_BYTES, SAMPLED = 1 << 32, 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # (fixed value: names that are URLs)
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, position long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(url: str | None) -> str:
    """A header's value: what isn't printable ASCII is percent-encoded, so no url can end a line; null: about:invalid."""
    return "about:invalid" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record_id(page: int | None, digest: str, nth: int = 0) -> str:
    """digest: sha-256 of the payload; nth: earlier records with the same of both."""
    return uuid.uuid5(NAMESPACE, f"{page}/{digest}/{nth}").urn


def record(page: int | None, url: str | None, payload: bytes, key: str, nth: int, first: int | None, revisits: bool, date: str) -> bytes:
    """One record without compression. A revisit keeps the response's HTTP header, with the payload's length, and no payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisits:
        block += payload
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", f"<{record_id(page, key, nth)}>"), ("WARC-Date", date), ("WARC-Target-URI", uri(url))]
    if revisits:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(first, key)}>")]
        if first is not None:
            fields.append(("Refers-To-Page", str(first)))
    if page is not None:
        fields.append(("Page", str(page)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time or a name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roll:
    """Writes a shard's records in order to files of about `most` compressed bytes; a file gets its name when it is whole."""

    def __init__(self, folder: str, shard: int, most: int):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.shard, self.most, self.number, self.out = shard, most, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.own = f"{self.base}/.{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.hash = self.fs.open_output_stream(self.own), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.most:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.fs.move(self.own, f"{self.base}/{name}")
        self.number += 1
        return name, self.shard, self.records, self.size, self.hash.hexdigest()


def payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page, url, payload, digest): payloads as bytes, null ones empty."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def borders(keys: DataFrame, shards: int) -> list[tuple[int, str]]:
    """Keys between shards of about as many bytes: a sample of the rows of least hash, cut at equal sums. The same rows
    give the same borders, however they are dealt out."""
    least = keys.where(F.col("page").isNotNull()).select("page", "digest", "size").orderBy(F.xxhash64("page", "digest"), "page", "digest").limit(SAMPLED * shards)
    rows = sorted((r["page"], r["digest"], r["size"] + 500) for r in least.collect())
    if not rows:
        return []
    done = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(done, done[-1] * np.arange(1, shards) / shards)
    return sorted({rows[i][:2] for i in at.tolist()})


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, revisit_from: int = 0, level: int = 6, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row, sorted by page and payload, to files pages-SHARD-NUMBER.warc.gz in the folder, and
    their manifest beside them.

    Of the rows with equal payloads of at least revisit_from bytes the one of smallest page is a response, and the
    others are revisits that refer to it; every other row is a response. Rows are dealt to shards by range; the borders
    come from the rows' own keys, so the same rows, number of shards and parameters give the same bytes. shards: by the
    payloads' size, and at least spark.sql.shuffle.partitions. A file is written under a name of its own, renamed when it
    is whole, and counts only once the manifest names it, which is renamed last; a task or an application that dies
    leaves nothing that a reader sees. The folder may be in any store that Spark's shared folder is in; files of an
    earlier run in it are replaced.

    Which row is a response is found from ids and digests alone; payloads are shuffled once, by range, and meet the
    decisions of their page and digest in the sorted shard. A null payload is an empty one; a null page comes last and is
    never preferred; of rows with equal page and payload the one with the smallest url is first. Other columns are not
    written. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    rows = payloads(pages, id_col, url_col, payload_col)
    keys = staged(rows.select("page", "digest", F.length("payload").cast("long").alias("size")), "digests")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    edges = borders(keys, n)
    n = len(edges) + 1

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, digest: pd.Series) -> pd.Series:
        ids = np.array([e[0] for e in edges], np.int64)
        value = page.to_numpy()
        low, high = np.searchsorted(ids, value), np.searchsorted(ids, value, "right")
        out = low.copy()
        for i in np.flatnonzero(low < high).tolist():  # pages that a border names
            out[i] = bisect_right(edges, (int(value[i]), digest.iloc[i]), low[i], high[i])
        return pd.Series(out.astype("int32"))

    smallest = F.min(F.struct(F.col("page").isNull().alias("none"), "page"))
    groups = keys.where(F.col("size") >= revisit_from).groupBy("digest").agg(smallest["page"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    decided = keys.where(F.col("size") >= revisit_from).join(groups, "digest").select("page", "digest", "first").distinct()
    told = decided.select("page", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    wide = rows.select("page", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload")
    shard = F.when(F.col("page").isNull(), len(edges)).otherwise(shard_of(F.coalesce("page", F.lit(0)), "digest"))
    dealt = told.unionByName(wide).withColumn("shard", shard).repartitionById(n, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.col("page").asc_nulls_last(), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, decision, head, before, nth, done = None, None, None, None, 0, []
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            for i in range(len(b)):
                page, digest, first, shard = (columns[c][i].as_py() for c in ("page", "digest", "first", "shard"))
                if columns["kind"][i].as_py() == 0:
                    decision, head = (page, digest), first
                    continue
                nth = nth + 1 if (page, digest) == before else 0
                before = page, digest
                revisits = decision == before and (nth > 0 or page != head)
                data = record(page, columns["url"][i].as_py(), columns["payload"][i].as_py(), digest, nth, head if revisits else None, revisits, date)
                roll = roll or Roll(folder, shard, roll_bytes)
                done += roll.add(member(data, level))
        if roll and roll.out:
            done.append(roll.close())
        if done:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["file", "shard", "records", "bytes", "sha256"])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at, own = hadoop(f"{folder}/manifest"), hadoop(f"{folder}/.manifest-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(folder))
    ordered.mapInArrow(run, MANIFEST).write.json(own.toString())
    fs.delete(at, True)
    if not fs.rename(own, at):
        raise OSError(f"the manifest of {folder} could not be put in place")


class Records:
    """Parses the members of one file as they come, a record at a time."""

    def __init__(self, stream, name: str, chunk: int = 1 << 16):
        self.stream, self.name, self.chunk = stream, name, chunk

    def members(self) -> Iterator[tuple[int, bytes]]:
        """(position, bytes) of each gzip member."""
        z, parts, at, read, data = zlib.decompressobj(31), [], 0, 0, b""
        while True:
            if not data:
                data = self.stream.read(self.chunk)
                read += len(data)
                if not data:
                    if parts:
                        raise ValueError(f"{self.name} ends within a record")
                    return
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield at, b"".join(parts)
                at = read - len(data)
                z, parts = zlib.decompressobj(31), []

    def __iter__(self) -> Iterator[tuple]:
        for at, data in self.members():
            head, _, block = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            where = f"{self.name} at {at}"
            size = int(fields["Content-Length"])
            if not version.startswith("WARC/1.") or block[size:] != b"\r\n\r\n":
                raise ValueError(f"no record in {where}")
            block = block[:size]
            if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"another block than its digest says in {where}")
            http, _, payload = block.partition(b"\r\n\r\n")
            length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                raise ValueError(f"another payload than its digest says in {where}")
            page, first = (int(fields[k]) if k in fields else None for k in ("Page", "Refers-To-Page"))
            yield page, fields["WARC-Target-URI"], length, digest, kind, first, payload if kind == "response" else None, self.name, at


def read_archives(spark: SparkSession, folder: str, payload: bool = True, files: int | None = None) -> DataFrame:
    """The records of all files that the manifest names, in columns of RECORDS; digests, lengths and counts are checked.
    Payloads of revisits are null (payload=False: all). A file is streamed by one task, a record at a time."""
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, promised in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in Records(stream, name):
                        n += 1
                        held.append(r if payload else (*r[:6], None, *r[7:]))
                        size += len(held[-1][6] or b"") + 200
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held, size = [], 0
                if n != promised:
                    raise ValueError(f"{name} has {n} records; its manifest says {promised}")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "records").repartition(n, "file").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, **how) -> DataFrame:
    """Pages written to archives in the shared folder and read back from them."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder, **how)
    return read_archives(pages.sparkSession, folder, payload=False)


def warc_sql(revisit_from: int = 0) -> str:
    """What archived() tells of each page, in DuckDB's dialect."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (
  SELECT page_id, hex, octet_length(encode(html)) AS n, first_value(page_id) OVER w AS head, row_number() OVER w AS place
  FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + i * 5 // 4, 2))::INTEGER >> (3 - i * 5 % 4)::INTEGER) & 31)), 1)), '') AS payload_digest,
  CASE WHEN place > 1 AND n >= {revisit_from} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 AND n >= {revisit_from} THEN head END AS refers_to
FROM q"""

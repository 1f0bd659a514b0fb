"""WARC archives: a Python data source to read them, a writer with revisits (operator 3).

Files hold one gzip member per record, with the "sl" extra field (compressed
and uncompressed length), so a reader passes over a record without inflating
it. The data source plans byte ranges of the files as partitions, takes
equality filters on the record type and on header columns, inflates a record
only as far as its headers, and the rest only where a payload is asked for and
the filters let the record through.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .shared import AT, FILE, Lookup, drop_path, file_size, list_files, lookup_table, make_folder, open_read, open_write, shared_path, slices, small_batches, table, texts_of, with_buckets, with_row_ids, written

SUFFIX = ".warc.gz"
#: Start of each member: gzip with one extra field "sl" of 8 bytes.
_MEMBER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id long, payload_digest string, payload_bytes long, refers_to long, http_status int, payload binary"
SPLIT_BYTES = 64 << 20
#: A file that lists the archives of a folder: those of tasks that ended well, and no others.
LIST = "archives.txt"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_HEADER_COLUMNS = frozenset(("record_type", "record_id", "target_uri", "date", "page_id", "payload_digest"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(block: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(block) + c.flush()
    tail = struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)
    whole = len(_MEMBER) + 8 + len(body) + 8
    return _MEMBER + struct.pack("<II", whole & 0xFFFFFFFF, len(block) & 0xFFFFFFFF) + body + tail


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Truncated: length"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def write_pages(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", level: int = 1) -> list[tuple[str, int]]:
    """A WARC record per row of pages (page_id, url, html); (path, records) of each file.

    Of rows with equal payloads of at least min_revisit_bytes, those with the
    largest page_id (one, unless rows repeat) are responses and the others
    revisits of it; a null page_id is below all others, and where a group has
    no other, all its rows are responses. A null html is the empty payload. A
    null url gives no target URI. An empty table gives no files. Only files of
    tasks that ended well are listed.

    Digests are grouped first, with partial aggregation; only ids of rows and
    their digests are joined to those of several rows. What the join says of a
    row is looked up by its row id when the pages are read again and written,
    so no page is shuffled.
    """
    spark, made = pages.sparkSession, []
    small_batches(spark)
    make_folder(folder)
    numbered = with_row_ids(pages, made)
    rows = numbered.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), FILE, AT)
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    keyed = rows.where(F.octet_length("html") >= min_revisit_bytes).select(FILE, AT, "page_id", "sha1")
    many = keyed.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    many = written(many.where("n > 1 AND first_id IS NOT NULL").select("sha1", "first_id"), "warc-copies", made)
    revisits = keyed.join(many, "sha1").where(~F.col("first_id").eqNullSafe(F.col("page_id"))).select(FILE, AT, F.col("first_id").alias("refers_to"))
    decided = lookup_table(revisits, "warc-revisits", made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n, path, known = None, 0, "", Lookup(decided)
        for batch in slices(batches, 256, "html"):
            for part, found, at in known.pick(batch):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
                    out = open_write(path)
                refers = found.column("refers_to").take(at).to_pylist() if found is not None else [None] * part.num_rows
                for page_id, url, sha1, refers_to, text in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "sha1")), refers, texts_of(part, "html")):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    out.write(_member(_record("response" if refers_to is None else "revisit", page_id, url, text.encode(), digest, refers_to, date), level))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    files = [(r.path, r.n) for r in with_buckets(rows).mapInArrow(run, "path string, n long").collect()]
    for path in made:
        drop_path(spark, path)
    with open_write(f"{folder}/{LIST}") as file:
        file.write("\n".join(path for path, _ in files).encode())
    return files


def archives(path: str) -> list[str]:
    """The archives of a folder, by its own list if it has one, or the archive itself."""
    if path.endswith(SUFFIX):
        return list_files(path, SUFFIX)
    if list_files(path, LIST):
        with open_read(f"{path.rstrip('/')}/{LIST}") as file:
            return file.read().decode().split("\n") if file_size(f"{path.rstrip('/')}/{LIST}") else []
    return list_files(path, SUFFIX)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "none")
        if self.payload not in ("none", "check", "full"):
            raise ValueError(f"payload is none, check or full, not {self.payload!r}")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if column in _HEADER_COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((column, frozenset((f.value,))))
            elif column in _HEADER_COLUMNS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in _HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.present.append(column)
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for f in archives(self.path):
            size = file_size(f)
            out += [Range(f, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._records(partition) if partition.path else ():
            rows.append(row)
            held += len(row[-1] or b"")
            if len(rows) >= 1000 or held > 16 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, part: Range) -> Iterator[tuple]:
        with open_read(part.path) as file:
            at = _sync(file, part.begin, part.end) if part.begin else 0
            while at is not None and at < part.end:
                file.seek(at)
                head = file.read(len(_MEMBER) + 8)
                if head[: len(_MEMBER)] != _MEMBER:
                    raise ValueError(f"no WARC record at byte {at} of {part.path}")
                whole, _ = struct.unpack_from("<II", head, len(_MEMBER))
                row = self._record(file, whole - len(_MEMBER) - 8)
                if row is not None:
                    yield row
                at += whole

    def _record(self, file, left: int) -> tuple | None:
        inflate, text = zlib.decompressobj(-15), b""
        while (cut := text.find(b"\r\n\r\n")) < 0:
            data = inflate.unconsumed_tail or file.read(min(left, 4096))
            if not inflate.unconsumed_tail:
                left -= len(data)
            if not data:
                raise ValueError("a WARC record ends within its headers")
            text += inflate.decompress(data, 4096)
        head = _headers(text[:cut])
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        record_id = head.get("warc-record-id")
        row = {"record_type": head.get("warc-type"), "record_id": record_id, "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "page_id": _page(record_id), "payload_digest": digest}
        if any(row[c] not in values for c, values in self.wanted) or any(row[c] is None for c in self.present):
            return None
        rest = text[cut + 4 :]

        def more(limit: int) -> bytes:
            nonlocal left
            data = inflate.unconsumed_tail
            if not data:
                data = file.read(min(left, 1 << 16))
                left -= len(data)
            return inflate.decompress(data, limit) if data else b""

        while (cut := rest.find(b"\r\n\r\n")) < 0:
            if not (new := more(4096)):
                break
            rest += new
        http = _headers(rest[: max(cut, 0)])
        status = rest[:cut].split(b"\r\n", 1)[0].split(b" ")
        size, payload = int(http.get("content-length", 0)), None
        if self.payload != "none" and row["record_type"] == "response":
            length = int(head["content-length"]) - cut - 4
            parts, have = [rest[cut + 4 :]], len(rest) - cut - 4
            while have < length and (new := more(1 << 20)):
                parts.append(new)
                have += len(new)
            payload = b"".join(parts)[:length]
            if digest is not None and digest_of(payload) != digest or len(payload) != length:
                raise ValueError(f"payload of {record_id} does not have its digest or length")
            size = length
        return (*row.values(), size, _page(head.get("warc-refers-to")), int(status[1]) if len(status) > 1 else None, payload if self.payload == "full" else None)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    if not urn or not urn.startswith("<urn:x-page:"):
        return None
    number = urn.removeprefix("<urn:x-page:").partition(":")[0]
    return int(number) if number else None


def _sync(file, begin: int, end: int) -> int | None:
    """The first member that starts in a range."""
    at, tail = begin, b""
    file.seek(begin)
    while at - len(tail) < end:
        data = file.read(1 << 16)
        if not data:
            return None
        text = tail + data
        found = text.find(_MEMBER)
        if found >= 0:
            return at - len(tail) + found
        at += len(data)
        tail = text[-len(_MEMBER) + 1 :]
    return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _COLUMNS)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder): options payload (none, check: decode and verify, full) and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, payload: str = "none", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives in a folder; an empty folder gives no rows."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).option("split_bytes", split_bytes).load(folder)


def verified_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives: of responses the payloads are decoded and held against their digests, of revisits the headers are read alone.

    The record type is pushed into each of the two scans.
    """
    responses = read_archives(spark, folder, payload="check").where("record_type = 'response'")
    return responses.unionByName(read_archives(spark, folder).where("record_type = 'revisit'"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), folder)
    return verified_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """SHA-1 as hex from DuckDB, base32 by tens of bits through a table of digits."""
    digits = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h || '0', {1 + (5 * k) // 4}, 3) AS INTEGER) >> {12 - 5 - (5 * k) % 4}) & 31 AS INTEGER), 1)" for k in range(32))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
w AS (SELECT h, max(page_id) AS first_id FROM h GROUP BY h)
SELECT page_id, payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h JOIN w USING (h)"""

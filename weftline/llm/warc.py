"""WARC (9): archives as a PySpark Python data source.

``spark.read.format("warc")`` plans partitions from files (small files together,
a file never split), accepts pushed filters on header fields, and parses
a record's headers before anything else: a record that fails the filters, or
any record when ``payload`` is ``false``, is skipped without inflating its payload.
``df.write.format("warc")`` writes one gzip member per record; the member's
length stands in its gzip extra field, so a reader seeks over it.

Files are reached through ``pyarrow.fs``, by URI.  Each task writes under a name of
its own and the commit renames; what lost or repeated tasks of the same write left is deleted
then.  ``overwrite`` deletes the archives that stood there before, once the new ones are in place.

Digests are computed in the JVM, and payloads stay where they were read: of what repeats
only digests and ids are shuffled, and the table of repeats is broadcast where its counted size allows.

Edge cases: null html is the empty payload; null urls write no target header and read back
as null; rows repeated with one page_id are written once each, all of them responses if that
page_id is its payload's smallest; a row without page_id is written under an empty name and
stands first for a payload only if no row with an id does; an empty table makes an empty archive,
which reads back as no rows; records without ``X-Payload-Length`` (other producers') are opened to count their payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from weftline.llm.common import fresh_path, table, written

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: The header field behind each column that a filter can be pushed on.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "payload_bytes": "x-payload-length",
    "refers_to": "warc-refers-to",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
#: The table of repeated payloads is broadcast up to this many bytes, at ``REPEAT_BYTES`` a row.
BROADCAST_BYTES = 8 << 20
REPEAT_BYTES = 64


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def encode_record(row: dict) -> bytes:
    """One WARC/1.1 record."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    block = HTTP + (b"" if revisit else payload)
    heads = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", DATE)]
    if row["target_uri"] is not None:
        heads.append(("WARC-Target-URI", " ".join(row["target_uri"].split())))
    heads += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"]))]
    if revisit:
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field (id WL) holds its whole length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    head = 10 + 2 + 4 + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"WL" + struct.pack("<HQ", 8, head + len(body) + 8) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def tidy(name: str, value: str | None) -> str | int | None:
    if value is None:
        return None
    if name == "payload_bytes":
        return int(value)
    if name == "payload_digest":
        return value.removeprefix("sha1:")
    return value.strip("<>") if name in ("record_id", "refers_to") else value


class Members:
    """Members of an archive file: headers first, the rest on demand."""

    CHUNK = 16 << 10

    def __init__(self, f, plain: bool):
        self.f, self.plain = f, plain

    def __iter__(self) -> Iterator[tuple[bytes, callable]]:
        at = 0
        while True:
            self.f.seek(at)
            start = self.f.read(self.CHUNK)
            if not start:
                return
            got = self._plain(at, start) if self.plain else self._gzip(at, start)
            head, rest, at = got
            yield head, rest

    def _plain(self, at: int, seen: bytes):
        while (end := seen.find(b"\r\n\r\n")) < 0:
            more = self.f.read(self.CHUNK)
            if not more:
                raise ValueError("a record's headers do not end")
            seen += more
        size = int(parse_headers(seen[:end])["content-length"])

        def rest() -> bytes:
            self.f.seek(at + end + 4)
            return self.f.read(size)

        return seen[:end], rest, at + end + 4 + size + 4

    def _gzip(self, at: int, seen: bytes):
        known = struct.unpack("<Q", seen[16:24])[0] if seen[3] & 4 and seen[12:14] == b"WL" else None
        z = zlib.decompressobj(31)
        pending, out = seen, b""
        while b"\r\n\r\n" not in out and not z.eof:
            out += z.decompress(pending, 4096)
            pending = z.unconsumed_tail or (b"" if z.eof else self.f.read(self.CHUNK))
            if not pending and not z.eof:
                raise ValueError("a member is cut off")
        end = out.find(b"\r\n\r\n")
        state = {"out": out, "pending": pending}

        def inflate() -> bytes:
            while not z.eof:
                state["out"] += z.decompress(state["pending"])
                state["pending"] = b"" if z.eof else self.f.read(self.CHUNK * 8)
                if not state["pending"] and not z.eof:
                    raise ValueError("a member is cut off")
            return state["out"]

        def rest() -> bytes:
            # The file stands where header parsing left it, since rest() is asked for at once or never.
            whole = inflate()
            size = int(parse_headers(whole[:end])["content-length"])
            return whole[end + 4 : end + 4 + size]

        if known is None:
            whole = inflate()
            return out[:end], rest, self.f.tell() - len(z.unused_data)
        return out[:end], rest, at + known


def payload_of(heads: dict[str, str], block: bytes) -> bytes:
    """A record's block without the HTTP head, if it has one."""
    return block.partition(b"\r\n\r\n")[2] if heads.get("content-type", "").startswith("application/http") else block


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archives(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """The archives in a folder, or the one that ``root`` is."""
    top = fs.get_file_info(root)
    found = [top] if top.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return [i for i in found if i.is_file and ".warc" in i.base_name and not i.base_name.endswith(".tmp")]


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        ops = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringStartsWith: "starts", In: "in"}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in FIELDS and type(f) in ops:
                self.tests.append((name, ops[type(f)], f.value))
            elif name in FIELDS and type(f) is IsNotNull:
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        fs, root = file_system(self.path)
        infos = archives(fs, root)
        bins, size = [[]], 0
        for info in sorted(infos, key=lambda i: i.path):
            if bins[-1] and size + info.size > PARTITION_BYTES:
                bins.append([])
                size = 0
            bins[-1].append(info.path)
            size += info.size
        return [WarcPartition(b) for b in bins]

    def wanted(self, values: dict) -> bool:
        for name, op, want in self.tests:
            v = values[name]
            if v is None:
                return False
            if not (
                op == "some"
                or (op == "eq" and v == want)
                or (op == "in" and v in want)
                or (op == "starts" and v.startswith(want))
                or (op == "gt" and v > want)
                or (op == "ge" and v >= want)
                or (op == "lt" and v < want)
                or (op == "le" and v <= want)
            ):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        fs = file_system(self.path)[0]
        arrow = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString().replace("bigint", "long"), pa.string())) for f in SCHEMA])
        rows, held = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for head, rest in Members(f, path.endswith(".warc")):
                    heads = parse_headers(head)
                    values = {c: tidy(c, heads.get(h)) for c, h in FIELDS.items()}
                    holds, payload = values["record_type"] != "revisit", None
                    if holds and values["payload_bytes"] is None:
                        payload = payload_of(heads, rest())
                        values["payload_bytes"] = len(payload)
                    if not self.wanted(values):
                        continue
                    if holds and self.payload and payload is None:
                        payload = payload_of(heads, rest())
                    rows.append(values | {"payload": payload if self.payload else None})
                    held += len(payload or b"")
                    if len(rows) >= 512 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{self.run}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with fs.open_output_stream(name + ".tmp", compression=None) as f:
            for batch in iterator:
                for row in batch.to_pylist():
                    f.write(gzip_member(encode_record(row)))
                    n += 1
        return WarcCommit(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        before = [i.path for i in archives(fs, root)] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.name + ".tmp", m.name)
        for path in before:
            fs.delete_file(path)
        self._sweep(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            self._sweep(fs, root)

    def _sweep(self, fs: pafs.FileSystem, root: str) -> None:
        """What this write's tasks left without being committed."""
        for i in fs.get_file_info(pafs.FileSelector(root)):
            if i.base_name.startswith(f"part-{self.run}-") and i.base_name.endswith(".tmp"):
                fs.delete_file(i.path)


class WarcCommit(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class WarcDataSource(DataSource):
    """Options: ``path`` (folder URI), ``payload`` (``false``: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_digest(raw: F.Column) -> F.Column:
    """SHA-1 of a binary column in base 32: ten hexadecimal digits make eight of base 32."""
    h = F.sha1(raw)
    parts = [F.lpad(F.conv(F.substring(h, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8 of html), payload_bytes, payload_digest."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_digest(payload).alias("payload_digest"))


def as_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records to write: of equal payloads of at least ``least_bytes``, the smallest page_id is the response.

    Only digests that occur twice or more take part in the join: broadcast where their counted size allows;
    else only the commonest (a thousand at most) are, and the others are shuffled.
    """
    d = digested(pages)
    same = ["payload_digest", "payload_bytes"]
    repeats = written(
        d.filter(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeats"
    )
    kinds, rows = repeats.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if kinds * REPEAT_BYTES <= BROADCAST_BYTES:
        j = d.join(F.broadcast(repeats.drop("n")), same, "left")
    else:
        hot = F.col("n") > rows // 1000
        common = F.broadcast(repeats.filter(hot).drop("n"))
        j = d.join(common, same).unionByName(d.join(common, same, "left_anti").join(repeats.filter(~hot).drop("n"), same, "left"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:weftline:page:"), c.cast("string"))
    return j.select(
        F.coalesce(urn(F.col("page_id")), F.lit("urn:weftline:page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, mode: str = "append") -> None:
    register(pages.sparkSession)
    as_records(pages, least_bytes).write.format("warc").mode(mode).option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 19) AS BIGINT)")
    # Responses: length and digest of the payload as read; revisits: headers only.
    full = read_archives(spark, path).filter("record_type = 'response'")
    responses = full.select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_digest(F.col("payload")).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    again = read_archives(spark, path, payload=False).filter("record_type = 'revisit'")
    revisits = again.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), bits AS (
  SELECT page_id, octet_length(b) AS n, h, list_reduce(list_transform(range(1, 41), lambda i:
    format('{:04b}', CAST(strpos('0123456789abcdef', substr(h, i, 1)) - 1 AS INTEGER))), lambda x, y: x || y) AS s FROM p
), d AS (
  SELECT page_id, n, h, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(s, 5*i+1, 1) AS INTEGER) + 8 * CAST(substr(s, 5*i+2, 1) AS INTEGER) + 4 * CAST(substr(s, 5*i+3, 1) AS INTEGER)
    + 2 * CAST(substr(s, 5*i+4, 1) AS INTEGER) + CAST(substr(s, 5*i+5, 1) AS INTEGER), 1)), lambda x, y: x || y) AS digest,
    min(page_id) OVER (PARTITION BY h, n) AS first FROM bits
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

"""WARC archives as a Python data source, read and written.

Records are gzip members of their own, each with the skip length of the WARC standard in its extra field.  A reader
plans one partition for every few files.  In a file it inflates a member's first bytes only, parses the headers, tests
the pushed predicates on record type and headers, and seeks to the next member without inflating a payload that is
not wanted.  Files of other writers, plain or compressed, are read too, only without the shortcut.

Writers put files under new names; a manifest written when the job commits names those that count, so that files of
failed or repeated tasks are never read."""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .common import shared_path, table

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string,"
    " payload_bytes bigint, payload binary"
)
#: Header of every column but the payload.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "WARC-Payload-Length",
}
COLUMNS = [*HEADERS, "payload"]
#: A writer begins a new file after so many bytes; a reader takes files of about as many to a partition.
FILE_BYTES = 64 << 20
_PEEK = 1 << 14
_HEX_SHA1 = re.compile("[0-9a-f]{40}")
#: The profile of a revisit whose payload is the same.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK = b"SL"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_CONTROL = re.compile(r"[\x00-\x1f\x7f%]")
_ESCAPED = re.compile("%([0-9A-F]{2})")


def _plain(value: str) -> bool:
    """Whether a header can hold the text as it is written."""
    return value == value.strip() and not any(ord(c) < 32 or ord(c) == 127 for c in value)


def _escape(value: str) -> str:
    """Percent signs, control characters and blanks at the ends as percent and two digits."""
    inner = value.strip(" ")
    ends = len(value) - len(value.lstrip(" ")), len(value) - len(value.rstrip(" ")) if inner else 0
    return "%20" * ends[0] + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", inner) + "%20" * ends[1]


def _unescape(value: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)


def _number(value: str | None) -> int | None:
    """A count in a header; None for whatever else stands there."""
    return int(value) if value and value.isascii() and value.isdigit() else None


def encode(record: dict) -> bytes:
    """A record as one gzip member: 16 bytes of gzip header and extra field, deflated data, checksum, length.

    Headers are written as they are; a record with a value that no header can hold says so, and all its values are escaped."""
    payload = record.get("payload")
    body = b"" if payload is None else bytes(payload)
    values = {c: str(record[c]) for c in HEADERS if record.get(c) is not None}
    if _HEX_SHA1.fullmatch(values.get("payload_digest", "")):
        values["payload_digest"] = f"sha1:{values['payload_digest']}"
    plain = all(map(_plain, values.values()))
    lines = ["WARC/1.1", f"WARC-Date: {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"]
    lines += [f"{HEADERS[c]}: {v if plain else _escape(v)}" for c, v in values.items()]
    lines += [] if plain else ["X-Encoded: 1"]
    lines += [f"WARC-Profile: {REVISIT}"] if values.get("record_type") == "revisit" else []
    lines += [f"X-Payload: {'none' if payload is None else 'here'}", f"Content-Length: {len(body)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    extra = _MARK + struct.pack("<HII", 8, (len(packed) + 32) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Headers by name in lower case, as they are written; those of a record that says it is escaped are decoded.  A line
    that begins with a blank goes on with the one before; what is no header is left out.  Nothing here is an error."""
    found: list[list[str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and found:
            found[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append([name.strip().lower(), value.strip()])
    headers = {name: value for name, value in found if name}
    if headers.get("x-encoded") == "1":
        headers = {name: _unescape(value) for name, value in headers.items()}
    return headers


class _Member:
    """A gzip member or plain record at the file's position, inflated no further than asked."""

    def __init__(self, file, size: int):
        self.file, self.start, self.size = file, file.tell(), size
        first = file.read(22)
        self.plain, self.length = first[:2] != b"\x1f\x8b", None
        if not self.plain and first[3] & 4 and first[12:14] == _MARK:
            self.length = struct.unpack("<I", first[16:20])[0]
        self.inflate = None if self.plain else zlib.decompressobj(31)
        self.data, self.pending = bytearray(), first
        if self.plain:
            self.data += first

    def more(self) -> bool:
        """Inflate some more; False at the member's end."""
        if self.plain:
            chunk = self.file.read(_PEEK)
            self.data += chunk
            return bool(chunk)
        if self.inflate.eof:
            return False
        if not self.pending:
            self.pending = self.file.read(_PEEK)
            if not self.pending:
                return False
        self.data += self.inflate.decompress(self.pending, 1 << 20)
        self.pending = self.inflate.unconsumed_tail
        return True

    def headers(self) -> tuple[dict[str, str], int]:
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return {}, len(self.data)
        return parse_headers(bytes(self.data[:end])), end + 4

    def take(self, start: int, length: int) -> bytes:
        while len(self.data) < start + length and self.more():
            pass
        return bytes(self.data[start : start + length])

    def leave(self, body: int, length: int) -> None:
        """Move the file to the next member, by seeking if the length is known."""
        if self.plain:
            self.file.seek(min(self.size, self.start + body + length + 4))
        elif self.length is not None:
            self.file.seek(self.start + self.length)
        else:
            while not self.inflate.eof and self.more():
                self.data.clear()
            self.file.seek(self.file.tell() - len(self.inflate.unused_data))


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wants_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality and membership on header columns are tested before a payload is touched; the rest stays."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_bytes" and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif column in HEADERS and column != "payload_bytes" and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        """Files in groups of about FILE_BYTES: those of the manifests, or all archives of a folder without any."""
        from pyarrow import fs

        store, root = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=False))
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        files = {f.path: f.size for f in found if f.base_name.endswith((".warc", ".warc.gz"))}
        if manifests:
            named = set()
            for m in manifests:
                with store.open_input_stream(m) as stream:
                    named.update(json.loads(stream.read()))
            files = {p: n for p, n in files.items() if posixpath.basename(p) in named}
        groups, room = [], 0
        for path, size in sorted(files.items()):
            if size > room:
                groups.append([])
                room = FILE_BYTES
            groups[-1].append((path, size))
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _filesystem(self.path)
        for path, size in partition.paths:
            with store.open_input_file(path) as file:
                while file.tell() < size:
                    member = _Member(file, size)
                    headers, body = member.headers()
                    if not headers:
                        member.leave(body, 0)
                        continue
                    length = _number(headers.get("content-length"))
                    if length is None:  # to the member's end; the end of a plain file's record is not known
                        length = len(member.take(body, 1 << 62)) if not member.plain else 0
                    row = {c: headers.get(name.lower()) for c, name in HEADERS.items()}
                    if _HEX_SHA1.fullmatch((row["payload_digest"] or "").removeprefix("sha1:")):
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if all(row[c] in wanted for c, wanted in self.tests):
                        here = self.wants_payload and headers.get("x-payload") != "none"
                        payload = member.take(body, length) if here else None
                        count = _number(row["payload_bytes"])
                        row["payload_bytes"] = length if count is None else count
                        yield (*[row[c] for c in HEADERS], payload)
                    member.leave(body, length)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        files, out, room = [], None, 0
        try:
            for row in iterator:
                if room <= 0:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, room = store.open_output_stream(posixpath.join(root, files[-1]), compression=None), FILE_BYTES
                data = encode(row.asDict())
                out.write(data)
                room -= len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        names = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(posixpath.join(root, f"_manifest-{uuid.uuid4().hex}.json")) as out:
            out.write(json.dumps(names).encode())


class Warc(DataSource):
    """``spark.read.format("warc").load(folder)``; option payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """A record for every page, with revisits for repeated payloads of at least ``least`` bytes.

    Digests, not payloads, are grouped, and only those that occur more than once are joined back."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").alias("id"), F.col("url").alias("target_uri"), payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    owners = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.max("id").alias("owner"), F.count("*").alias("n"))
        .filter("n > 1 AND owner IS NOT NULL")
        .select("digest", "owner")
    )
    joined = rows.join(owners, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    urn = lambda c: F.format_string("<urn:page:%s>", c.cast("string"))
    return joined.select(
        F.when(F.col("id").isNotNull(), urn(F.col("id"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, urn(F.col("owner"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op7(spark, folder):
    """Every page, written to archives and read back.

    Null and empty html are empty payloads.  Size and digest of a response are those of the payload that was read;
    a revisit carries them in its headers.  Rows that share the largest page_id are all responses; a null page_id
    never owns a payload.  Null urls have no header."""
    register(spark)
    path = shared_path(spark, "warc")
    records(table(spark, folder, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    here = F.col("record_type") == "response"
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(here, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(here, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


OP7_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest AS d, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1 AND max(page_id) IS NOT NULL)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON d = payload_digest"""

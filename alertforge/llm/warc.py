"""WARC archives as a PySpark Python data source, written and read.

Reading plans one partition per run of archive files of about
``split_bytes``; ``record_type``, ``target_uri``, ``record_id`` and ``refers_to``
predicates are pushed to the reader, which parses a record's headers first and
decodes the payload only of records that pass (and only with option
``payload=true``). Each record is a gzip member of its own, and the member's
compressed length lies in its ``extra`` field, so a payload that is not wanted
is skipped without inflating it.

Writing streams one archive per task into ``_tmp`` names and moves them into
place when the job commits; files of failed attempts are removed or left under
names that readers ignore.

Deduplicated writing (``archive_pages``): of pages with equal payloads the
smallest page_id is the response, the others are ``revisit`` records
(identical-payload-digest) that keep the HTTP head, with the payload's length,
and no payload.

Defined results: null html is an empty payload; equal payloads means equal
SHA-1 and length; rows that repeat the smallest page_id with its payload are
responses too; null page_ids are never referred to unless all of a payload's
pages have one, and then each is a response. A null url writes no target URI.
An empty table writes no archive, and an empty folder reads as no rows. Extra
columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)

from alertforge.llm.storage import list_files, open_fs

SUFFIX = ".warc.gz"
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, http_head string, payload binary")
WRITE_SCHEMA = "page_id long, url string, payload binary, refers_to long"
PUSHED = ("record_type", "target_uri", "record_id", "refers_to")
DATE = "2024-01-01T00:00:00Z"
SPLIT_BYTES = 32 << 20
_GZIP_HEAD = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff"
# extra field "WL": compressed length of the headers, then of the block, 64 bits each


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    """The page_id of a record id, null if it has none."""
    tail = (urn or "").rstrip(">").rsplit(":", 1)[-1]
    return int(tail) if tail.lstrip("-").isdigit() else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member with a length field."""
    revisit = refers_to is not None
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}"]
    plain_head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    plain = plain_head + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, -15)
    first = squeeze.compress(plain_head) + squeeze.flush(zlib.Z_FULL_FLUSH)
    rest = squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()
    extra = struct.pack("<2sHQQ", b"WL", 16, len(first), len(rest))
    return (_GZIP_HEAD + struct.pack("<H", len(extra)) + extra + first + rest
            + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


def _headers(text: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with a blank continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _row(headers: dict[str, str]) -> dict:
    digest = headers.get("warc-payload-digest")
    return {"record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"),
            "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"),
            "payload_digest": digest.split(":", 1)[-1] if digest else None}


def read_archive(uri: str, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of one archive for which ``wanted(row of headers)`` holds.

    A member with a length field is read headers first: the compressed block
    of a record that is not wanted is jumped over. Other members (foreign
    archives, or one member for many records) are inflated as they come.
    """
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        size, at = f.size(), 0
        while at < size:
            fixed = f.read_at(12, at)
            if fixed[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"not a gzip member at byte {at} of {uri}")
            lengths, start = None, at + 10
            if fixed[3] == 4:
                n = struct.unpack_from("<H", fixed, 10)[0]
                extra = f.read_at(n, at + 12)
                if n == 20 and extra[:2] == b"WL":
                    lengths = struct.unpack_from("<QQ", extra, 4)
                    start = at + 12 + n
            if lengths is None:
                stop = yield from _foreign(f, at, wanted, with_payload, uri)
                at = stop
                continue
            first, rest = lengths
            inflate = zlib.decompressobj(-15)
            row = _row(headers := _headers(inflate.decompress(f.read_at(first, start))))
            at = start + first + rest + 8
            if wanted(row):
                # without the payload the HTTP head is enough; it is in the first bytes
                take = rest if with_payload else min(rest, 1024)
                block = inflate.decompress(f.read_at(take, start + first), 0 if with_payload else 1024)
                yield _finish(row, headers, block, with_payload, uri)


def _finish(row: dict, headers: dict[str, str], block: bytes, with_payload: bool, uri: str) -> dict:
    cut = block.find(b"\r\n\r\n")
    head = block[:cut + 4] if cut >= 0 else b""
    http = _headers(head)
    row["http_head"] = head.decode("utf-8", "replace") if cut >= 0 else None
    row["payload_bytes"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    row["payload"] = None
    if with_payload and row["record_type"] != "revisit":
        row["payload"] = block[len(head):int(headers.get("content-length", len(block)))]
        row["payload_bytes"] = len(row["payload"])
        if row["payload_digest"] and row["payload_digest"] != sha1_base32(row["payload"]):
            raise ValueError(f"payload digest of {row['record_id']} does not match in {uri}")
    return row


def _foreign(f, at: int, wanted, with_payload: bool, uri: str):
    """Records of a gzip member without a length field; returns the member's end."""
    inflate, data, pos = zlib.decompressobj(31), b"", at
    while not inflate.eof:
        chunk = f.read_at(1 << 20, pos)
        if not chunk:
            raise ValueError(f"truncated member at byte {at} of {uri}")
        data += inflate.decompress(chunk)
        pos += len(chunk)
        while (cut := data.find(b"\r\n\r\n")) >= 0:
            headers = _headers(data[:cut + 2])
            n = int(headers.get("content-length", 0))
            if len(data) < cut + 4 + n:
                break
            row = _row(headers)
            if wanted(row):
                yield _finish(row, headers, data[cut + 4:cut + 4 + n], with_payload, uri)
            data = data[cut + 4 + n:].lstrip(b"\r\n")
    return pos - len(inflate.unused_data)


@dataclass
class ArchiveFiles(InputPartition):
    """Some archives, read by one task."""

    uris: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final path of a task's archive (empty if it had no rows)."""

    moves: tuple[tuple[str, str], ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], payload: bool) -> None:
        self.path, self.payload = options["path"], payload
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN over header fields; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        store = open_fs(self.path)[0]
        runs, run, size = [], [], 0
        for uri in list_files(self.path, SUFFIX):
            n = store.get_file_info(open_fs(uri)[1]).size
            if run and size + n > self.split_bytes:
                runs.append(ArchiveFiles(tuple(run)))
                run, size = [], 0
            run.append(uri)
            size += n
        return runs + [ArchiveFiles(tuple(run))]

    def read(self, partition: ArchiveFiles):
        import pyarrow as pa
        tests = self.tests

        def wanted(row: dict) -> bool:
            return all(row[k] in values for k, values in tests)

        names = [c.strip().split()[0] for c in SCHEMA.split(",")]
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        rows, size = [], 0
        for uri in partition.uris:
            for row in read_archive(uri, wanted, self.payload):
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        out = None
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    store, folder = open_fs(self.path)
                    store.create_dir(folder, recursive=True)
                    name = uuid.uuid4().hex
                    tmp, final = f"{folder}/_tmp-{name}", f"{folder}/pages-{name}{SUFFIX}"
                    out = store.open_output_stream(tmp, compression=None)
                out.write(record_bytes(r["page_id"], r["url"], r["payload"] or b"", r["refers_to"]))
        if out is None:
            return Written(())
        out.close()
        return Written(((tmp, final),))

    def commit(self, messages) -> None:
        store = open_fs(self.path)[0]
        for m in messages:
            for tmp, final in (m.moves if m else ()):
                store.move(tmp, final)

    def abort(self, messages) -> None:
        store = open_fs(self.path)[0]
        for m in messages:
            for tmp, _ in (m.moves if m else ()):
                store.delete_file(tmp)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), str(self.options.get("payload", "false")).lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as deduplicated archives below ``path``."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"_sha1": F.sha1("payload"), "_n": F.octet_length("payload")})
    # only payloads that occur more than once need a reference: a narrow aggregate
    firsts = (rows.select("_sha1", "_n", "page_id").groupBy("_sha1", "_n")
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
              .drop("_rows"))
    rows = rows.join(firsts, ["_sha1", "_n"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    (rows.select("page_id", "url", "payload", refers.alias("refers_to"))
     .write.format("warc").mode("append").save(path))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records below ``path``; payloads only where asked for."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)

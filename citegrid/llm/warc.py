"""Legacy archive converter: ARC files of version 1 or 2 become WARC 1.1 files.

An ARC header line has, by version, 5 or 10 fields before a block of declared length. The converter finds the fields
that have a fixed form (IP address, date of digits, length), so that spaces in a URL or a MIME type do no harm, takes
the block, and synthesises the WARC fields: record id from URL, date and key, ISO timestamp from the 14 (or 12, 10, 8)
digits, type, and SHA-1 digests in base32 of block and payload.

Archives are real files in a folder that tasks reach through Arrow's file systems: one gzip member a record, one gzip
stream, or not compressed. A task writes under a name of its own and returns a row for what it wrote; only files with
such a row are read again, so that retried or doubled tasks leave nothing but unread files. Files are converted and
read one a row of work, dealt over tasks by their name.

Odd archives: header bytes that are no UTF-8 are read as Latin-1; a date that is no date (month 13, too few digits) is
that of the file's own record, and UNDATED where that has none; parameters of a MIME type are kept, spaces before them
are not; a header line with missing or wrong fields, an unknown version and an archive that ends inside a record raise
ValueError with the archive's byte count, except with `salvage`, which ends the file at its last whole record.

Edge cases: a null html is an empty payload; a null URL is `unknown:`; URLs keep their characters except white space and
controls, which are percent-encoded; a very long payload is held whole, once at a time, by the task that writes or reads
it; of records with equal payload, that with the largest id is the response and the others revisit it (a repeated
largest id: each is a response; without any id: all are responses); an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, written

#: Payload bytes after which a writer starts a new file; gzip level; date of the archives written here.
FILE_BYTES, MAX_TASKS, LEVEL, DATE = 1 << 30, 4096, 1, "19970101000000"
#: Timestamp of a record without a usable date in a file without one.
UNDATED = "1970-01-01T00:00:00Z"
ARC_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, digest string, payload_bytes long, file string, ord long"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a file, piece by piece; a file of gzip members is inflated."""
    data = stream.read(1 << 20)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(1 << 20)
        return
    z = zlib.decompressobj(31)
    while data:
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
        data = stream.read(1 << 20)


class Truncated(ValueError, EOFError):
    """An archive that ends inside a record."""


class _Reader:
    """Lines and blocks of known length from a sequence of pieces."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at = chunks, b"", 0

    def _more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.data, self.at = self.data[self.at :] + chunk, 0
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end; None at the end."""
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more():
                rest, self.data, self.at = self.data[self.at :], b"", 0
                return rest or None
        out, self.at = self.data[self.at : end], end + 1
        return out

    def block(self, n: int) -> bytes:
        parts, have = [], len(self.data) - self.at
        if have >= n:
            out, self.at = self.data[self.at : self.at + n], self.at + n
            return out
        parts, self.data, self.at = [self.data[self.at :]], b"", 0
        for chunk in self.chunks:
            need = n - have
            parts.append(chunk[:need])
            have += len(parts[-1])
            if len(chunk) > need or have == n:
                self.data = chunk[need:]
                break
        if have < n:
            raise Truncated(f"the archive ends {n - have} bytes early")
        return b"".join(parts)


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def arc_start(name: str, version: int) -> bytes:
    body = b"%d 0 citegrid\n%s\n" % (version, ARC_FIELDS[version])
    return _arc_line(f"filedesc://{name}", "0.0.0.0", "text/plain", version, name, 0, "-", len(body)) + body + b"\n"


def _arc_line(url: str, ip: str, kind: str, version: int, name: str, offset: int, checksum: str, length: int) -> bytes:
    middle = f" 200 {checksum} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {DATE} {kind}{middle} {length}\n".encode()


#: URL, IP address, date and MIME type, which stand in both versions; a version 2 line goes on with result code,
#: checksum, location, offset and file name. The length comes last.
_FRONT = r"(?P<url>\S.*?) +(?P<ip>[0-9A-Fa-f.:]*[.:][0-9A-Fa-f.:]*|-) +(?P<date>\d+|-) +"
_LINE = {
    1: re.compile(_FRONT + r"(?P<kind>.*?) *(?P<length>\d+)\r?"),
    2: re.compile(_FRONT + r"(?P<kind>.*?) +(?P<code>\d+|-) +(?P<checksum>\S+) +(?P<location>\S+) +(?P<offset>\d+|-) +(?P<name>\S+) +(?P<length>\d+)\r?"),
}


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse_line(line: bytes, version: int) -> dict:
    """Fields of an ARC header line."""
    found = _LINE[version].fullmatch(_text(line))
    if found is None:
        raise ValueError(f"not an ARC header line of version {version}: {line[:200]!r}")
    out = found.groupdict()
    return {"url": clean_url(out["url"]), "ip": out["ip"], "date": out["date"], "content_type": re.sub(r" *; *", "; ", out["kind"]).strip() or "no-type", "length": int(out["length"])}


def read_arc(chunks: Iterator[bytes], salvage: bool = False) -> Iterator[dict]:
    """url, ip, date (ISO), content_type, block of each record after the file's own, whatever the version.

    With `salvage`, an archive that ends inside a record gives the records before it.
    """
    reader, version, default = _Reader(chunks), None, UNDATED
    try:
        while (line := reader.line()) is not None:
            if not line.strip():
                continue
            if version is None:
                if not line.startswith(b"filedesc:"):
                    raise ValueError("an ARC file starts with a filedesc record")
                default = iso_date(next(iter(re.findall(r" (\d{8,14}) ", _text(line))), ""), UNDATED)
                body = reader.block(int(line.rsplit(b" ", 1)[1]))
                version = int(body.split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version} is unknown")
                continue
            fields = parse_line(line, version)
            yield {"url": fields["url"], "ip": fields["ip"], "date": iso_date(fields["date"], default), "content_type": fields["content_type"], "block": reader.block(fields["length"])}
    except (EOFError, zlib.error):
        if not salvage:
            raise


def iso_date(digits: str, default: str = UNDATED) -> str:
    """Timestamp of 14, 12, 10 or 8 digits; the default where they are no date."""
    try:
        return datetime.strptime((digits + "000000")[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if len(digits) in (8, 10, 12, 14) else default
    except ValueError:
        return default


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, body = block.partition(b"\r\n\r\n")
    return head + mark, body


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def converted(arc: dict, key: object, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record: a revisit if it refers to another key's response, else a response."""
    head, payload = split_http(arc["block"])
    digest = digest_of(payload)
    revisit = refers_to is not None
    block = head if revisit else arc["block"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response" if head else "resource"), ("WARC-Record-ID", record_id(f"{key}:{digest}")), ("WARC-Date", arc["date"]),
        ("WARC-Target-URI", arc["url"]), ("WARC-IP-Address", arc["ip"]), ("Content-Type", "application/http; msgtype=response" if head else arc["content_type"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("X-Payload-Length", len(payload)), ("X-Key", "" if key is None else key),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(f"{refers_to}:{digest}")), ("X-Refers-To-Key", refers_to)]
    return warc_record(fields, block)


def read_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    reader = _Reader(chunks)
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while line := (reader.line() or b"").rstrip(b"\r"):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, reader.block(int(fields["content-length"]))


class _Files:
    """Writes records to numbered files of a folder; a file is closed once it has FILE_BYTES."""

    def __init__(self, folder: str, ending: str, start):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.tag, self.ending, self.start = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", ending, start
        self.n, self.out, self.size, self.ord = 0, None, 0, 0

    def write(self, record: bytes) -> tuple[str, int]:
        """File and number in it."""
        if self.out is None:
            self.name = f"{self.tag}-{self.n:04d}.{self.ending}"
            self.out, self.size, self.ord, self.n = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, 0, self.n + 1
            self.out.write(_member(self.start(self.name)))
        self.out.write(_member(record))
        self.size += len(record)
        self.ord += 1
        at = self.name, self.ord - 1
        if self.size >= FILE_BYTES:
            self.close()
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _chunks(folder: str, name: str) -> Iterator[bytes]:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
        yield from inflated(stream)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", version: int | None = None) -> DataFrame:
    """ARC files of all pages, and their index: page_id, url, digest, payload_bytes, file, ord.

    Without a version, tasks of odd number write version 1 and the others version 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = version or 2 - TaskContext.get().partitionId() % 2
        files = _Files(folder, "arc.gz", lambda name: arc_start(name, own))
        for batch in batches:
            rows = []
            for key, url, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = (body or "").encode()
                digest, url = digest_of(payload), clean_url(url)
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                name = f"{files.tag}-{files.n:04d}"
                rows.append((key, url, digest, len(payload), *files.write(_arc_line(url, "0.0.0.0", "text/html", own, name, files.size, digest, len(block)) + block + b"\n")))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        files.close()

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("html"))
    return written(slim.mapInArrow(run, _INDEX), "arc-index")


def convert(index: DataFrame, arc_folder: str, warc_folder: str, min_bytes: int = 0) -> DataFrame:
    """WARC files of the ARC files in the index: file, records. Payloads under min_bytes are never revisits."""
    own = F.when(F.col("payload_bytes") >= min_bytes, F.col("digest"))
    groups = index.groupBy(own.alias("same")).agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1 AND same IS NOT NULL").drop("n"), "payloads")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    plan = index.withColumn("same", own).join(groups, "same", "left").select("file", "ord", "page_id", refers_to.alias("refers_to"))

    def run(table: pa.Table) -> pa.Table:
        rows = {o: (k, r) for o, k, r in zip(*[table.column(c).to_pylist() for c in ("ord", "page_id", "refers_to")], strict=True)}
        files = _Files(warc_folder, "warc.gz", lambda name: warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", iso_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        counts: dict[str, int] = {}
        for i, arc in enumerate(read_arc(_chunks(arc_folder, table.column("file")[0].as_py()))):
            name, _ = files.write(converted(arc, *rows[i]))
            counts[name] = counts.get(name, 0) + 1
        files.close()
        return pa.table({"file": pa.array(list(counts), pa.string()), "records": pa.array(list(counts.values()), pa.int64())})

    # A set number of partitions: by size Spark would put this small plan into one task. Beyond it a task converts several files.
    count = max(1, min(MAX_TASKS, index.agg(F.count_distinct("file")).first()[0]))
    return written(plan.repartition(count, "file").groupBy("file").applyInArrow(run, "file string, records long"), "warc-files")


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of every stored payload is computed again and must be the one declared; the bytes of a response are
    those read, of a revisit (which stores none) those declared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for f, block in read_warc(_chunks(folder, name)):
                    if f["warc-type"] == "warcinfo":
                        continue
                    payload = split_http(block)[1]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and digest_of(payload) != digest:
                        raise ValueError(f"{name}: a payload does not have its digest")
                    key, other = f["x-key"], f.get("x-refers-to-key")
                    size = int(f["x-payload-length"]) if revisit else len(payload)
                    rows.append((int(key) if key else None, size, digest, "revisit" if revisit else "response", int(other) if other else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])

    spread = files.select("file").repartition(2 * partitions(files.sparkSession))
    return spread.mapInArrow(run, _RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, these to WARC files, and the records of those read back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    return read_records(convert(write_arc(pages, arc), arc, warc), warc)

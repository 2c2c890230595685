"""WARC archives: a writer, and a reader that salvages damaged archives.

The writer packs one record per page into archives of bounded size. Each archive is a row of
bytes that Spark's text sink writes as a file of its own, so that it goes through Spark's
commit protocol to any store that Spark writes to. Records are gzip members, or plain text.
The sink ends a file with one line separator, a zero byte: that is the last byte of a
member, the top byte of its length; a member of 16 MB or more is followed by an empty one. Of
pages with equal payloads the one with the smallest id is written as ``response``, the others as
``revisit`` of it, with HTTP headers and no payload.

The reader takes a record only when every check holds: the member's checksum and length, the
version line, the header lines, the block's length, the ending, and the block's and payload's digests. After
a failed check it searches on, byte by byte of the place that failed, for the next gzip member or
version line at which a whole valid record begins, goes on from there, and logs the bytes
between as a quarantined gap with the reason. (Headers of plain records have no checksum: damage
that leaves them well formed isn't seen; in a member every byte is checked.) Every byte of an archive is in one record, one
gap, an empty member, or padding (zero bytes and line ends) between records.

A null payload is an empty one, and empty payloads are equal to each other. Rows that repeat the
smallest id of their payload are responses too, as a record doesn't refer to its own id. A null
id revisits the smallest id of its payload, or is a response where there is none. A null
URL is left out. Ids are whole numbers. Only the columns named are read. Memory follows the archive size and the largest page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch
from trendscope.llm.text import trimmed

ARCHIVE_BYTES = 32 << 20   # an archive is closed when it reaches so many bytes
LEVEL = 4                  # of the compression
DATE = "2000-01-01T00:00:00Z"  # the tables hold no time of capture

# fixed values: the version written, the profile of revisits, magic bytes, header line form
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
HEADER_LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*")
ENDING = b"\r\n\r\n"
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()

COLUMNS = (("path", "string", pa.string()), ("start", "long", pa.int64()), ("end", "long", pa.int64()),
           ("gap", "string", pa.string()), ("type", "string", pa.string()), ("record_id", "string", pa.string()),
           ("target_uri", "string", pa.string()), ("headers", "map<string, string>", pa.map_(pa.string(), pa.string())),
           ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("payload", "binary", pa.binary()))


# Writing ---------------------------------------------------------------------------------------

def digest(data) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), b"\r\n", block, ENDING])


def page_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """The response record of a page, or its revisit record without the payload."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, name)),
               ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{name}"),
               ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, name)),
                    ("Refers-To-Page-ID", str(refers_to))]
    return record(headers, http if revisit else http + payload)


def info_record(date: str = DATE) -> bytes:
    block = b"software: trendscope\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info')}>"),
                   ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def packed(data: bytes, compress: bool, level: int = LEVEL) -> bytes:
    """A record as it stands in an archive; a member's last byte is zero."""
    if not compress:
        return data
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = squeeze.compress(data) + squeeze.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def _write(batches: Iterator[pa.RecordBatch], compress: bool, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    first = packed(info_record(), compress)
    held, size = [], 0

    def archive() -> pa.RecordBatch:
        data = b"".join([first, *held])
        if compress:
            data = data[:-1]  # the sink's separator
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])

    for batch in batches:
        for at in range(batch.num_rows):
            page_id, url, html, refers_to, revisit = (c[at].as_py() for c in batch.columns)
            held.append(packed(page_record(page_id, url, (html or "").encode(), refers_to, revisit), compress))
            size += len(held[-1])
            if size >= archive_bytes:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


def with_roles(pages: DataFrame, scratch: Scratch, *, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` as id, url, payload and what it revisits. Only payloads that stand in several rows are
    joined back, from a written table: where that is small, Spark sees its size and broadcasts
    it, else the join on the payload's hash is one that AQE splits where a payload is hot."""
    rows = pages.withColumn("_key", F.unhex(F.sha2(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), 256)))
    groups = rows.groupBy("_key").agg(F.min(id_col).alias("_least"), F.count("*").alias("n"))
    shared = scratch.table(groups.filter("n > 1 and _least is not null").select("_key", "_least"))
    revisit = F.coalesce(~F.col(id_col).eqNullSafe(F.col("_least")) & F.col("_least").isNotNull(), F.lit(False))
    return rows.join(shared, "_key", "left").withColumn("_revisit", revisit)


def write_archives(pages: DataFrame, path: str, *, scratch: Scratch, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row, in archives of about ``archive_bytes`` under the folder ``path``. Plain
    archives (not ``compress``) are whole WARC files but for one line feed behind the last record."""
    cols = [pages[c].alias(n) for c, n in ((id_col, "page_id"), (url_col, "url"), (payload_col, "html"))]
    rows = with_roles(pages.select(*cols), scratch).select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "_least", "_revisit")
    archives = rows.mapInArrow(lambda b: trimmed(_write(b, compress, archive_bytes)), "archive binary")
    (archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", "\0" if compress else "\n").text(path))


# Reading ---------------------------------------------------------------------------------------

class Damaged(ValueError):
    """A check of a record failed."""


def _head(data, at: int) -> tuple[dict[str, str], int]:
    """Headers of the record at ``at`` and where its block begins."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(ENDING, at)
    if end < 0:
        raise Damaged("headers without an end")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        m = HEADER_LINE.fullmatch(line)
        if not m:
            raise Damaged("bad header line")
        name = m[1].decode().lower()
        if name in headers and name != "warc-concurrent-to":
            raise Damaged("repeated header")
        try:
            headers[name] = m[2].decode()
        except UnicodeDecodeError:
            raise Damaged("bad header line") from None
    return headers, end + len(ENDING)


def _checked(data, at: int) -> tuple[dict, int]:
    """The record at ``at`` of uncompressed data and its end, every check held."""
    headers, begin = _head(data, at)
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 19):
        raise Damaged("no content length")
    end = begin + int(size)
    if data[end:end + len(ENDING)] != ENDING:
        raise Damaged("block length or ending is wrong")
    if not ("warc-type" in headers and "warc-record-id" in headers):
        raise Damaged("no record type or id")
    block = memoryview(data)[begin:end]
    _same_digest(headers.get("warc-block-digest"), block, "block")
    payload, length = block, len(block)
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        split = data.find(ENDING, begin, end)
        if split < 0:
            raise Damaged("HTTP headers without an end")
        payload = block[split + len(ENDING) - begin:]
        length = len(payload)
        if headers["warc-type"] == "revisit":  # the payload's length stands in the HTTP headers kept
            told = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", data[begin:split])
            length = int(told[1]) if told else 0
    if headers["warc-type"] != "revisit":
        _same_digest(headers.get("warc-payload-digest"), payload, "payload")
    return {"headers": headers, "payload": payload, "payload_bytes": length}, end + len(ENDING)


def _same_digest(told: str | None, data, what: str) -> None:
    """Digests of another kind than SHA-1 in base32 are not looked at."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() == "sha1" and value.upper() != digest(data):
        raise Damaged(f"{what} digest differs")


def _member(data, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and its end; its checksum and length are checked."""
    inflate = zlib.decompressobj(31)
    out, place = [], at
    try:
        while not inflate.eof:
            if place >= len(data):
                raise Damaged("member without an end")
            chunk = data[place:place + (1 << 16)]
            out.append(inflate.decompress(chunk))
            place += len(chunk)
    except zlib.error:
        raise Damaged("bad member") from None
    return b"".join(out), place - len(inflate.unused_data)


def _at(data, at: int) -> tuple[dict | None, int]:
    """The valid record at ``at`` (None: an empty member) and where it ends."""
    if data[at:at + 3] != MEMBER:
        return _checked(data, at)
    inner, end = _member(data, at)
    if not inner:
        return None, end
    found, inner_end = _checked(inner, 0)
    if inner_end != len(inner):
        raise Damaged("more than one record in a member")
    return found, end


_PADDING = re.compile(rb"[\0\r\n]*")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, reason): the valid records of an archive in order, and its gaps, which
    have no record but the reason of the first failed check. Record and gap never overlap."""
    at = 0
    while True:
        at = _PADDING.match(data, at).end()
        if at >= len(data):
            return
        try:
            found, end = _at(data, at)
            if found:
                yield at, end, found, None
            at = end
            continue
        except Damaged as failed:
            reason = str(failed)
        following = len(data)
        for m in _CANDIDATE.finditer(data, at + 1):
            try:
                _at(data, m.start())
            except Damaged:
                continue
            following = m.start()
            break
        yield at, following, None, reason
        at = following


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names, _, kinds = zip(*COLUMNS)
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for start, end, found, reason in salvage(content.as_py()):
                if found is None:
                    rows.append((path.as_py(), start, end, reason, *[None] * 7))
                else:
                    h = found["headers"]
                    told = h.get("warc-payload-digest", "")
                    rows.append((path.as_py(), start, end, None, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"),
                                 list(h.items()), found["payload_bytes"],
                                 told.partition(":")[2] if told else digest(found["payload"]),
                                 bytes(found["payload"]) if payloads else None))
                    size += len(found["payload"]) if payloads else 0
                if len(rows) >= 1024 or size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], list(names))
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], list(names))


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``: the archive, first byte and end; ``gap``, the
    reason of a quarantined gap, null for records; type, id, URL, headers (names in lower case),
    length and digest of the whole payload, and the payload itself (null if not ``payloads``)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda b: trimmed(_read(b, payloads)),
                            ", ".join(f"{name} {kind}" for name, kind, _ in COLUMNS))


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: archive, bytes and reason."""
    return read.filter("gap is not null").select("path", "start", "end", (F.col("end") - F.col("start")).alias("n_bytes"), "gap")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Every page written to an archive and read back: id, length and digest of its payload,
    its record's type, and the page that a revisit refers to."""
    scratch = Scratch(pages.sparkSession)
    path = f"{scratch.root}/archives"
    write_archives(pages, path, scratch=scratch)
    read = read_archives(pages.sparkSession, path, payloads=False).filter("type in ('response', 'revisit')")
    kind = pages.schema["page_id"].dataType
    return read.select(F.col("headers")["page-id"].cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("type").alias("record_type"), F.col("headers")["refers-to-page-id"].cast(kind).alias("refers_to"))

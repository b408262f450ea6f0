"""WARC archives with revisit records, and a reader that salvages damaged ones.

Archives are written by Spark's text writer: a record ends with two line ends,
which are the line separator, so every file is a valid uncompressed WARC on any
file system that Spark reaches. They are read as binary files. The reader takes
each record by its lengths and checks; when a check fails, it looks for the
next gzip member or version line that starts a valid record, goes on from there
and reports the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bitmap, mark, only_marked, spread_join, stage, stage_path, table
from docloom.stages import forget_at_exit
from docloom.ship import ship

#: Payload bytes of an archive file, about.
FILE_BYTES = 16 << 20
END = b"\r\n\r\n"
#: The last header of our own records; it covers the ones before.
HEAD_DIGEST = b"\r\nX-Header-Digest: sha1:"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: Bytes of a gzip member that are unpacked at once.
WINDOW = 1 << 16


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record without payload, up to but without its final two line ends."""
    body = b"" if refers_to is not None else payload
    clean = re.sub(r"[\x00-\x20]+", " ", url or "").strip()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean}"] if clean else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(body)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    head = "\r\n".join(lines).encode()
    return head + HEAD_DIGEST + payload_digest(head).encode() + END + body


def gzip_member(data: bytes) -> bytes:
    """One record as a gzip member of its own, for record-wise compressed archives."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data + END) + c.flush()


# --- Reading ---------------------------------------------------------------


def digest_holds(value: str, data: bytes) -> bool:
    """Whether an algorithm:digest header fits the data. Digests may be base32 or hexadecimal, in either case; of algorithms unknown here nothing is checked."""
    kind, colon, want = value.partition(":")
    kind, want = kind.strip().lower().replace("-", ""), want.strip()
    if not colon or kind not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    got = hashlib.new(kind, data).digest()
    return want.lower() == got.hex() or want.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def parse_record(data, at: int = 0) -> tuple[dict, bytes, int] | None:
    """(headers, block, position after the record), or None if a check fails.

    The version line, the mandatory headers, the length, the final line ends,
    and the digests of the block and of the headers, where given, must all hold.
    """
    if not _VERSION.match(data, at):
        return None
    stop = data.find(END, at)
    if stop < 0:
        return None
    covered, mark, want = bytes(data[at:stop]).rpartition(HEAD_DIGEST)
    if mark and payload_digest(covered).encode() != want:
        return None
    headers, name = {}, None
    for line in bytes(data[at:stop]).split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name is not None:  # a folded header goes on
            key = name.strip().lower().decode("latin-1")
            headers[key] = f"{headers[key]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        return None
    if not length.isascii() or not length.isdigit():
        return None
    start = stop + len(END)
    end = start + int(length)
    if bytes(data[end : end + len(END)]) != END:
        return None
    block = bytes(data[start:end])
    if not digest_holds(headers.get("warc-block-digest", ""), block):
        return None
    return headers, block, end + len(END)


def _member(data: bytes, at: int) -> tuple[tuple[dict, bytes, int] | None, int]:
    """The record in the gzip member at `at` and the position after the member; checks length and CRC."""
    d, parts, view, to = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not d.eof and to < len(data):
            parts.append(d.decompress(view[to : to + WINDOW]))
            to = min(to + WINDOW, len(data))
    except zlib.error:
        return None, at
    if not d.eof:
        return None, at
    plain = b"".join(parts)
    got = parse_record(plain)
    return (got if got and got[2] == len(plain) else None), to - len(d.unused_data)


def salvage(data: bytes) -> tuple[list[tuple[int, dict, bytes]], list[tuple[int, int, str]]]:
    """(records, gaps) of an archive: (position, headers, block), and (start, end, reason)."""
    records, gaps, at, bad, reason = [], [], 0, None, ""
    while at < len(data):
        if data.startswith(_MEMBER, at):
            got, after = _member(data, at)
            why = "broken gzip member"
        else:
            got = parse_record(data, at)
            after = got[2] if got else at
            why = "no version line" if not _VERSION.match(data, at) else "record fails its checks"
        if got:
            if bad is not None:
                gaps.append((bad, at, reason))
                bad = None
            records.append((at, got[0], got[1]))
            at = after
            continue
        if bad is None:
            bad, reason = at, why
        m = _VERSION.search(data, at + 1)
        nexts = [x for x in (m.start() if m else -1, data.find(_MEMBER, at + 1)) if x >= 0]
        at = min(nexts, default=len(data))
    if bad is not None:
        gaps.append((bad, len(data), reason))
    return records, gaps


_READ = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])
READ = "path string, position long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap_end long, gap_reason string"


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                records, gaps = salvage(content.as_py())
                rows = []
                for at, h, block in records:
                    full = h.get("warc-type") != "revisit"
                    digest = payload_digest(block) if full else h.get("warc-payload-digest", "").partition(":")[2]
                    size = len(block) if full else int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                    rows.append((path.as_py(), at, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, block if payloads else None, None, None))
                rows += [(path.as_py(), start, None, "gap", None, None, None, None, content.as_py()[start:end] if payloads else None, end, why) for start, end, why in gaps]
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512], strict=True), _READ.types, strict=True)], schema=_READ)

    return run


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives below path, plain or gzipped by record.

    Gaps are rows with record_type "gap": position and gap_end bound the
    quarantined bytes, gap_reason says what failed first. A record is whole or
    in a gap, never both. Empty files, and folders without files, give no rows.
    Rows that repeat a record are rows each. A file is read whole by one task,
    so it must be below 2 GB. With payloads false the payload column is null.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), READ)


# --- Writing ---------------------------------------------------------------


def _frame(bits=None):
    """Records of page_id, url, html and refers_to; with bits, of the rows whose mark is not set."""

    def run(batches):
        for batch in batches if bits is None else only_marked(bits, 4, False)(batches):
            page, url, html, first = (batch.column(i) for i in range(4))
            lines = [record(page[i].as_py(), url[i].as_py(), (html[i].as_py() or "").encode("utf-8", "surrogatepass"), first[i].as_py()) for i in range(len(page))]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])

    return run


PAYLOAD = ["n", "h1", "h2"]
PAGE = "page_id long, url string, html string, n int, h1 string, h2 string, mark long"


def _hashed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(pages["html"], F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(html).alias("n"), F.sha1(html).alias("h1"), F.sha2(html, 256).alias("h2"))
    return own.withColumn("mark", mark(*PAYLOAD))


def shared_payloads(own: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The payloads of min_bytes or more that several rows have, and the smallest page_id of each.

    Payloads are equal if length, SHA-1 and SHA-256 are. Groups are counted
    with map-side combining; only hashes are shuffled.
    """
    groups = own.where(F.col("n") >= min_bytes).groupBy(*PAYLOAD).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    return stage(groups, "payloads")[0]


def _referring(own: DataFrame, groups: DataFrame, bits) -> DataFrame:
    """page_id, url, html, refers_to of the rows whose payload may be shared."""
    some = own.mapInArrow(only_marked(bits, 6), PAGE)
    total = groups.agg(F.sum("pages")).first()[0] or 0
    return spread_join(some, groups, PAYLOAD, "pages", "page_id", total).select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with the same payload, null for that page itself and for payloads below min_bytes."""
    ship(pages.sparkSession)
    own = _hashed(pages)
    groups = shared_payloads(own, min_bytes)
    bits = bitmap(groups, *PAYLOAD)
    alone = own.mapInArrow(only_marked(bits, 6, False), PAGE).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    return alone.union(_referring(own, groups, bits))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives below path.

    Null html is an empty payload; a null page_id has an empty record id and is
    never the page that others refer to unless all of its group are null. Rows
    that repeat page_id and html are all responses if that page is. A file
    takes as many records as fill file_bytes on average, so a page of any
    length is whole in one file. Pages are written where they are read; only
    those whose payload may be shared are joined with the page they refer to.
    """
    ship(pages.sparkSession)
    size = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    own = _hashed(pages)
    groups = shared_payloads(own, min_bytes)
    bits = bitmap(groups, *PAYLOAD)
    alone = own.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), "mark").mapInArrow(_frame(bits), "value binary")
    framed = alone.union(_referring(own, groups, bits).mapInArrow(_frame(), "value binary"))
    most = max(1, file_bytes * size[1] // max(size[0] or 1, 1)) if size[1] else 1
    # The writer takes strings; the cast keeps the bytes as they are.
    framed.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "none").option("maxRecordsPerFile", most).text(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back. A gap in these archives would be a lost page, so it is an error. Edge cases are those of write_warc() and read_warc()."""
    path = stage_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    forget_at_exit(spark, path)
    lost = F.raise_error(F.concat(F.lit("damaged archive "), "path", F.lit(" at "), "position", F.lit(": "), "gap_reason"))
    found = read_warc(spark, path, payloads=False).withColumn("record_type", F.when(F.col("record_type") == "gap", lost).otherwise(F.col("record_type")))

    def number(c: str):
        return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (
  SELECT p.*, first, array_to_string(list_transform(range(20), lambda i:
    lpad(bin(('0x' || substr(sha1(p.h), (2 * i + 1)::INTEGER, 2))::INTEGER), 8, '0')), '') AS bits
  FROM p JOIN g USING (h))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
    + 16 * substr(bits, (5 * i + 1)::INTEGER, 1)::INTEGER + 8 * substr(bits, (5 * i + 2)::INTEGER, 1)::INTEGER
    + 4 * substr(bits, (5 * i + 3)::INTEGER, 1)::INTEGER + 2 * substr(bits, (5 * i + 4)::INTEGER, 1)::INTEGER
    + substr(bits, (5 * i + 5)::INTEGER, 1)::INTEGER)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

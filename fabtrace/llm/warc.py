"""Web archives: one record per page, and a reader that salvages damaged archives.

Archives hold WARC/1.1 records, each a gzip member of its own. Of pages with equal payloads the
one with the smallest id is stored; the others are revisit records that name it.

The reader goes through an archive record by record. Whatever stands at a place must pass every
check: the member's checksum, the version line, the mandatory fields, the block's length and end,
and the digests the record names. After a failed check the bytes are searched for the next
member or version line that begins a valid record. The bytes between are reported as a gap with
the reason; the records behind it are read as ever.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.llm.common import Batches, drop, stored
from fabtrace.llm.exact import MOST_CELLS, may_repeat, repeat_filter

# Payloads below this size are always stored.
LEAST_REVISIT = 100
# Compressed bytes of an archive, after which a new one begins; a record is never split.
ARCHIVE_BYTES = 32 << 20
# Bytes of payload in one batch of records.
BATCH_BYTES = 8 << 20
# Pages that a task is handed at a time; of archives it is one.
PAGES_AT_ONCE = 256
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
_VERSION = b"WARC/1.1"
_TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[0-9]\.[0-9]\r?\n")
_VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_FOLDED = re.compile(rb"\r?\n[ \t]+")
# The last byte of a member is the highest of its content's length, 0 for less than 16 MB.
_LAST_BYTE = "\x00"

# What a URI may hold as it is; everything else is percent-encoded.
_URI = "/:?#[]@!$&'()*+,;=-._~%"
_FIELDS = (
    "archive string, offset long, length long, error string, record_id string, record_type string, "
    "refers_to string, target_uri string, date string, fields map<string, string>, payload binary"
)


# ---- writing -------------------------------------------------------------------------------


def payloads(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", text_column: str = "html"
) -> DataFrame:
    """(id, url, payload) of a table of pages; the payload is the text in UTF-8, empty for null."""
    payload = F.coalesce(F.col(f"`{text_column}`").cast("string").cast("binary"), F.lit(b""))
    return df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"), payload.alias("payload")
    )


def with_revisits(found: DataFrame, least: int = LEAST_REVISIT, most_cells: int = MOST_CELLS) -> DataFrame:
    """Rows (id, url, payload) with ``digest`` and ``first``: the id of the page they revisit.

    ``first`` is null for pages to be stored. Of payloads of ``least`` bytes or more that are
    equal, the smallest id is stored, in every row that has it; a null id is larger than all
    others. Two Bloom passes tell which payloads may occur again; only those rows are shuffled.
    """
    spark = found.sparkSession
    rows = found.withColumn("digest", F.sha2("payload", 256))
    none = F.lit(None).cast(dict(found.dtypes)["id"])
    large = rows.where(F.octet_length("payload") >= least)
    small = rows.where(F.octet_length("payload") < least).withColumn("first", none)
    digests, path = stored(large.select("id", F.unhex("digest").alias("digest")))
    bits, cells = repeat_filter(digests.select("digest"), digests.count(), most_cells)
    again = may_repeat(F.unhex("digest"), bits, cells, spark)
    groups, _ = stored(
        digests.groupBy(F.lower(F.hex("digest")).alias("digest"))
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1")
        .drop("pages")
    )
    drop(spark, path)
    marked = large.withColumn("_again", again)
    alone = marked.where("NOT _again").drop("_again").withColumn("first", none)
    # Read from a table, the groups leave Spark free to split the rows of a large one.
    first = F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least"))
    copies = marked.where("_again").drop("_again").join(groups, "digest", "left").withColumn("first", first)
    return small.unionByName(alone).unionByName(copies.drop("least"))


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> None:
    """Write rows (id, url, payload, digest, first) as archives below ``path``.

    Every task writes archives of its own, each a file. Ids may hold any character; what a URI
    can't hold is percent-encoded in urls. No rows make no archive.
    """

    def pack(batches: Batches) -> Iterator[pa.RecordBatch]:
        archive, records = bytearray(), 0
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "first")]
            for i in range(batch.num_rows):
                record = _record(*(c[i].as_py() for c in columns))
                archive += _member(record) if compress else record
                records += 1
                if len(archive) >= archive_bytes:
                    yield _archive(archive, records, compress)
                    archive, records = bytearray(), 0
        if records:
            yield _archive(archive, records, compress)
        # Python workers wait for other tasks and keep what they have.
        del archive
        pa.default_memory_pool().release_unused()

    named = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "url", "first")})
    archives = named.mapInArrow(pack, "archive binary")
    # The text sink writes the bytes as they are and ends every value with the separator, which
    # is the last byte of the archive: a file is exactly one archive.
    text = archives.select(F.col("archive").cast("string")).write.mode("errorifexists")
    with _at_once(rows.sparkSession, PAGES_AT_ONCE):
        text.option("lineSep", _LAST_BYTE if compress else "\n").option("maxRecordsPerFile", 1).text(path)


@contextlib.contextmanager
def _at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run meanwhile hand so many rows at a time to Python, as rows may be large."""
    before = spark.conf.get(_ROWS_AT_ONCE)
    spark.conf.set(_ROWS_AT_ONCE, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_AT_ONCE, before)


_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _archive(archive: bytearray, records: int, compress: bool) -> pa.RecordBatch:
    """The archive but for its last byte, not copied. A short last record says how many came before."""
    closing = _headed(
        {"WARC-Type": "metadata", "WARC-Record-ID": "<urn:fabtrace:end>", "WARC-Date": DATE,
         "Content-Type": "application/warc-fields"},
        b"records: %d\r\n" % records,
    )
    archive += (_member(closing) if compress else closing)[:-1]
    ends = pa.py_buffer(np.array([0, len(archive)], np.int32))
    return pa.record_batch({"archive": pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(archive)])})


def _quoted(text: str, ok: str = "") -> str:
    return urllib.parse.quote(text, safe=ok)


def _name(page: str | None, digest: str) -> str:
    """A record's id, from which the page's can be read: ``-`` stands for null."""
    return f"<urn:fabtrace:page:{'-' if page is None else '=' + _quoted(page)}:{digest}>"


def _headed(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"".join([_VERSION, b"\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def _record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": _name(page, digest),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if url is not None:
        fields["WARC-Target-URI"] = _quoted(url, _URI)
    if first is not None:
        fields |= {"WARC-Profile": _SAME_PAYLOAD, "WARC-Refers-To": _name(first, digest)}
    return _headed(fields, block)


# ---- reading -------------------------------------------------------------------------------


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes


class Damage(Exception):
    """Why the bytes at a place are no valid record."""


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at a place, and where it ends."""
    unpack = zlib.decompressobj(31)
    parts, step = [], 1 << 16
    try:
        for start in range(at, len(data), step):
            parts.append(unpack.decompress(data[start : start + step]))
            if unpack.eof:
                return b"".join(parts), min(start + step, len(data)) - len(unpack.unused_data)
    except zlib.error:
        raise Damage("member does not inflate") from None
    raise Damage("member is cut off")


def _digest_fits(named: str, data: bytes) -> bool:
    """Whether a digest field fits; one of an unknown kind says nothing."""
    kind, _, value = named.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return True
    made = hashlib.new(kind, data, usedforsecurity=False)
    value = value.strip()
    return value.lower() == made.hexdigest() or value.upper() == base64.b32encode(made.digest()).decode()


def _parsed(data: bytes, at: int) -> tuple[Record, int]:
    """The record whose version line stands at a place, and where it ends."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damage("no version line")
    end = _HEAD_END.search(data, line.end() - 1)
    if not end:
        raise Damage("header does not end")
    fields = {}
    for field in _FOLDED.sub(b" ", data[line.end() : end.start()]).splitlines():
        name, colon, value = field.partition(b":")
        if not colon:
            raise Damage("header line without a name")
        fields[name.decode(errors="replace").strip().lower()] = value.decode(errors="replace").strip()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise Damage(f"no {missing[0]}")
    if not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        raise Damage("content-length is no number")
    if fields["warc-type"] not in _TYPES:
        raise Damage("unknown type of record")
    stop = end.end() + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("block does not end where its length says")
    block = data[end.end() : stop]
    if not _digest_fits(fields.get("warc-block-digest", ""), block):
        raise Damage("block digest differs")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] != "revisit" and not _digest_fits(fields.get("warc-payload-digest", ""), payload):
        raise Damage("payload digest differs")
    return Record(fields, payload), stop + 4


def _records_at(data: bytes, at: int) -> tuple[list[Record], int]:
    """All records of the member, or the plain record, at a place, and where it ends."""
    if not data.startswith(_MEMBER, at):
        record, end = _parsed(data, at)
        return [record], end
    content, end = _inflated(data, at)
    records, inner = [], 0
    while inner < len(content):
        record, inner = _parsed(content, inner)
        records.append(record)
    if not records:
        raise Damage("empty member")
    return records, end


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record) of an archive's valid records, and (offset, length, reason) of gaps.

    The stretches follow each other without overlap and cover the archive. Records of a member
    that holds several share its stretch.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            records, end = _records_at(data, at)
        except Damage as damage:
            if gap is None:
                gap, why = at, str(damage)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, why
            gap = None
        for record in records:
            yield at, end - at, record
        at = end
    if gap is not None:
        yield gap, at - gap, why


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every gap of the archives below ``path``, compressed or plain.

    A row has archive, offset and length. For a gap ``error`` says which check failed and the
    rest is null; for a record it is null, ``fields`` has all header fields by their names in
    lower case and ``payload`` the content without HTTP headers. A task holds one archive of
    at most 2 GB and a batch of records at a time.
    """

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or b"")
        # Python workers wait for other tasks and keep what they have.
        pa.default_memory_pool().release_unused()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, _FIELDS)


def _batches(archive: str, data: bytes) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for offset, length, found in salvage(data):
        if isinstance(found, str):
            rows.append((archive, offset, length, found, *[None] * 7))
        else:
            get = found.fields.get
            names = [get(k) for k in ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-date")]
            rows.append((archive, offset, length, None, *names, list(found.fields.items()), found.payload))
            size += len(found.payload)
        if size >= BATCH_BYTES or len(rows) >= 10_000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


_TEXT = pa.string()
_ARROW = [_TEXT, pa.int64(), pa.int64(), _TEXT, _TEXT, _TEXT, _TEXT, _TEXT, _TEXT, pa.map_(_TEXT, _TEXT), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _FIELDS.replace("map<string, string>", "map").split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names)


def quarantined(found: DataFrame) -> DataFrame:
    """The log of what was skipped: archive, offset, length and the check that failed first."""
    return found.where("error IS NOT NULL").select("archive", "offset", "length", "error")


def page_id(record_id: Column) -> Column:
    """The page named by a record id that ``write`` made; null if another writer did."""
    name = F.regexp_extract(record_id, r"^<urn:fabtrace:page:=([^:]*):[0-9a-f]{64}>$", 1)
    written = record_id.rlike(r"^<urn:fabtrace:page:=")
    return F.when(written, F.url_decode(name))


def pages(found: DataFrame, id_type: str = "string") -> DataFrame:
    """Pages read back: page_id, url, record_type, refers_to, payload_bytes and payload_digest.

    A revisit's payload is that of the record it refers to; its size is null if that record
    was lost. Records that ``write`` did not make for a page are left out.
    """
    own = found.where("error IS NULL AND record_id LIKE '<urn:fabtrace:page:%'").select(
        "record_id", "record_type", "refers_to", "target_uri",
        F.octet_length("payload").cast("long").alias("size"),
        F.sha2("payload", 256).alias("made"),
        F.regexp_replace(F.col("fields")["warc-payload-digest"], "^sha256:", "").alias("named"),
    )
    with _at_once(found.sparkSession, 1):
        kept, _ = stored(own)
    stores, revisits = kept.where("refers_to IS NULL"), kept.where("refers_to IS NOT NULL")
    sizes = stores.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("size").alias("payload_bytes"))
    columns = [
        page_id(F.col("record_id")).cast(id_type).alias("page_id"),
        F.col("target_uri").alias("url"),
        "record_type",
        page_id(F.col("refers_to")).cast(id_type).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
    ]
    stored_pages = stores.withColumnsRenamed({"size": "payload_bytes", "made": "payload_digest"})
    again = revisits.join(sizes, "refers_to", "left").withColumnRenamed("named", "payload_digest")
    return stored_pages.select(*columns).unionByName(again.select(*columns))

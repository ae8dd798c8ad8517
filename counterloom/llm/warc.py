"""WARC archives in which repeated payloads are revisits of one response.

Pages are written as response records into gzip archives. To deduplicate, only
the headers of their records are shuffled, by payload digest; every record whose
payload a record with a smaller page id has becomes a revisit of the response with
the smallest. The list of a file's revisits (at most ``RECORDS`` entries) then
meets the file, and new archives are written: responses copied, revisits with
fresh headers and without payload.

Files are bounded by bytes as well as by records. Pages of up to ``SMALL`` bytes are
written ``RECORDS`` to a file; those of up to 2^k times as many bytes go to a folder
of their own below, ``size=k``, with 2^k times fewer records to a file, so no archive
holds more than about ``RECORDS * SMALL`` bytes or one record. Archives are
decompressed piece by piece, and tasks hand on records in batches of ``BATCH_BYTES``.

Archives go through Spark's text sink, so they are committed task by task and land
in any file system that Spark writes: a record is one "line", and the line
separator is the empty line that ends a record. They are read back file by file
and cut by Content-Length, since payloads may contain anything.

Defined cases: a null html is an empty payload; a null page id is written without
its field, comes back as null, and counts as larger than every id; of repeated
rows with the smallest id exactly one is the response. Line breaks and other
control characters in a url are percent-encoded. Only the named columns are read.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from counterloom.llm.ship import ship
from counterloom.shared import new_folder, settle

RECORDS = 2000
SMALL = 128 * 1024
BATCH_BYTES = 32 * 1024 * 1024
MIN_BYTES = 0

_STEP = 64 * 1024

# Fixed values of the format.
_VERSION = b"WARC/1.1"
_BREAK = "\r\n\r\n"
_RESPONSE = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADERS = (
    "path string, number int, type string, record_id string, page_id long, uri string,"
    " date string, digest string, bytes long, refers_to long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else _percent(c) for c in url or "")


def _percent(character: str) -> str:
    return "".join(f"%{byte:02X}" for byte in character.encode())


def _record(fields: dict[str, object], block: str) -> str:
    """One record as the text sink takes it: the break after the block is the sink's."""
    fields = fields | {"Content-Length": len(block.encode())}
    lines = [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join([_VERSION.decode(), *lines]) + _BREAK + block


def _http_head(size: int) -> str:
    kind = "Content-Type: text/html; charset=utf-8"
    return f"HTTP/1.1 200 OK\r\n{kind}\r\nContent-Length: {size}{_BREAK}"


def response_record(page_id: int | None, url: str | None, html: str, mark: int, date: str) -> str:
    payload = html.encode()
    digest = payload_digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {mark} {digest}")
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": f"<urn:uuid:{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": clean_uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page_id,
        "Content-Type": _RESPONSE,
    }
    return _record(fields, _http_head(len(payload)) + html)


def revisit_record(fields: dict[str, str], size: int, original: dict, date: str) -> str:
    """The record that stands for one whose payload ``original`` has."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, fields["WARC-Record-ID"])
    fresh = {
        "WARC-Type": "revisit",
        "WARC-Record-ID": f"<urn:uuid:{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": fields["WARC-Target-URI"],
        "WARC-Payload-Digest": fields["WARC-Payload-Digest"],
        "WARC-Profile": _PROFILE,
        "WARC-Refers-To": original["record_id"],
        "WARC-Refers-To-Target-URI": original["uri"],
        "WARC-Refers-To-Date": original["date"],
        "WARC-Refers-To-Page-ID": original["page_id"],
        "WARC-Page-ID": fields.get("WARC-Page-ID"),
        "Content-Type": _RESPONSE,
    }
    return _record(fresh, _http_head(size))


def _unzipped(archive: bytes) -> Iterator[bytes]:
    """The content piece by piece, whatever the members it is made of."""
    member = zlib.decompressobj(31)
    for at in range(0, len(archive), _STEP):
        piece = archive[at : at + _STEP]
        while piece:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Fields, HTTP head and payload of every record of a gzip archive.

    No more than one record and one piece are held decompressed.
    """
    pieces, held, passed = _unzipped(archive), bytearray(), 0

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError(f"no end of fields in the record at byte {passed}")
        version, *lines = bytes(held[:end]).split(b"\r\n")
        if version != _VERSION:
            raise ValueError(f"not a WARC record at byte {passed}")
        fields = dict(line.decode().split(": ", 1) for line in lines)
        first = end + 4
        last = first + int(fields["Content-Length"])
        if not fill(last):
            raise ValueError(f"the record at byte {passed} is cut short")
        head = held.index(b"\r\n\r\n", first, last) + 4
        yield fields, bytes(held[first:head]), bytes(memoryview(held)[head:last])
        fill(last + 4)
        del held[: last + 4]
        passed += last + 4


def _batched(texts: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """Texts as batches of about ``BATCH_BYTES``, or one text."""
    rows, size = [], 0
    for text in texts:
        rows.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
            rows, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])


def _http_size(head: bytes) -> int:
    return int(head.rsplit(b"Content-Length: ", 1)[1])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of all records of ``path, content``; digests are taken from the payloads."""
    names = [part.split()[0] for part in _HEADERS.split(",")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[part.split()[1]]
             for part in _HEADERS.split(",")]
    for batch in batches:
        for path, content in zip(*batch.columns):
            rows = []
            for number, (fields, head, payload) in enumerate(records(content.as_py())):
                stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = _http_size(head)
                if fields["WARC-Type"] == "response":
                    if (payload_digest(payload), len(payload)) != (stated, size):
                        raise ValueError(f"damaged payload: {path}, record {number}")
                rows.append(
                    (
                        path.as_py(),
                        number,
                        fields["WARC-Type"],
                        fields["WARC-Record-ID"],
                        _number(fields.get("WARC-Page-ID")),
                        fields["WARC-Target-URI"],
                        fields["WARC-Date"],
                        stated,
                        size,
                        _number(fields.get("WARC-Refers-To-Page-ID")),
                    )
                )
            columns = zip(*rows) if rows else [[] for _ in names]
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content, size`` of all archives; ``size`` is 0 where no folder states it.

    A filter on ``size`` is one on file names, so other files are not opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stated = F.regexp_extract(F.col("_metadata.file_path"), r"/size=([0-9]{1,2})/[^/]*$", 1)
    size = F.coalesce(F.nullif(stated, F.lit("")).cast("int"), F.lit(0))
    return files.select("path", "content", size.alias("size"))


def _write(texts: DataFrame, folder: str, per_file: int, size: int) -> None:
    writer = texts.write.option("lineSep", _BREAK).option("compression", "gzip")
    writer = writer.option("maxRecordsPerFile", max(1, per_file >> size))
    writer.text(f"{folder}/size={size}" if size else folder)


def _size_class(payload: Column) -> Column:
    """The least k such that the payload has at most ``SMALL * 2**k`` bytes."""
    blocks = F.greatest(F.ceil(F.octet_length(payload) / SMALL), F.lit(1)).cast("long")
    return F.length(F.bin(blocks - 1)) - (blocks == 1).cast("int")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the records under ``folder``; a damaged payload is an error."""
    ship(spark)
    return _files(spark, folder).select("path", "content").mapInArrow(_scan, _HEADERS)


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str | None = None,
    per_file: int = RECORDS,
) -> None:
    """Every page as a response record."""
    ship(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def made(batch: pa.RecordBatch) -> Iterator[str]:
        for page, uri, payload, mark in zip(*batch.columns):
            page, uri, text, mark = (v.as_py() for v in (page, uri, payload, mark))
            yield response_record(page, uri, text or "", mark, date)

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batched(made(batch))

    marked = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        F.monotonically_increasing_id().alias("mark"),
    )
    size = F.coalesce(_size_class(F.col("html")), F.lit(0))
    # A payload has at most 2 GiB: fifteen classes.
    found = sorted(row.size for row in marked.select(size.alias("size")).distinct().collect())
    for k in found or [0]:
        texts = marked.filter(size == k).mapInArrow(responses, "value string")
        _write(texts, folder, per_file, k)


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``path, list``: the records of each file that become revisits, and of what."""
    # A long enough payload's record with the smallest page id; ids before nulls.
    first = F.min(
        F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "uri", "date")
    )
    able = headers.filter(F.col("bytes") >= min_bytes)
    originals = able.groupBy("digest").agg(first.alias("original"), F.count("*").alias("n"))
    originals = originals.filter(F.col("n") > 1).select("digest", "original")
    repeated = able.select("path", "number", "record_id", "digest").join(originals, "digest")
    repeated = repeated.filter(F.col("record_id") != F.col("original.record_id"))
    entry = F.struct("number", F.col("original").dropFields("unknown").alias("original"))
    return repeated.groupBy("path").agg(F.collect_list(entry).alias("list"))


def deduplicate_archives(
    spark: SparkSession,
    source: str,
    target: str,
    date: str | None = None,
    min_bytes: int = MIN_BYTES,
    per_file: int = RECORDS,
) -> None:
    """Archives under ``source`` written anew under ``target``, repeats as revisits."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = settle(read_archives(spark, source), "headers")

    def copied(content: bytes, changes: dict[int, dict]) -> Iterator[str]:
        for number, (fields, head, payload) in enumerate(records(content)):
            if number in changes:
                yield revisit_record(fields, _http_size(head), changes[number], date)
            else:
                kept = {k: v for k, v in fields.items() if k != "Content-Length"}
                yield _record(kept, (head + payload).decode())

    def renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, entries in zip(*batch.columns):
                changes = {e["number"]: e["original"] for e in entries.as_py() or []}
                yield from _batched(copied(content.as_py(), changes))

    lists = settle(revisits(headers, min_bytes), "revisits")
    files = _files(spark, source)
    for row in sorted(files.select("size").distinct().collect()) or [Row(size=0)]:
        own = files.filter(F.col("size") == row.size)
        joined = own.join(lists, "path", "left").select("content", "list")
        _write(joined.mapInArrow(renewed, "value string"), target, per_file, row.size)


def resolve_revisits(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_BYTES,
    per_file: int = RECORDS,
) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page.

    Pages are written as archives, the archives deduplicated, and the result read
    back from the new archives.
    """
    spark = pages.sparkSession
    source, target = new_folder(spark, "archives"), new_folder(spark, "unique-archives")
    write_archives(pages, source, page_id, url, html, per_file=per_file)
    deduplicate_archives(spark, source, target, min_bytes=min_bytes, per_file=per_file)
    return read_archives(spark, target).select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )

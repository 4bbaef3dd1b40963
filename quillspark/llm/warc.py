"""WARC archives of web pages with a two-level capture index.

Archives: a task writes its pages as compressed WARC records, one gzip member each, to files of bounded size in the shared
folder and reports every record's file, offset and length.  Of records with equal payloads of at least
``REVISIT_BYTES`` the one with the largest page id is a response, the others are revisits that refer to it.

Index: captures are sorted by URL key (host labels reversed, then path and query) and page id, range by range.  A range
is one index file: compressed blocks of ``BLOCK_LINES`` lines and, at its end, the block directory with each block's first
key.  The top level is one row per index file with its first key.  A lookup is sent to its file by binary search in
the top level, there to its block by binary search in the directory, and one range read gives the block; a range
read of the archive gives the record.

Files are named by a random id per attempt, so a task that runs again writes files of its own and only files
that a committed table names are ever read.  Folders may be in any store that Arrow's file systems open.

Nulls and odd rows: a null page is an empty payload; a null URL has an empty key; a null page id is kept as null, and its
record is never a revisit.  Repeated rows are archived each on its own; of equal ones the largest id may occur twice,
then both are responses.  Line breaks in a URL are percent-encoded in the header.  An empty table gives no files.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.session import materialize, new_path

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: Bytes that one range read may join.
READ_BYTES = 8 << 20
#: Bytes of pages, and rows of captures, that a task holds as Python objects before it passes them on.
HELD_BYTES = 4 << 20
HELD_ROWS = 20_000
DATE = "2024-01-01T00:00:00Z"
_PLACES = ["file", "offset", "length"]


def url_key(url: Column) -> Column:
    """Sort key of a URL: "http://www.a.example.com/x?y#z" becomes "com,example,a)/x?y"."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    key = F.when(host == "", F.lower(url)).otherwise(turned)
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x00-\x20]", "_")


def capture_key(url: Column, page_id: Column) -> Column:
    """URL key and page id in one sortable string; null ids first."""
    digits = F.coalesce((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), F.lit(""))
    return F.concat(url_key(url), F.lit(" "), F.lpad(digits, 20, "0"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None) -> bytes:
    """One WARC record, uncompressed."""
    revisit = revisit_of is not None
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_of)}", f"X-Refers-To-Page-ID: {revisit_of}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Files:
    """Writes chunks of bytes to files of bounded size and tells where each went."""

    def __init__(self, folder: str, ending: str, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.ending, self.limit, self.out = folder, ending, limit, None

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.size >= self.limit:
            self.close()
            self.store.create_dir(self.path, recursive=True)
            self.name, self.size = f"{uuid.uuid4().hex}.{self.ending}", 0
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = f"{self.folder}/{self.name}", self.size, len(data)
        self.out.write(data)
        self.size += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Ranges:
    """Range reads, one open file at a time."""

    def __init__(self):
        self.name = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            store, path = fs.FileSystem.from_uri(name)
            self.file, self.name = store.open_input_file(path), name
        return self.file.read_at(length, offset)

    def size(self, name: str) -> int:
        self.read(name, 0, 0)
        return self.file.size()


def annotate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with digest, key and the id that a revisit refers to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(html).alias("digest"), capture_key(F.col(url_col), F.col(id_col)).alias("key"))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(materialize(groups, "warc-repeats"), "digest", "left")  # pages move only if there are many repeats
    return rows.withColumn("refers_to", F.expr("if(page_id < last, last, null)")).drop("last")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write annotated pages; a row per record: key, page_id, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, "warc.gz", FILE_BYTES)
        for batch in W.slices(batches, "html", HELD_BYTES):
            places = []
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                places.append(files.write(pack.compress(build_record(page_id, url, html.encode(), digest, refers)) + pack.flush()))
            columns = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), *columns], names=["key", "page_id", *_PLACES])
        files.close()

    return rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Write the sorted, compressed index; its top level: a row (first_key, index_file) per index file."""
    order = ["key", "file", "offset"]
    ranges = captures.repartitionByRange(partitions, *order) if partitions else captures.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, directory, first = [], [], None
        out = Files(folder, "idx", 1 << 62)

        def flush() -> None:
            nonlocal lines
            place = out.write(zlib.compress("\n".join(lines).encode(), 6))
            directory.append([lines[0].split("\t", 1)[0], place[1], place[2]])
            lines = []

        for batch in batches:
            for key, *place in zip(*(batch.column(c).to_pylist() for c in ("key", *_PLACES)), strict=True):
                first = key if first is None else first
                lines.append("\t".join([key, json.dumps(place)]))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if directory:
            data = zlib.compress(json.dumps(directory).encode())
            name = out.write(data + len(data).to_bytes(8, "little"))[0]
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first_key", "index_file"])

    return ranges.sortWithinPartitions(*order).mapInArrow(run, "first_key string, index_file string")


class IndexFile:
    """One index file: its directory in memory, its blocks by range read."""

    def __init__(self, ranges: Ranges, name: str):
        self.ranges, self.name = ranges, name
        end = ranges.size(name)
        length = int.from_bytes(ranges.read(name, end - 8, 8), "little")
        self.directory = json.loads(zlib.decompress(ranges.read(name, end - 8 - length, length)))
        self.keys = [entry[0] for entry in self.directory]
        self.at, self.lines, self.line_keys = -1, [], []

    def block(self, at: int) -> None:
        if at != self.at:
            _, offset, length = self.directory[at]
            self.lines = zlib.decompress(self.ranges.read(self.name, offset, length)).decode().split("\n")
            self.line_keys = [line.split("\t", 1)[0] for line in self.lines]
            self.at = at

    def find(self, low: str, high: str) -> Iterator[tuple[str, str, int, int]]:
        """Captures with low <= key <= high."""
        at = max(bisect.bisect_left(self.keys, low) - 1, 0)
        while at < len(self.keys) and self.keys[at] <= high:
            self.block(at)
            for k in range(bisect.bisect_left(self.line_keys, low), bisect.bisect_right(self.line_keys, high)):
                yield self.line_keys[k], *json.loads(self.lines[k].split("\t", 1)[1])
            at += 1


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures whose key lies between the columns ``low`` and ``high`` of ``wanted``: key, file, offset, length.

    For one page low and high are its capture key; for all captures of a URL they are its key followed by " " and "!".
    """
    top = sorted((r["first_key"], r["index_file"]) for r in index.collect())  # one row per index file, a file being one sort task's range
    firsts, names = [t[0] for t in top], [t[1] for t in top]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, file = [], [], []
            for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                for at in range(max(bisect.bisect_left(firsts, a) - 1, 0), bisect.bisect_right(firsts, b)):
                    low.append(a)
                    high.append(b)
                    file.append(names[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (low, high, file)], names=["low", "high", "index_file"])

    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())

    def captures_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["key", *_PLACES])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, at, found = Ranges(), None, []
        for batch in batches:
            for low, high, name in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "index_file")), strict=True):
                if at is None or at.name != name:
                    at = IndexFile(ranges, name)
                for capture in at.find(low, high):
                    found.append(capture)
                    if len(found) == HELD_ROWS:
                        yield captures_of(found)
                        found = []
        if found:
            yield captures_of(found)

    routed = wanted.select("low", "high").distinct().mapInArrow(route, "low string, high string, index_file string")
    routed = materialize(routed, "warc-routed")  # a range partition reads its input twice, once to sample it
    ordered = routed.repartitionByRange("index_file", "low").sortWithinPartitions("index_file", "low")
    return materialize(ordered.mapInArrow(find, "key string, file string, offset long, length long"), "warc-found")


def read_records(captures: DataFrame) -> DataFrame:
    """Read captures (a written table) from the archives: page_id, url, record_type, refers_to, payload (null in a revisit),
    declared_digest."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = ["page_id", "url", "record_type", "refers_to", "payload", "declared_digest"]

    def records_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def spans(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[int]]]:
        """Neighbouring records of a file, joined up to ``READ_BYTES`` compressed: file, first offset, lengths."""
        file, start, end, lengths = None, 0, 0, []
        for name, offset, length in zip(*(batch.column(c).to_pylist() for c in _PLACES), strict=True):
            if name != file or offset != end or end + length - start > READ_BYTES:
                if lengths:
                    yield file, start, lengths
                file, start, lengths = name, offset, []
            end = offset + length
            lengths.append(length)
        if lengths:
            yield file, start, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            rows, held = [], 0
            for file, start, lengths in spans(batch):
                data, at = ranges.read(file, start, sum(lengths)), 0
                for length in lengths:
                    fields, payload = parse_record(zlib.decompress(data[at : at + length], 31))
                    at += length
                    revisit = fields["warc-type"] == "revisit"
                    number = lambda f, fields=fields: int(fields[f]) if f in fields else None
                    rows.append((number("x-page-id"), fields["warc-target-uri"], fields["warc-type"], number("x-refers-to-page-id"),
                                 None if revisit else payload, fields["warc-payload-digest"].removeprefix("sha1:")))
                    held += len(payload)
                    if held >= HELD_BYTES:
                        yield records_of(rows)
                        rows, held = [], 0
            if rows:
                yield records_of(rows)

    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, declared_digest string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write archives and index of all pages; the table of captures and the index's top level."""
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = materialize(write_archives(annotate(pages, id_col, url_col, html_col), folder), "warc-captures")
    return captures, materialize(build_index(captures, folder), "warc-index")


def digests(records: DataFrame) -> DataFrame:
    """Per record its payload's size and SHA-1; a revisit has those of the response that it refers to."""
    sums = records.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    sums = materialize(sums, "warc-sums")
    whole = sums.where("record_type = 'response'")
    targets = sums.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    sources = whole.join(targets, "page_id", "left_semi").dropDuplicates(["page_id"]).select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = sums.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(sources, "refers_to", "left")
    return whole.unionByName(again.select(*whole.columns))


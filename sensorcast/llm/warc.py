"""Pages to WARC archives and back, as a table of chunks.

A payload is never put together as a whole record. It becomes rows of a record identifier, a chunk number
and at most ``chunk_bytes`` bytes; each row carries the length and the digest of the payload up to its end,
so the last row of a record has those of the payload. In the archives a chunk is a WARC segment: the
first one a ``response`` record, those after it ``continuation`` records, which may lie anywhere. A
payload that another record has already is a ``revisit`` record without content. Reading takes the
segments as rows again; only records of several rows are sorted, and their digest is carried from row to row.

Archives are written and read by Spark's text format, whose separator is the empty line that ends each record
and each header, so every storage that Spark reaches will do. They are gzip files of one member, which are not
split when they are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.staging import scratch_path, stage

CHUNK_BYTES = 1 << 20
LEAST_SHARED = 1_000  # shorter payloads are always written themselves
HOT = 1_000  # digests with more than 1/HOT of all rows are joined apart from the others
_LINE, _END = "\r\n", "\r\n\r\n"
_RECORD = "urn:page:"
# Terms of the format.
_VERSION = "WARC/1.0"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = "application/http"

_CHUNKS = pa.schema(
    [
        ("row", pa.int64()),
        ("chunk", pa.int32()),
        ("last", pa.bool_()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("data", pa.binary()),
        ("n_bytes", pa.int64()),
        ("digest", pa.string()),
    ]
)
_PARTS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("segment", pa.int32()),
        ("part", pa.int32()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("n_bytes", pa.int64()),
        ("digest", pa.string()),
        ("stated", pa.string()),
    ]
)
_RECORDS = pa.schema([f for f in _PARTS if f.name in ("record_id", "record_type", "refers_to", "n_bytes", "digest", "stated")])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


class _Rows:
    """Rows that are sent on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 4 << 20):
        self.schema, self.most, self.rows, self.held = schema, most_bytes, [], 0

    def add(self, *row, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 500
        if self.held >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def cut(payload, chunk_bytes: int) -> Iterator[memoryview]:
    """Views of at most ``chunk_bytes`` bytes that do not part a character; an empty payload has an empty one."""
    view, at = memoryview(payload), 0
    while True:
        end = min(at + chunk_bytes, len(view))
        if end < len(view):
            # A character has three bytes after its first one at most; anything else is no UTF-8.
            end -= next((n for n in range(4) if view[end - n] & 0xC0 != 0x80), 0)
        yield view[at:end]
        at = end
        if at >= len(view):
            return


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record, chunk, last, page_id, url, data, n_bytes, digest): the payloads of all rows in chunks, written to
    the shared folder. ``record`` tells rows apart, also repeated ones and those without page_id."""
    if chunk_bytes < 4:
        raise ValueError("a chunk must have room for a character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_CHUNKS)
        for batch in batches:
            for row, page_id, url, html in zip(*(batch.column(n) for n in range(4))):
                key = row.as_py(), page_id.as_py(), url.as_py()
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                sha, size = hashlib.sha1(), 0
                for number, part in enumerate(cut(payload, chunk_bytes)):
                    sha.update(part)
                    size += len(part)
                    yield from out.add(
                        key[0], number, size == len(payload), *key[1:], bytes(part), size, _base32(sha), size=len(part)
                    )
        yield from out.rest()

    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").cast("binary").alias("html"),
    )
    made = numbered.mapInArrow(run, _ddl(_CHUNKS)).withColumnRenamed("row", "record")
    path = scratch_path(pages.sparkSession, "chunks")
    made.write.option("compression", "zstd").parquet(path)  # as large as all payloads
    return pages.sparkSession.read.schema(made.schema).parquet(path)


def roles(chunks: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(record, size, payload, origin): every record with the length and digest of its payload and the
    record that has this payload (page_id, record), which may be itself. Of equal payloads of at least
    ``least_shared`` bytes that is the one with the largest page_id."""
    whole = chunks.filter("last").select(
        "record", F.col("n_bytes").alias("size"), F.col("digest").alias("payload"), F.struct("page_id", "record").alias("own")
    )
    long = F.col("size") >= least_shared
    groups = whole.filter(long).groupBy("payload").agg(F.max("own").alias("origin"), F.count(F.lit(1)).alias("copies"))
    groups = stage(groups.filter("copies > 1"), "copied")
    # Rows of a digest that very many have would meet in one task; there are fewer than HOT such digests.
    limit = F.lit(whole.count() / HOT)
    often = groups.filter(F.col("copies") > limit).select("payload", F.col("origin").alias("often"))
    rare = groups.filter(F.col("copies") <= limit).select(F.col("payload").alias("key"), F.col("origin").alias("rare"))
    split = whole.join(F.broadcast(often), "payload", "left")
    # Those that need no further look are dealt by their own number.
    alone = F.concat(F.lit("-"), F.col("record").cast("string"))
    keyed = split.withColumn("key", F.when(long & F.col("often").isNull(), F.col("payload")).otherwise(alone))
    found = keyed.join(rare, "key", "left")
    origin = F.when(long, F.coalesce("often", "rare", "own")).otherwise(F.col("own"))
    return found.select("record", "size", "payload", origin.alias("origin"))


def _name(page: Column, record: Column) -> Column:
    return F.concat(F.lit(_RECORD), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"))


def _bracketed(*parts: Column) -> Column:
    return F.concat(F.lit("<"), *parts, F.lit(">"))


def write_archives(chunks: DataFrame, path: str, least_shared: int = LEAST_SHARED, date: str | None = None) -> None:
    """Write a record per page of a chunk table to gzip files below ``path``. ``date`` (ISO, UTC) is now by default."""
    found = roles(chunks, least_shared).withColumnRenamed("record", "of")
    rows = chunks.join(found, F.col("record") == F.col("of"))
    first, single = F.col("chunk") == 0, (F.col("chunk") == 0) & F.col("last")
    copied = F.col("origin.record") != F.col("record")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = _name(F.col("page_id"), F.col("record"))
    # Blanks and line breaks in an address would end the line or the header.
    url = F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(_END),
    )
    block = F.when(copied, answer).when(first, F.concat(answer, F.col("data").cast("string"))).otherwise(F.col("data").cast("string"))
    lines = {
        "WARC-Type": F.when(copied, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation")),
        "WARC-Record-ID": F.when(first, _bracketed(name)).otherwise(_bracketed(name, F.lit("#"), F.col("chunk").cast("string"))),
        "WARC-Date": F.lit(date) if date else now,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": F.when(first, F.concat(F.lit("sha1:"), F.col("payload"))),
        "WARC-Profile": F.when(copied, F.lit(_PROFILE)),
        "WARC-Refers-To": F.when(copied, _bracketed(_name(F.col("origin.page_id"), F.col("origin.record")))),
        "WARC-Segment-Number": F.when(~copied & ~single, F.col("chunk") + 1),
        "WARC-Segment-Origin-ID": F.when(~copied & ~first, _bracketed(name)),
        "WARC-Segment-Total-Length": F.when(~copied & ~first & F.col("last"), F.octet_length(answer) + F.col("size")),
        "Content-Type": F.when(first, F.lit(f"{_HTTP}; msgtype=response")),
        "Content-Length": F.octet_length("block"),
    }
    shown = [F.concat(F.lit(f"{line}: "), value.cast("string")) for line, value in lines.items()]
    record = F.concat(F.concat_ws(_LINE, F.lit(_VERSION), *shown), F.lit(_END), F.col("block"))
    # Of a copied payload one row is enough.
    written = rows.filter(~copied | first).withColumn("block", block).select(record.alias("value"))
    written.write.option("lineSep", _END).option("compression", "gzip").text(path)


class Reader:
    """Takes the bytes of an archive as they come and gives rows of its records' payloads. It holds a header
    or ``chunk_bytes`` of content at a time."""

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.chunk_bytes, self.with_data = chunk_bytes, with_data
        self.buffer, self.header, self.rest = bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while self._begun():
            want = min(self.rest, self.chunk_bytes)
            ends = want == self.rest
            if len(self.buffer) < want + (len(_END) if ends else 0):
                return
            part = bytes(self.buffer[:want])
            del self.buffer[:want]
            self.rest -= want
            if ends:
                if self.buffer[: len(_END)] != _END.encode():
                    raise ValueError(f"record {self.name} is not as long as its header says")
                del self.buffer[: len(_END)]
            yield self._row(part, ends)

    def end(self) -> None:
        if self.header is not None or self.buffer:
            raise ValueError("an archive ends within a record")

    def _take_header(self) -> dict[str, str] | None:
        at = self.buffer.find(_END.encode())
        if at < 0:
            return None
        first, *lines = self.buffer[:at].decode().split(_LINE)
        del self.buffer[: at + len(_END)]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        return {"": first} | fields

    def _begun(self) -> bool:
        """Whether the headers of the next record are read, its own and that of the answer in it."""
        if self.header is None:
            # A payload's own line break before the last empty line of a file leaves one too many.
            if self.buffer[: len(_END)] == _END.encode():
                del self.buffer[: len(_END)]
            self.header = self._take_header()
            if self.header is None:
                return False
            if not self.header[""].startswith("WARC/"):
                raise ValueError("no record begins where one should")
            self.rest, self.answer = int(self.header["content-length"]), None
            self.part, self.sha, self.size = 0, hashlib.sha1(), 0
            self.name = self.header.get("warc-segment-origin-id", self.header["warc-record-id"]).strip("<>")
        if self.answer is None:
            before = len(self.buffer)
            is_answer = self.header.get("content-type", "").startswith(_HTTP)
            self.answer = self._take_header() if is_answer else {}
            if self.answer is None:
                return False
            self.rest -= before - len(self.buffer)
        return True

    def _row(self, part: bytes, ends: bool) -> tuple:
        header, number = self.header, self.part
        self.sha.update(part)
        self.size += len(part)
        self.part += 1
        segment = int(header.get("warc-segment-number", 1))
        closes = ends and ("warc-segment-number" not in header or "warc-segment-total-length" in header)
        copied = header["warc-type"] == "revisit"
        digest, size = _base32(self.sha), self.size
        stated = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if copied:
            digest, size = stated, int(self.answer["content-length"])
        alone = closes and segment == 1 and number == 0
        refers_to = header.get("warc-refers-to", "").strip("<>") or None
        kind = None if header["warc-type"] == "continuation" else header["warc-type"]
        if ends:
            self.header = None
        return (self.name, kind, refers_to, segment, number, closes, None if alone and not self.with_data else part, size, digest, stated)


def read_archives(spark: SparkSession, path: str, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_id, record_type, refers_to, segment, part, last, data, n_bytes, digest, stated): the payloads of the
    archives below ``path`` in rows of at most ``chunk_bytes``. Length and digest are those of a segment up to
    the row; ``last`` marks the end of a record. Without ``with_data`` records of one row have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = Reader(chunk_bytes, with_data), _Rows(_PARTS)
        for batch in batches:
            for piece in batch.column(0):
                for row in reader.feed(piece.as_py() + _END.encode()):
                    yield from out.add(*row, size=len(row[6] or b""))
        reader.end()
        yield from out.rest()

    # Only the empty lines are cut at; what is between them is bytes, not text.
    lines = spark.read.option("lineSep", _END).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, _ddl(_PARTS))


def whole_records(parts: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, n_bytes, digest, stated): length and digest of each record's payload.

    Records of one row have them already. The rows of the others are brought into order, and one digest goes
    on from row to row, so that no task holds more than a row of a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_RECORDS)
        name = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["record_id"] != name:
                    name, kind, refers_to, stated = r["record_id"], r["record_type"], r["refers_to"], r["stated"]
                    sha, size = hashlib.sha1(), 0
                sha.update(r["data"])
                size += len(r["data"])
                if r["last"]:
                    yield from out.add(name, kind, refers_to, size, _base32(sha), stated)
        yield from out.rest()

    alone = F.col("last") & (F.col("segment") == 1) & (F.col("part") == 0)
    long = parts.filter(~alone).repartition("record_id").sortWithinPartitions("record_id", "segment", "part")
    return parts.filter(alone).select(_RECORDS.names).unionByName(long.mapInArrow(run, _ddl(_RECORDS)))


def _hexadecimal(digest: Column) -> Column:
    """Base-32 digits of a SHA-1 as hexadecimal ones, five at a time of four."""
    values = F.split(F.translate(digest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv"), "")
    fours = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.array_join(F.slice(values, n * 4 + 1, 4), ""))
    return F.array_join(F.transform(fours, lambda v: F.lower(F.lpad(F.conv(v, 32, 16), 5, "0"))), "")


def page_records(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to) of each record in archives that
    ``write_archives`` made; refers_to is the page that a revisit stands for. A payload with another
    digest than its header states is an error."""
    # Kept, so that archives are read once; it holds content of records of several rows only.
    records = whole_records(stage(read_archives(spark, path, with_data=False, chunk_bytes=chunk_bytes), "records"))
    page = lambda name: F.nullif(F.split(F.col(name), ":")[2], F.lit("")).cast("long")
    damaged = F.raise_error(F.concat(F.lit("damaged payload of "), F.col("record_id")))
    digest = F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(damaged)
    return records.select(
        page("record_id").alias("page_id"),
        "record_type",
        F.col("n_bytes").alias("payload_bytes"),
        _hexadecimal(digest).alias("payload_digest"),
        page("refers_to").alias("refers_to"),
    )


def archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives below ``path`` and give what is read back from them, a row
    per page as in ``page_records``.

    The payload is the html in UTF-8, empty where it is null or empty. Of pages with equal payloads of at least
    ``least_shared`` bytes that with the largest page_id is the response and the others are revisits of it; all
    others are responses. Repeated rows are records of their own, one of which is the response. A null
    page_id stays null and counts as smaller than any other; a null url has no line in the header. Other columns
    are ignored; an empty table gives no rows.
    """
    write_archives(chunk_table(pages, chunk_bytes), path, least_shared)
    return page_records(pages.sparkSession, path, chunk_bytes)

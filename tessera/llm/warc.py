"""WARC archives: writing, reading back and resolving revisits by payload digest.

Archives are WARC/1.1 streams written by Spark's text writer, a record a row, whose line separator is the two line
ends that close a record; so any shared file system that Spark writes can hold them. A file holds records of one size
class and so many that FILE_BYTES bounds their payloads (larger ones stand alone), is compressed as a whole, as Spark's
writer does it, and is decompressed and parsed record by record.

Defined cases: a null payload is empty; a null url is empty; a null or repeated page_id is a record like any other
(of equal payloads and equal ids the record that comes last in the archives is the response); an empty table gives
no records; columns that aren't named are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import materialize, scratch_dir

END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive at most, unless it holds a single record, and the size classes of records by their payload's bytes.
FILE_BYTES = 64 << 20
CLASSES = (32 << 10, 512 << 10, 8 << 20, 1 << 62)
#: Bytes that a reader decompresses at a time.
READ_BYTES = 1 << 20
#: The date of every record, unless the caller gives a column.
FIXED_DATE = "2024-01-01T00:00:00Z"

HEADER = StructType([
    StructField("archive", StringType()), StructField("position", LongType()), StructField("record_type", StringType()), StructField("page_id", LongType()),
    StructField("url", StringType()), StructField("payload_digest", StringType()), StructField("payload_bytes", LongType()), StructField("refers_to", LongType()),
])
RECORD = StructType([*HEADER.fields, StructField("payload", BinaryType())])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1, by 20 bits at a time."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(END))


def record_id(kind: str, page_id: Column, url: Column, digest: Column, origin: Column | None = None) -> Column:
    uid = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), url, digest, *([] if origin is None else [origin])).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_bytes(kind: str, page_id: Column, url: Column, digest: Column, n_bytes: Column, payload: Column | None, refers_to: Column | None = None, origin: Column | None = None, refers_to_record: Column | None = None, refers_to_url: Column | None = None, date: str = FIXED_DATE) -> Column:
    """A record without the two line ends that close it. A revisit's block holds the response's HTTP headers alone.

    origin: what tells apart records that are otherwise equal, for their ids.
    """
    page = F.coalesce(page_id.cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", n_bytes.cast("string")), F.lit(END))
    body = F.lit("") if payload is None else payload
    urn = record_id(kind, page_id, url, digest, origin)
    lines = [
        F.lit(f"WARC/1.1{END}"), _line("WARC-Type", kind), _line("WARC-Record-ID", urn), _line("WARC-Date", date), _line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("X-Page-Id", page), _line("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        lines += [
            _line("WARC-Profile", REVISIT_PROFILE), _line("WARC-Refers-To", refers_to_record), _line("WARC-Refers-To-Target-URI", F.regexp_replace(refers_to_url, r"[\r\n]", "")), _line("WARC-Refers-To-Date", date),
            _line("X-Refers-To-Page-Id", F.coalesce(refers_to.cast("string"), F.lit(""))),
        ]
    lines += [_line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(END)]
    return F.concat(*lines, http, body)


def size_classes(n_bytes: Column) -> Column:
    out = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        out = F.when(n_bytes <= CLASSES[i], F.lit(i)).otherwise(out)
    return out


def write_archives(records: DataFrame, path: str, size_class: int, column: str = "record") -> None:
    """Adds archives of records of one size class to those in path."""
    n = max(1, FILE_BYTES // CLASSES[size_class])
    records.select(F.col(column).alias("value")).write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/class={size_class}")


def parse_archive(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of the records of one uncompressed archive, given in pieces; a record is held at a time."""
    held, at, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        seen = 0
        while (head_end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if not held:
                    return
                raise ValueError(f"no record at {at}")
        first, *lines = held[:head_end].decode("utf-8").split(END)
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = head_end + 4
        end = start + int(headers["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, headers, bytes(held[start:end])
        del held[: end + 4]
        at += end + 4


def inflated(data: bytes) -> Iterator[bytes]:
    """The pieces of gzip members, READ_BYTES at a time."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof and data:
            yield member.decompress(data, READ_BYTES)
            data = member.unconsumed_tail
        data = member.unused_data


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row a record. The digest and the length of a response are taken from its payload, those of a revisit from its headers."""
    schema = RECORD if with_payload else HEADER
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py().rsplit("/", 1)[-1], [], 0
                for at, headers, block in parse_archive(inflated(batch.column(1)[i].as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, number = headers["warc-type"], lambda k, h=headers: int(h[k]) if h.get(k) else None
                    if kind == "response":
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if headers["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{name}: the record at {at} doesn't match its digest")
                    else:
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((name, at, kind, number("x-page-id"), headers.get("warc-target-uri", ""), digest, n, number("x-refers-to-page-id"), payload)[: len(arrow)])
                    held += len(payload)
                    if len(rows) == 512 or held > READ_BYTES:
                        held = 0
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[int]:
    """Writes a response record for every page; the size classes that there are."""
    html, url = F.coalesce(F.col(payload_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    made = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    own = size_classes(F.octet_length("html"))
    classes = sorted(r[0] for r in made.select(own.alias("c")).distinct().collect()) or [0]
    for c in classes:
        some = made.where(own == c)
        write_archives(some.select(record_bytes("response", F.col("page_id"), F.col("url"), base32_sha1(F.encode("html", "UTF-8")), F.octet_length("html"), F.col("html")).alias("record")), path, c)
    return classes


def resolve_revisits(spark: SparkSession, path: str, out: str, least_bytes: int = 0, classes: Iterable[int] = range(len(CLASSES))) -> None:
    """Reads archives and writes them again with one response for each payload of at least least_bytes, the rest revisits of it.

    Only headers are shuffled by digest; the payloads of the responses follow by their places in the archives.
    """
    heads = materialize(read_archives(spark, path, with_payload=False), "warc-headers")
    big = F.col("payload_bytes") >= least_bytes
    kept = F.max(F.struct("page_id", "archive", "position", "url")).alias("kept")
    best = heads.where(big).groupBy("payload_digest").agg(kept).select(F.col("payload_digest").alias("digest"), "kept")
    # Merge joins, the same plan at every size: both sides grow with the records.
    decided = heads.join(best.hint("merge"), big & (F.col("payload_digest") == F.col("digest")), "left")
    own = F.col("kept").isNull() | ((F.col("archive") == F.col("kept.archive")) & (F.col("position") == F.col("kept.position")))
    decided = materialize(decided.select("archive", "position", "page_id", "url", "payload_digest", "payload_bytes", own.alias("own"), "kept"), "warc-decisions")
    place = lambda of="": F.concat_ws(":", f"{of}archive", f"{of}position")
    of = record_id("response", F.col("kept.page_id"), F.col("kept.url"), F.col("payload_digest"), place("kept."))
    revisit = decided.where(~F.col("own")).select(record_bytes("revisit", F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes"), None, F.col("kept.page_id"), place(), of, F.col("kept.url")).alias("record"))
    for n, c in enumerate(classes):
        keep = decided.where("own").where(size_classes(F.col("payload_bytes")) == c).select("archive", "position")
        response = read_archives(spark, f"{path}/class={c}").join(keep.hint("merge"), ["archive", "position"], "left_semi").select(
            record_bytes("response", F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes"), F.col("payload").cast("string"), origin=place()).alias("record"))
        write_archives(response if n else response.unionByName(revisit), out, c)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives the pages, resolves revisits and reads the deduplicated archives back."""
    spark = pages.sparkSession
    first, final = scratch_dir(spark, "warc"), scratch_dir(spark, "warc-deduplicated")
    resolve_revisits(spark, first, final, least_bytes, archive_pages(pages, first))
    return read_archives(spark, final, with_payload=False)

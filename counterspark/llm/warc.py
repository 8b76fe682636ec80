"""Legacy archive converter: ARC 1 and 2 to WARC 1.1, and readers of both.

An ARC file opens with a version block; the line under it names the fields of every
record's header line (five in version 1, ten in version 2), and the last field is the
record's declared length.  The converter parses header lines by the file's own
version, takes exactly the declared bytes, and synthesises what WARC asks for beyond
them: record ids (name-based, so a retried task writes the same ones), ISO times from
14-digit dates, record types, and block and payload digests.

Archives are written by Spark's text writer with the record separator as its line
separator (gzip), so the committer guards against lost executors and speculative
twins; a file is kept near ``FILE_BYTES`` of content and is read by one task.

Defined results: a null html is an empty payload; a null url becomes ``unknown:``;
white space and control characters in urls are percent-encoded; equal payloads of
``MIN_REVISIT`` bytes or more give one response (smallest page_id, null last; of
repeated rows one) and revisits of it, smaller payloads are all responses; an empty
table gives no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lasting, utf8_bytes

MIN_REVISIT = 100
FILE_BYTES = 16 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs

# The field lines of the ARC file format, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _version_block(version: int) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    more = {1: "", 2: " 200 - - 0 pages.arc"}[version]
    return f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain{more} {len(body)}\n".encode() + body


def _arc_blocks(version: int, per_file: int):
    """Records, with a version block wherever the writer starts a new file."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            for r in batch.column("record"):
                if n % per_file == 0:
                    out.append(_version_block(version))
                    n += 1
                out.append(r.as_py())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return blocks


def _records_per_file(pages: DataFrame) -> int:
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))) + 400)).first()[0] or 1
    return max(4, min(20_000, int(FILE_BYTES / mean)))


def _write(records: DataFrame, path: str, separator: str, per_file: int) -> None:
    """Binary rows, each followed by ``separator``, as gzip files of at most ``per_file`` records."""
    (
        records.select(F.col("record").cast("string"))
        .write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", per_file).text(path)
    )


def write_arc(pages: DataFrame, path: str, version: int, per_file: int) -> None:
    """One ARC record per page: header line, HTTP head with the page's id, html."""
    body = utf8_bytes(F.col("html"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n\r\n"),
    )
    url = F.coalesce(F.expr(r"regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20')"), F.lit("unknown:"))
    seconds = F.lit(946684800) + F.pmod(F.coalesce(F.crc32(F.col("page_id").cast("string")), F.lit(0)), F.lit(600_000_000))
    date = F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")
    fields = [F.when(url == "", F.lit("unknown:")).otherwise(url), F.lit("0.0.0.0"), date, F.lit("text/html")]
    if version == 2:
        fields += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    length = (F.length(body) + F.length(http)).cast("string")
    record = F.concat(F.encode(F.concat(F.concat_ws(" ", *fields, length), F.lit("\n"), http), "UTF-8"), body)
    rows = pages.select(record.alias("record")).mapInArrow(_arc_blocks(version, per_file), "record binary")
    _write(rows, path, "\n", per_file)


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record but version blocks."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    names = ARC_FIELDS[1].split()
    while line := f.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # the line end after a record
        parts = line.decode("utf-8", "replace").split(" ")
        block = f.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError("an ARC record is shorter than it declares")
        if parts[0].startswith("filedesc:"):
            names = block.split(b"\n")[1].decode().split()
            continue
        # a content type may hold spaces; every other field is one word
        extra = len(parts) - len(names)
        at = names.index("Content-type")
        merged = parts[:at] + [" ".join(parts[at:at + extra + 1])] + parts[at + extra + 1:]
        yield dict(zip(names, merged)), block


def _payload(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head, payload) of a response block."""
    if block.startswith(b"HTTP/"):
        head, gap, body = block.partition(b"\r\n\r\n")
        return head + gap, body
    return b"", block


def _header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("utf-8", "replace") or None
    return None


_ARC_COLUMNS = "key string, page_id bigint, url string, ip string, date string, digest string, n bigint"


def _arc_reader(with_block: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py().rsplit("/", 1)[1]
                rows: list[tuple] = []
                held = 0

                def flush():
                    cols = list(zip(*rows))
                    arrays = [pa.array(cols[0]), pa.array(cols[1], pa.int64()), *(pa.array(cols[i], pa.string()) for i in range(2, 6)), pa.array(cols[6], pa.int64())]
                    names = ["key", "page_id", "url", "ip", "date", "digest", "n"]
                    if with_block:
                        arrays.append(pa.array(cols[7], pa.binary()))
                        names.append("block")
                    return pa.RecordBatch.from_arrays(arrays, names)

                for i, (h, block) in enumerate(parse_arc(content.as_py())):
                    head, body = _payload(block)
                    page = _header(head, b"x-page-id")
                    rows.append((f"{name}#{i}", int(page) if page else None, h["URL"], h["IP-address"], h["Archive-date"], hashlib.sha256(body).hexdigest(), len(body), block if with_block else None))
                    held += len(block)
                    if len(rows) >= 512 or held > 1 << 22:
                        yield flush()
                        rows, held = [], 0
                if rows:
                    yield flush()

    return read


def read_arc(spark: SparkSession, paths: list[str], with_block: bool) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_arc_reader(with_block), _ARC_COLUMNS + (", block binary" if with_block else ""))


def _record_id(key):
    """A name-based id (RFC 4122 version 5) from the record's place in its archive."""
    h = F.sha1(F.concat(F.lit(_NAMESPACE.bytes.hex()), F.encode(key, "UTF-8")))
    return F.concat(
        F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-8"), h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"),
    )


def convert_arc(spark: SparkSession, arcs: list[str], path: str, per_file: int, ws: Workspace, min_revisit: int = MIN_REVISIT) -> None:
    """WARC files at ``path`` with a record per ARC record; repeated payloads become revisits."""
    seen = ws.stash(read_arc(spark, arcs, False).select("key", "page_id", "digest", "n"), "digests")
    first = seen.where(F.col("n") >= min_revisit).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("f"), F.count("*").alias("c")
    )
    again = (
        seen.join(first.where("c > 1"), "digest").where("key <> f.key and n >= %d" % min_revisit)
        .select("key", F.col("f.key").alias("first_key"))
    )
    records = read_arc(spark, arcs, True).join(again, "key", "left")
    crlf = F.lit("\r\n")
    iso = F.expr("concat(substr(date,1,4),'-',substr(date,5,2),'-',substr(date,7,2),'T',substr(date,9,2),':',substr(date,11,2),':',substr(date,13,2),'Z')")
    revisit = F.col("first_key").isNotNull()
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("block"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("key"))),
        F.concat(F.lit("WARC-Date: "), iso),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block, 256)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_key")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length(block).cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), crlf, crlf)
    _write(records.select(F.concat(F.encode(head, "UTF-8"), block).alias("record")), path, "\r\n\r\n", per_file)


def parse_warc(content: bytes) -> Iterator[tuple[dict[bytes, str], bytes]]:
    """(headers by lower-case name, block) of every record."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record does not start where it should")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        n = int(head[b"content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a WARC record is shorter than it declares")
        yield head, block


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in parse_warc(content.as_py()):
                body = _payload(block)[1]
                kind = h[b"warc-type"]
                own = hashlib.sha256(body).hexdigest()
                declared = h[b"warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and own != declared:
                    raise ValueError("a WARC payload differs from its digest")
                page = h.get(b"x-page-id")
                rows.append((h[b"warc-record-id"], int(page) if page else None, kind, len(body), declared, h.get(b"warc-refers-to")))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.string())],
                    ["record_id", "page_id", "record_type", "n", "digest", "refers_id"],
                )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, n, digest, refers_id) of every record; n is the stored payload's size."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_warc_rows, "record_id string, page_id bigint, record_type string, n bigint, digest string, refers_id string")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = lasting(spark, "op7")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_round_trip(pages, ws)


def archive_round_trip(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Pages to ARC (both versions), ARC to WARC, WARC back to one row per page."""
    spark = pages.sparkSession
    per_file = _records_per_file(pages)
    odd = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(2)) == 1
    arcs = [ws.folder("arc1"), ws.folder("arc2")]
    write_arc(pages.where(~odd), arcs[0], 1, per_file)
    write_arc(pages.where(odd), arcs[1], 2, per_file)
    warc = ws.folder("warc")
    convert_arc(spark, arcs, warc, per_file, ws)
    ws.drop(*arcs)
    rows = ws.stash(read_warc(spark, warc), "read_back")
    target = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("n").alias("full"))
    plain = rows.where("refers_id is null").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    linked = rows.where("refers_id is not null").join(target, "refers_id").select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return plain.union(linked)

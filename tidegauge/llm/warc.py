"""Writing WARC archives from pages, and reading archives record by record.

Each record is a gzip member of its own. The reader inflates a member bit by bit, frames the record by
its Content-Length and holds its digests against the bytes. Archives are closed at a bounded size, so
that Spark's binary file source can hand over any archive whatever store it is in.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, new_path, slices, write_table

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The upper halves of record ids: of a page with an id, and of one without.
WITH_ID, WITHOUT_ID = 0x7469646567617567, 0x7469646567617500


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    high, low = (WITHOUT_ID, 0) if page_id is None else (WITH_ID, page_id % (1 << 64))
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    low = whole % (1 << 64)
    return None if whole >> 64 == WITHOUT_ID else low - (1 << 64) * (low >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a revisit has the headers of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": url and "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def inflated(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Pieces of inflated bytes, and whether a member ends with the piece."""
    member = None
    for chunk in chunks:
        while chunk:
            member = member or zlib.decompressobj(wbits=31)
            data = member.decompress(chunk)
            ended, chunk = member.eof, member.unused_data
            yield data, ended
            member = None if ended else member
    if member is not None:
        raise ValueError("the archive ends within a gzip member")


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, in order.

    Raises ValueError for what isn't a record, is cut short or doesn't match its digests.
    """
    held = bytearray()
    head: dict[str, str] | None = None
    start = length = 0
    for data, ended in inflated(chunks):
        held += data
        if head is None and (end := held.find(b"\r\n\r\n")) >= 0:
            first, *lines = held[:end].decode("utf-8").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a record: {first[:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            start, length = end + 4, int(head["content-length"])
        if not ended:
            continue
        if head is None or held[start + length :] != b"\r\n\r\n":
            raise ValueError("a record's length isn't its content-length")
        block = bytes(held[start : start + length])
        if (wanted := head.get("warc-block-digest")) and wanted != f"sha1:{digest(block)}":
            raise ValueError(f"{head.get('warc-record-id')}: block digest doesn't match")
        if head["warc-type"] == "response" and (wanted := head.get("warc-payload-digest")):
            if wanted != f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}":
                raise ValueError(f"{head.get('warc-record-id')}: payload digest doesn't match")
        yield head, block
        held, head = bytearray(), None


def writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, n = bytearray(), 0

        def close() -> pa.RecordBatch:
            # a name for each attempt: what a lost attempt leaves is in no manifest and never read
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(bytes(held))
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [len(held)]})

        for batch in slices(batches):
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                data = record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                held += gzip.compress(data, 6, mtime=0)
                n += 1
                if len(held) >= archive_bytes:
                    yield close()
                    held, n = bytearray(), 0
        if n:
            yield close()

    return run


def write_archives(pages: DataFrame, *, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); gives folder, archive, records, bytes.

    Of payloads (UTF-8 of the html; null: empty) that are equal and have at least min_bytes bytes, the
    one with the smallest page_id is written as response and the others as revisits of it; smaller ones
    are all responses. Payloads are equal if their SHA-1 and SHA-256 are. A null url is left out of the
    record. A null page_id never is a group's response unless all are null. Rows repeated with one
    page_id and payload are all responses if that page is. An empty table gives no archive. Other
    columns are not read. folder: where to, by default a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html")
    keyed = rows.select("page_id", F.sha1(html).alias("sha1"), F.unhex(F.sha2(html, 256)).alias("sha256")).where(F.octet_length(html) >= min_bytes)
    keyed, _ = write_table(keyed, "payload-digests")
    first = keyed.groupBy("sha1", "sha256").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("pages"))
    first, _ = write_table(first, "payloads")
    revisits = join_groups(keyed, first, ["sha1", "sha256"], "pages").where("not page_id <=> refers_to").select("page_id", "sha256", "refers_to").distinct()
    # joined by page and payload, so that the pages of one payload are spread
    key = lambda sha: F.concat_ws(":", F.col("page_id").cast("string"), F.hex(sha))
    revisits = revisits.select(key(F.col("sha256")).alias("key"), "refers_to", F.lit(True).alias("again"))
    rows = rows.withColumn("key", key(F.unhex(F.sha2(html, 256)))).join(revisits, "key", "left")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "refers_to", F.coalesce("again", F.lit(False)).alias("revisit"))
    manifest = rows.mapInArrow(writer(folder, archive_bytes), "archive string, records long, bytes long")
    return write_table(manifest.select(F.lit(folder).alias("folder"), "archive", "records", "bytes"), "warc-manifest")[0]


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of a manifest's archives: record_type, record_id, url, payload_bytes (of the full
    payload), payload_digest, refers_to_id and payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "url", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch["content"]:
                view, rows, held = memoryview(content.as_buffer()), [], 0

                def flush():
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

                for head, block in read_records(bytes(view[k : k + (1 << 16)]) for k in range(0, len(view), 1 << 16)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    full = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
                    response = head["warc-type"] == "response"
                    size = len(payload) if response else int(full[b"content-length"])
                    rows.append((head["warc-type"], head["warc-record-id"], head.get("warc-target-uri"), size, head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to"), payload if response else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield flush()
                        rows, held = [], 0
                yield flush()

    if (first := manifest.select("folder").first()) is None:
        return spark.createDataFrame([], "record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(first["folder"])
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(manifest.select("archive"), "archive", "left_semi")
    fields = "record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"
    return named.select("content").mapInArrow(run, fields)


def page_id_of(record_id_column: str):
    """The page id in a record id that write_archives made, as a column expression."""
    plain = F.regexp_replace(F.regexp_replace(record_id_column, "^<urn:uuid:|>$", ""), "-", "")
    return F.when(F.startswith(plain, F.lit(f"{WITH_ID:016x}")), F.conv(F.substring(plain, 17, 16), 16, -10).cast("long"))

"""WARC archives: write records, index them, read selected records by coalesced byte ranges.

The writer appends one gzip member per record, so any record can be read alone. Its result is
the index: file, offset, length, url, digest and type per record. The reader sorts selected
entries by file and offset, joins near ones into ranges of bounded size, and fetches each
range with one read. Archives lie in the shared folder; a retried task writes under a new name,
and the index, committed by Spark's own writer, names only files of successful attempts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.storage import BitFilter, fresh_path, small_batches, written

#: An archive is closed when it passes this size; so a file's index entries are a bounded group.
FILE_BYTES = 256 << 20
#: Ranges are joined over gaps up to GAP_BYTES and closed at RANGE_BYTES (or at one record).
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
_GZIP_LEVEL = 4

INDEX_SCHEMA = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response block with an HTTP head, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("WARC-X-Page", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            fields.append(("WARC-X-Refers-To-Page", str(refers_to)))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and the payload after the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", directory: str | None = None) -> DataFrame:
    """Write a record per row and return the index (INDEX_SCHEMA), already written to shared storage.

    A null payload is empty. Of rows with equal payload bytes (by SHA-256) the row with the smallest
    id is a response and the others revisit it; rows that repeat the smallest id are responses
    too, and a null id sorts after every id. An empty table writes no archive. Payloads that occur
    once are written where they are read; only repeated ones (and the few that a filter takes for
    such) are shuffled. ``directory`` must be new: a folder of Spark's file systems.
    """
    spark = pages.sparkSession
    small_batches(spark)
    directory = directory or fresh_path(spark, "warc")
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sha = F.unhex(F.sha2("payload", 256))
    seen = rows.select("page_id", sha.alias("sha")).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = written(seen.where("n > 1").select("sha", "first"), "warc-repeated")
    flagged, key, maybe = BitFilter.of(repeated, "sha", "warc-filter").flagged(rows, sha)
    names = ("page_id", "url", "payload")
    # a payload's first id, of those that occur once their own; a hot payload is met by AQE's skew join
    moved = flagged.where(maybe).select(*names, F.col(key).alias("k")).join(repeated, F.col("k") == F.col("sha"), "left")
    moved = moved.select(*names, F.when(F.col("sha").isNull(), F.col("page_id")).otherwise(F.col("first")).alias("first"))
    rows = flagged.where(f"not {maybe}").select(*names, F.col("page_id").alias("first")).unionByName(moved)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(directory)
        filesystem.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page, url, body, least in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, url, body, least = page.as_py(), url.as_py(), body.as_py(), least.as_py()
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                digest, revisit = payload_digest(body), page != least
                gz = zlib.compressobj(_GZIP_LEVEL, zlib.DEFLATED, 31)
                member = gz.compress(record_bytes(page, url, body, digest, least, revisit)) + gz.flush()
                out.write(member)
                found.append((f"{directory}/{name}", at, len(member), page, url, digest, len(body), "revisit" if revisit else "response", least if revisit else None))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield _batch(found, _INDEX)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


_INDEX, _PAGE = _arrow_schema(INDEX_SCHEMA), _arrow_schema(PAGE_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def byte_ranges(index: DataFrame) -> DataFrame:
    """Coalesce the selected entries: rows (file, start, stop, entries sorted by offset)."""
    by_file = Window.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    gap = F.col("offset") - F.lag(end).over(by_file)
    marked = index.select("file", "offset", "length").distinct().withColumn("cut", (gap.isNull() | (gap > GAP_BYTES)).cast("int"))
    runs = marked.withColumn("run", F.sum("cut").over(by_file)).withColumn("block", F.floor(F.col("offset") / RANGE_BYTES))
    return runs.groupBy("file", "run", "block").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("entries")).select("file", "start", "stop", "entries")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records that ``index`` selects, one row each (PAGE_SCHEMA), by ranged reads.

    A response's digest and size are computed from the bytes read and must equal its header; a
    revisit carries those of its full payload in its header. ``payload`` is null for revisits
    and without ``with_payload``. A damaged record raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop, entries in zip(*(batch.column(i) for i in range(4)), strict=True):
                filesystem, path = _filesystem(file.as_py())
                begin, found = start.as_py(), []
                with filesystem.open_input_file(path) as f:
                    data = f.read_at(stop.as_py() - begin, begin)
                for e in entries.as_py():
                    at = e["offset"] - begin
                    fields, body = parse_record(zlib.decompress(data[at : at + e["length"]], 31))
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-x-payload-length"])
                    if kind == "response":
                        if (payload_digest(body), len(body)) != (digest, size):
                            raise ValueError(f"damaged record at {e['offset']} of {path}")
                    page, refers = fields.get("warc-x-page"), fields.get("warc-x-refers-to-page")
                    kept = body if with_payload and kind == "response" else None
                    found.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields["warc-target-uri"], kept))
                yield _batch(found, _PAGE)

    return byte_ranges(index).mapInArrow(read, PAGE_SCHEMA)

"""WARC archives: writing with revisits and segments, reading with segment reassembly (operator 3)."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, join_groups, small_batches, table, tidied

SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES, REVISIT_BYTES = 64 << 10, 16 << 10, 16 << 20, 0
#: Record dates are a parameter of the archive, not the time of the run, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, segment: int = 1) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}{f':{segment}' if segment > 1 else ''}>"


def page_of(record_id: str) -> int | None:
    part = record_id.strip("<>").split(":")[2]
    return None if part == "none" else int(part)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Transfer framing: hexadecimal length, line end, data, line end, for each chunk; a chunk of length 0 ends it."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. A broken frame is an error."""
    at, out = 0, []
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its line end")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None, segment_bytes: int, nth: str) -> Iterator[bytes]:
    """A page's records: one revisit, one response, or a response and its continuations."""
    ids = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        yield record("revisit", [("WARC-Record-ID", urn(page_id)), *ids, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to)), ("X-Payload-Length", len(payload)), kind], http)
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", [("WARC-Record-ID", urn(page_id)), *ids, kind], block)
        return
    n = -(-len(block) // segment_bytes)
    # The origin keeps its page's number; `nth` tells apart rows that share one.
    origin = urn(page_id).replace(">", f"#{nth}>")
    for i in range(n):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        if not i:
            yield record("response", [("WARC-Record-ID", origin), *ids, ("WARC-Segment-Number", 1), kind], part)
        else:
            end = [("WARC-Segment-Total-Length", len(block))] if i == n - 1 else []
            yield record("continuation", [("WARC-Record-ID", urn(page_id, i + 1)), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", i + 1), *end], part)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive; the zero byte that Spark's writer adds is padding."""
    at = 0
    while at < len(data) and data[at]:
        unzip = zlib.decompressobj(31)
        yield unzip.decompress(memoryview(data)[at:])
        at = len(data) - len(unzip.unused_data)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, sha1 and refers_to of the rows that repeat another page's payload. Only narrow rows are grouped and joined, and no payload is a hot key."""
    keys = ["sha1", "payload_bytes"]
    first = pages.where(F.col("payload_bytes") >= least_bytes).groupBy(*keys).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    return join_groups(pages, first, keys).where("page_id > refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, least_bytes: int = REVISIT_BYTES) -> None:
    """Write one record for each row (more for segments) into gzip archives of about FILE_BYTES, a member for each record."""
    spark = pages.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"))
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha1(text.cast("binary")).alias("sha1"))
    # Written first: if few pages repeat, the planner sees that and the wide rows needn't move.
    scratch = Scratch(spark, "revisits")
    again = scratch.write(revisits(scratch.write(narrow, "digests"), least_bytes), "revisits")
    rows = rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth, out = TaskContext.get().partitionId(), 0, bytearray()
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(column(batch, c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                nth += 1
                url = "".join(url.as_py().splitlines())
                for raw in page_records(page_id.as_py(), url, html.as_py().encode(), refers_to.as_py(), segment_bytes, f"{task}-{nth}"):
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out += pack.compress(raw) + pack.flush()
                if len(out) >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["file"])
                    out = bytearray()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["file"])

    rows.mapInArrow(tidied(run), "file binary").select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the archives.

    Whole records are decoded where they are read. Segments are grouped by their origin's identifier, put in the
    order of their numbers, checked for gaps and for the total length, joined and only then decoded; a group is one record's block.
    """
    small_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                rows, held = [], 0
                for raw in members(content.as_py()):
                    h, block = parsed(raw)
                    row = dict.fromkeys(schema.names) | {"page_id": page_of(h.get("warc-segment-origin-id", h["warc-record-id"]).split("#")[0]), "record_type": h["warc-type"]}
                    if "warc-segment-number" in h:
                        row |= {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": int(h["warc-segment-number"]), "total": int(t) if (t := h.get("warc-segment-total-length")) else None, "part": block}
                        held += len(block)
                    elif h["warc-type"] == "revisit":
                        row |= {"payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": page_of(h["warc-refers-to"])}
                    else:
                        payload = payload_of(block)
                        row |= {"payload_bytes": len(payload), "payload_digest": digest(payload)}
                        if f"sha1:{row['payload_digest']}" != h["warc-payload-digest"]:
                            raise ValueError(f"payload digest of {h['warc-record-id']} differs")
                    rows.append(row)
                    if len(rows) >= 2000 or held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def reassemble(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["number"])
        block = b"".join(r["part"] for r in rows)
        if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {rows[0]['origin']} are missing, repeated or of another total length")
        payload = payload_of(block)
        return pa.Table.from_pylist([{"page_id": rows[0]["page_id"], "payload_bytes": len(payload), "payload_digest": digest(payload), "record_type": "response", "refers_to": None}], schema=pa.schema(list(schema)[:5]))

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = Scratch(spark, "records").write(files.mapInArrow(tidied(run), f"{COLUMNS}, origin string, number int, total long, part binary"), "records")
    names = schema.names[:5]
    whole = rows.where("origin is null").select(*names)
    joined = rows.where("origin is not null").select("page_id", "origin", "number", "total", "part").groupBy("origin").applyInArrow(reassemble, COLUMNS)
    return whole.unionByName(joined)


def warc_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archives of a table of pages to the shared folder and read them back.

    Edge cases: a null html is an empty payload, and equal empty payloads revisit the first like any other; a null page_id
    is written as a response that no record refers to, and is read back as null; rows of a repeated page_id with equal payloads
    are all responses if theirs is the smallest id; a null url is empty, and line ends in a url go; an empty table gives no archive and no rows;
    only the named columns are read.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archive")
    write_warc(pages, path, **columns)
    return read_warc(spark, path)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))

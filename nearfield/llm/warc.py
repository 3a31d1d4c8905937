"""WARC archives: writing pages as records, and reading them with segments put together again."""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import cut, shared_folder, spread_join

SEGMENT_BYTES = 1 << 16
HTTP_CHUNK = 1 << 13
RECORDS_PER_FILE = 4096
LEAST_REVISIT = 100
END = "\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; extensions and trailers are passed over. A frame that
    isn't whole is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not whole")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _uri(url: str | None) -> str | None:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def page_records(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, segment: int) -> Iterator[bytes]:
    """A page's records: a revisit without payload if it refers to another page, else a response whose
    block, in chunked transfer framing, is cut into segments where it is long."""
    name = f"urn:page:{'' if page_id is None else page_id}:{row}"
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)], HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment])
    count = -(-len(block) // segment)
    for k in range(2, count + 1):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == count else None)]
        yield _record(own, block[(k - 1) * segment : k * segment])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, refers_to: the smallest page_id of an
    equal payload of at least `least` bytes, null for that page itself and for all others. Smaller payloads, empty ones
    among them, stay where they are; pages of a common payload are dealt to many tasks."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    names = ["page_id", "url", "payload", "digest"]
    small = rows.where(F.octet_length("payload") < least).withColumn("digest", F.sha2("payload", 256)).select(*names, F.lit(None).cast("long").alias("refers_to"))
    large = rows.where(F.octet_length("payload") >= least).withColumn("digest", F.sha2("payload", 256))
    firsts = cut(large.groupBy("digest").agg(F.min(F.col("page_id").cast("long")).alias("first"), F.count("*").alias("n")))
    other = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return small.unionByName(spread_join(large, firsts, ["digest"], "n").select(*names, F.when(other, F.col("first")).alias("refers_to")))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes gzipped archives of pages(page_id, url, html) to a folder, by Spark's own committer, so that
    any store will do and a lost task is written again. Files hold per_file records at most, hence at most
    per_file * segment bytes."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for page_id, row, url, payload, digest, refers in zip(*(batch[c] for c in ("page_id", "row", "url", "payload", "digest", "refers_to")), strict=True):
                for record in page_records(None if pd.isna(page_id) else int(page_id), row, url, bytes(payload), digest, None if pd.isna(refers) else int(refers), date, segment):
                    held.append(record)
                    size += len(record)
                    if size > 1 << 24:
                        yield pd.DataFrame({"record": held})
                        held, size = [], 0
            if held:
                yield pd.DataFrame({"record": held})

    # ids as text: pandas would make floats of longs with nulls
    rows = with_revisits(pages).select(F.col("page_id").cast("string"), F.monotonically_increasing_id().alias("row"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    out = rows.mapInPandas(records, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields by lower-case name, and the block."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is not whole")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def stated_length(block: bytes) -> int:
    found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block.partition(b"\r\n\r\n")[0])
    return int(found[1]) if found else 0


def reassemble(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """Segments as one block: numbered from 1 without gaps, and as long together as the last one says."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[1] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or total is None or len(block) != total:
        raise ValueError(f"segments {[p[0] for p in parts][:20]} of {len(block)} bytes; {total} are due")
    return block


RAW = "record_id string, type string, uri string, payload_digest string, refers_to string, origin string, segment int, total long, block binary"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record in the archives of a folder, continuation records among them."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RAW.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                with gzip.open(io.BytesIO(content)) as stream:
                    for f, block in parse(stream):
                        rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), f.get("warc-segment-origin-id"), int(f.get("warc-segment-number", 0)), f.get("warc-segment-total-length"), block))
                        size += len(block)
                        if size > 1 << 24:
                            yield _typed(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _typed(rows, names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(records, RAW)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(total=pd.to_numeric(out["total"]).astype("Int64"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, uri, payload_digest, refers_to, payload, payload_bytes for each response and revisit in a folder of
    archives; other records (warcinfo, request, metadata ...) are passed over. An archive is read by one task and must be smaller than 2 GB, Spark's
    limit for one value. Records in segments are grouped by their origin, ordered by number and checked against the
    total length; only those are shuffled. Chunked framing is taken off. A revisit's payload is null; its
    payload_bytes are what its header says."""
    raw = raw_records(spark, path).where(F.col("type").isin("response", "revisit", "continuation"))
    kept = ["record_id", "type", "uri", "payload_digest", "refers_to"]
    schema = "record_id string, type string, uri string, payload_digest string, refers_to string, payload binary, payload_bytes long"

    def payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, stated_length(b)) if t == "revisit" else (p := http_payload(b), len(p)) for t, b in zip(batch["type"], batch["block"], strict=True)]
            yield batch[kept].assign(payload=[f[0] for f in found], payload_bytes=[f[1] for f in found])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [reassemble([(p["segment"], p["block"]) for p in parts], None if pd.isna(t) else int(t)) for parts, t in zip(batch["parts"], batch["total"], strict=True)]
            payloads = list(map(http_payload, blocks))
            yield batch[kept].assign(payload=payloads, payload_bytes=list(map(len, payloads)))

    whole = raw.where("segment = 0").select(*kept, "block").mapInPandas(payloads, schema)
    cut_up = raw.where("segment > 0").withColumn("origin", F.coalesce("origin", "record_id"))
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in kept]
    grouped = cut_up.groupBy("origin").agg(*first, F.max("total").alias("total"), F.collect_list(F.struct("segment", "block")).alias("parts"))
    return whole.unionByName(grouped.where("type IS NULL OR type = 'response'").select(*kept, "total", "parts").mapInPandas(joined, schema))


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, payload_bytes, payload_digest, record_type, refers_to: one
    row per row of pages, from archives that were written to folder and read back.

    A null html is an empty payload. Of equal payloads of at least 100 bytes the page with
    the smallest id is the response (all of them, if rows repeat that id), the others revisit it; a page without an id
    only revisits. A revisit's bytes and digest are what its header says of the full payload. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    raw = read_warc(spark, path)
    page = F.expr("nullif(split(record_id, ':')[2], '')").cast("long")
    return raw.select(
        page.alias("page_id"), "payload_bytes", F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", r"urn:page:(-?\d+)", 1).try_cast("long").alias("refers_to"),
    )

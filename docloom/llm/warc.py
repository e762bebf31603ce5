"""WARC archives: writing pages as records with revisits, and reading archives back.

Writing. A payload of ``min_revisit_bytes`` or more that several rows share is stored once, with
the smallest id; the others become revisit records that refer to it. A response holds an HTTP
message with chunked transfer framing. A block longer than ``segment_bytes`` is cut into a first
record and continuation records. Chunks are cut inside every occurrence of the record marker, so
that the marker occurs in an archive only where a record starts, and readers may split on it.

Reading. Continuation records are grouped by the identifier of their origin and ordered by segment
number, the total length is verified, the chunked framing is decoded, and the digest is compared.

Rows with a null payload have an empty one. Repeated rows give one record each; of equal payloads
with equal ids the first read is the response. A null id is kept, and is the last choice for a
response. Other columns are not archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"WARC/1.1"
_EOL = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_RECORDS = "record_id string, type string, refers_id string, digest string, payload_length long, segment int, origin_id string, total_length long, block binary, problem string"
_PAYLOADS = "record_id string, type string, refers_id string, digest string, payload_bytes long, payload binary, status string"


def chunked(payload: bytes, chunk_bytes: int = 8192) -> bytes:
    """The payload in chunked transfer framing, no chunk holding the record marker."""
    cuts = {*range(0, len(payload), chunk_bytes), len(payload)}
    at = payload.find(MARK)
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(MARK, at + 1)
    order = sorted(cuts)
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(order, order[1:], strict=False)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(block: bytes) -> bytes | None:
    """The payload of an HTTP message with chunked framing; None if the framing is broken."""
    at = block.find(b"\r\n\r\n") + 4
    if at < 4:
        return None
    parts = []
    while True:
        end = block.find(_EOL, at)
        if end < 0:
            return None
        try:
            n = int(block[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(parts)
        if block[end + 2 + n : end + 4 + n] != _EOL:
            return None
        parts.append(block[end + 2 : end + 2 + n])
        at = end + 4 + n


def _head(kind: str, record_id: str, length: int, **fields: object) -> bytes:
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "Content-Length": length} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    return MARK + _EOL + b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items()) + _EOL


def _record_id(page: object, row: int) -> str:
    return f"urn:page:{'' if page is None else quote(str(page), safe='')}:{row}"


def _page_of(record_id: str | None) -> str | None:
    return unquote(record_id.split(":")[2]) or None if record_id else None


def _records(segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                me = _record_id(r["id"], r["row"])
                about = {"WARC_Target_URI": r["url"] and quote(r["url"], safe=":/?#[]@!$&'()*+,;=%~-._"), "WARC_Payload_Digest": "sha256:" + r["digest"], "X_Payload_Length": r["n"]}
                if r["first_row"] is not None:
                    out.append(_head("revisit", me, 0, **about, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{_record_id(r['first_id'], r['first_row'])}>"))
                    continue
                block = _HTTP + chunked(r["payload"])
                if len(block) <= segment_bytes:
                    out.append(_head("response", me, len(block), **about) + block)
                    continue
                starts = range(0, len(block), segment_bytes)
                for k, a in enumerate(starts, 1):
                    part = block[a : a + segment_bytes]
                    more = {"WARC_Segment_Number": k, "WARC_Segment_Total_Length": len(block) if k == len(starts) else None}
                    out.append((_head("response", me, len(part), **about, **more) if k == 1 else _head("continuation", f"{me}:{k}", len(part), WARC_Segment_Origin_ID=f"<{me}>", **more)) + part)
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    return write


def write_warc(df: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", segment_bytes: int = 16384, min_revisit_bytes: int = 100, records_per_file: int = 20000) -> None:
    """Writes a record per row of ``df`` (more for long ones) to gzipped archives under ``path``.

    ``df`` must be a stored table, which gives its rows in the same order each time it is read: rows
    are told apart by their place. Write the result of a shuffle to a table first.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload").cast("long")})
    long = base.select("row", "id", "digest", "n").where(F.col("n") >= min_revisit_bytes)
    # one small row for each digest before anything is joined; a hot digest is then split by the skew join
    first = long.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("f"), F.count("*").alias("c")).where("c > 1")
    copies = long.join(first, "digest").where("row <> f.row").select("row", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"))
    rows = base.join(copies, "row", "left")
    records = rows.mapInArrow(_records(segment_bytes), "record binary")
    # the text writer ends each line with what ends a record; bytes pass through the cast unchanged
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for raw in batch.column(0).to_pylist():
            head, found, rest = raw.partition(b"\r\n\r\n")
            f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
            n = int(f["content-length"]) if f.get("content-length", "").isdigit() else -1
            problem = "no header" if not found or n < 0 else "short block" if len(rest) < n else None
            ident = lambda k: f[k].strip("<>") if k in f else None  # noqa: B023, E731
            number = lambda k: int(f[k]) if f.get(k, "").isdigit() else None  # noqa: B023, E731
            digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
            rows.append((ident("warc-record-id"), f.get("warc-type"), ident("warc-refers-to"), digest, number("x-payload-length"), number("warc-segment-number"), ident("warc-segment-origin-id"), number("warc-segment-total-length"), rest[: max(n, 0)], problem))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that ``write_warc`` made, split on the record marker."""
    lines = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where("value <> ''")
    return lines.select(F.col("value").cast("binary").alias("raw")).mapInArrow(_parse, _RECORDS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _PAYLOADS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["type"] == "revisit":
                rows.append((r["record_id"], r["type"], r["refers_id"], r["digest"], r["payload_length"], None, r["problem"] or "ok"))
                continue
            block, payload = b"".join(r["blocks"]), None
            status = r["problem"]
            if not status and r["segments"] and r["segments"] != list(range(1, len(r["segments"]) + 1)):
                status = "missing segment"
            if not status and r["segments"] and r["total_length"] != len(block):
                status = "wrong length"
            if not status:
                payload = unchunked(block)
                status = "bad framing" if payload is None else None
            digest = payload is not None and hashlib.sha256(payload).hexdigest()
            if not status and r["digest"] and digest != r["digest"]:
                status = "bad digest"
            rows.append((r["record_id"], r["type"], None, digest or r["digest"], None if payload is None else len(payload), payload, status or "ok"))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: its full payload, and ``ok`` or what is wrong with it.

    Only segmented records are shuffled, by their origin; a group is one record's segments.
    A segment that occurs twice with the same bytes counts once.
    """
    alone = records.where(F.col("segment").isNull()).select("record_id", "type", "refers_id", "digest", "payload_length", "total_length", F.array("block").alias("blocks"), F.lit(None).cast("array<int>").alias("segments"), "problem")
    cut = records.where(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = (
        cut.groupBy("origin")
        .agg(first("type"), first("refers_id"), first("digest"), first("payload_length"), F.max("total_length").alias("total_length"), F.max("problem").alias("problem"), F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"))
        .select(F.col("origin").alias("record_id"), "type", "refers_id", "digest", "payload_length", "total_length", F.col("parts.block").alias("blocks"), F.col("parts.segment").alias("segments"), "problem")
    )
    return alone.unionByName(joined).mapInArrow(_whole, _PAYLOADS)


def pages_of(payloads: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Payload rows with the ids of their pages."""
    page = lambda c: F.nullif(F.split(F.col(c), ":")[2], F.lit("")).cast(id_type)
    return payloads.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_id").alias("refers_to"), "status", "payload")

"""WARC archives: written per partition with an index of every record, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import map_batches, narrow, text_blocks
from paperloom.llm.storage import attempt_name, create, open_read
from paperloom.session import shared_folder
from paperloom.sources.sinks import materialise

INDEX = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, file string, offset bigint, length bigint"
)
GAP = 64 << 10
SPAN = 8 << 20
TASK_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"  # archives of the same pages are equal byte for byte
RECORD_ID = "<urn:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the response's HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload held in the record and the full payload's length as the HTTP header gives it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    return fields, payload, size


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def first_of_equal(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``id, url, html, digest, original``: the smallest id among pages of equal payload, null where the page
    itself is that one, has no id or fewer than ``least_bytes`` bytes.

    Payloads meet by digest as counts and minima combined before the shuffle; only digests of two or more pages
    go on to the join, where adaptive execution splits a digest that very many pages share.
    """
    rows = narrow(pages, id="page_id", url="url", html="html").withColumn(
        "digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    )
    sized = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    groups = materialise(
        rows.where(sized & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = materialise(
        rows.where(sized)
        .select("id", "digest")
        .join(groups, "digest")
        .where("id > original")
        .select("id", "digest", "original")
        .distinct()
    )
    return rows.join(later, ["id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """One record per page in one archive per partition; returns the folder and the index: page, URL, type, digest,
    file, offset and length of each record.

    A null html is an empty payload, a null url an empty address.  Equal payloads of at least ``least_bytes`` bytes
    are stored once, by the page of smallest id; the others are revisits.  Rows that repeat the first page's id are
    responses again; a row without an id is always a response.  An empty table gives an empty index.
    """
    folder = folder or shared_folder(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, at, name = None, 0, attempt_name(TaskContext.get().partitionId(), ".warc")
        for batch, _ in text_blocks(batches, "html"):
            if sink is None:
                sink = create(folder, name)
            out = []
            for row in batch.to_pylist():
                payload, url = (row["html"] or "").encode(), row["url"] or ""
                digest = sha1_base32(payload)
                data = record(row["id"], url, payload, digest, row["original"])
                sink.write(data)
                kind = "response" if row["original"] is None else "revisit"
                out.append(
                    (row["id"], url, kind, row["original"], digest, len(payload), name, at, len(data))
                )
                at += len(data)
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            columns[0], columns[3] = columns[0].cast(pa.int64()), columns[3].cast(pa.int64())
            names = [f.split()[0] for f in INDEX.split(", ")]
            yield pa.record_batch(columns, names)
        if sink is not None:
            sink.close()

    rows = first_of_equal(pages, least_bytes).drop("digest")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"), "html",
                       F.col("original").cast("bigint").alias("original"))
    return folder, materialise(map_batches(rows, write, INDEX))


def read_records(
    folder: str, index: DataFrame, gap: int = GAP, span: int = SPAN, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The records that ``index`` selects, from the archives.

    Index rows are brought into (file, offset) ranges, one for every ``task_bytes`` that are wanted, whatever the size of
    the index itself, and sorted; neighbours at most ``gap`` bytes apart are fetched
    by one read of at most ``span`` bytes (a longer record by itself).  Each payload is checked against its digest.
    Returns page_id, url, record_type, refers_to, payload_digest, payload_bytes and the payload (null for revisits).
    """

    def fetch(source: pa.NativeFile, run: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        start, end = run[0][0], max(o + n for o, n in run)
        source.seek(start)
        data = source.read(end - start)
        out = []
        for offset, length in run:
            fields, payload, size = parse_record(data[offset - start : offset - start + length])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = fields["WARC-Type"] == "revisit"
            if not revisit and (sha1_base32(payload) != digest or len(payload) != size):
                raise ValueError(f"damaged record at {offset}")
            out.append(
                {
                    "page_id": _page(fields["WARC-Record-ID"]),
                    "url": fields["WARC-Target-URI"],
                    "record_type": fields["WARC-Type"],
                    "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
                    "payload_digest": digest,
                    "payload_bytes": size,
                    "payload": None if revisit else payload,
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [("page_id", "int64"), ("url", "string"), ("record_type", "string"), ("refers_to", "int64"),
         ("payload_digest", "string"), ("payload_bytes", "int64"), ("payload", "binary")]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, run, end = None, None, [], 0
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):  # noqa: B905
                if file != name or offset - end > gap or offset + length - run[0][0] > span:
                    if run:
                        yield from fetch(source, run)
                    run = []
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, open_read(folder, file)
                run.append((offset, length))
                end = max(end, offset + length) if len(run) > 1 else offset + length
        if run:
            yield from fetch(source, run)

    wanted = index.agg(F.sum("length")).first()[0] or 0
    ranges = max(1, -(-wanted // task_bytes))
    sought = index.select("file", "offset", "length").repartitionByRange(ranges, "file", "offset")
    return map_batches(
        sought.sortWithinPartitions("file", "offset"),
        read,
        "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
        "payload_bytes bigint, payload binary",
    )

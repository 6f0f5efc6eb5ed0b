"""WARC archives, index first: every written record gives an index row (file, offset, length, url, digest), and
reads go through the index, as few sorted byte ranges that cover the selected records.

Which record holds a payload and which ones revisit it is decided on (page, digest) rows alone; a payload then moves once
at most. Archives are gzip members of one record each, in files of bounded size that a task
attempt names by itself, so that an attempt that is lost or run twice leaves nothing that the index points at.
Reads are dealt to tasks by summed bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import cut
from traceaudit.session import scratch_dir

LEAST_SHARED = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
RANGE_GAP = 64 << 10
#: Archive bytes that one task of a read takes, about; less where that leaves cores idle, down to one range.
READ_BYTES = 64 << 20
INDEX = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, file string, offset long, length long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages(page_id, url, html) with digest, payload_bytes, record_type and refers_to.

    Of equal payloads of at least `least` bytes the smallest page_id is the response and the others revisit it;
    smaller payloads are responses. A null html is an empty payload. Each row becomes one record: rows that repeat the smallest page_id are
    all responses, and a null page_id, which has no place in the order, revisits like any other (it is a response where all ids are null).

    The decision is made on (page_id, digest) rows. What joins the payloads is the table of revisits alone, by both columns, so that a
    payload of very many pages is no hot key and each payload moves once at most.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest, size = F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    keyed = pages.select("page_id", digest, size).filter(F.col("payload_bytes") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = keyed.drop("n").join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = cut(revisits, "warc-revisits").select(F.col("digest").alias("its_digest"), F.col("page_id").alias("its_id"), "refers_to")  # its size is then known: broadcast only if small
    known = pages.select("page_id", "url", payload.alias("payload"), digest, size)
    joined = known.join(revisits, (F.col("digest") == F.col("its_digest")) & F.col("page_id").eqNullSafe(F.col("its_id")), "left")
    revisit = F.col("refers_to").isNotNull()
    return joined.select(
        "page_id",
        "url",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "refers_to",
        "digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record_bytes(page_id, url, kind, refers_to, digest, payload) -> bytes:
    """One WARC/1.1 record as a gzip member. A line break in a url is percent-encoded; a null url leaves out the target line, and a null page_id has an empty id."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + deflate.flush()


def parse_record(data: bytes) -> tuple:
    """(page_id, url, kind, refers_to, digest, payload) of one gzip member."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    ident = lambda s: int(s[10:-1]) if len(s) > 11 else None
    url = fields.get("WARC-Target-URI")
    return (
        ident(fields["WARC-Record-ID"]),
        url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        fields["WARC-Type"],
        ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        rest[: int(fields["Content-Length"])],
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of plan_records to WARC files in folder; returns the index, itself kept as a table.

    An empty input writes no file. A file is closed once it holds file_bytes, so a task writes as many as it needs.
    """

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = record_bytes(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], r["payload"] or b"")
                    out.write(data)
                    rows.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], r["payload_bytes"], name, at, len(data)))
                    at += len(data)
                    if at >= file_bytes:
                        out.close()
                        out = None
                yield batch_of(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return cut(records.mapInArrow(write, INDEX), "warc-index")


def byte_ranges(index: DataFrame, most: int = RANGE_BYTES, gap: int = RANGE_GAP) -> DataFrame:
    """Coalesce the selected records of an index into sorted byte ranges: file, start, stop, spans(offset, length).

    Within a file, records in offset order share a range while the gap between them is at most `gap` bytes
    and they begin in the same `most` bytes of the file. Files are bounded, so each window is too.
    """
    w = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(w)
    fresh = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(w) / most))
    return (
        index.select("file", "offset", "length", fresh.cast("int").alias("fresh"))
        .withColumn("part", F.sum("fresh").over(w))
        .groupBy("file", "part")
        .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans"))
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index (or any selection of its rows) points at, read range by range; a revisit has an empty payload, and
    payload_bytes and payload_digest are those of what the record itself holds (its digest line for a revisit)."""

    def read(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['file']}") as f:
                    data = f.read_at(r["stop"] - r["start"], r["start"])
                rows = []
                for span in r["spans"]:
                    at = span["offset"] - r["start"]
                    page, url, kind, refers, digest, payload = parse_record(data[at : at + span["length"]])
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record of page {page} in {r['file']} does not match its digest")
                    rows.append((page, url, kind, refers, len(payload), digest, payload))
                yield batch_of(rows, READ)

    size = index.agg(F.sum("length")).first()[0] or 0
    spread = max(1, -(-size // READ_BYTES), min(-(-size // RANGE_BYTES), index.sparkSession.sparkContext.defaultParallelism))
    return byte_ranges(index).repartition(spread, "file", "part").mapInArrow(read, READ)


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload_bytes of the response that it refers to, found by id and digest. records: read_records without payload; none is repeated."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("held")).agg(F.max("payload_bytes").alias("target_bytes"))
    wanted = records.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("target"), F.col("payload_digest").alias("held")).distinct()
    sizes = sizes.join(wanted, ["target", "held"])
    found = records.join(sizes, (F.col("refers_to") == F.col("target")) & (F.col("payload_digest") == F.col("held")), "left")
    return found.withColumn("payload_bytes", F.coalesce("target_bytes", "payload_bytes")).drop("target", "held", "target_bytes")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through the index."""
    folder = scratch_dir(spark, "warc")
    index = write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    back = cut(read_records(index, folder).drop("payload", "url"), "warc-read")
    return resolve_revisits(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

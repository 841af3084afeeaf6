"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Writing gives one archive a task and returns an index row a record: file, offset,
length, url and digest. Each record is its own gzip member, so any range of
whole records can be read alone. The index is written first, as a table; only
files it names count, so a task that is run again leaves at most an unused file.
Reading sorts the selected index rows by file and offset and joins ranges that
lie close into one read.

Rows: a null payload counts as empty. Records with equal payloads of at least
``revisit_from`` bytes: the largest id is the response and the others revisit it;
rows with the same id and payload stand each for themselves. A null url is
written as an empty one.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 1000
COALESCE_GAP = 64 << 10
COALESCE_MAX = 4 << 20
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 128 << 20  # of archives a reading task takes at most, in the mean
SALTS = 16  # tasks that the records of one payload are dealt to
ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string, refers_to bigint"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds no payload but its digest and length."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/octet-stream",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    body = b"" if revisit else payload
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return b"".join((packer.compress("\r\n".join(head).encode() + b"\r\n\r\n"), packer.compress(body), packer.compress(b"\r\n\r\n"), packer.flush()))


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return fields, rest[:length]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def decide(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, digest, refers_to: which records revisit which.

    The payload is dealt out once, by digest and salt, and meets the table of
    repeated payloads, one small row each and salt.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keeper = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(keeper.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when((F.octet_length("payload") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records below ``folder`` (a place all executors reach) and return their index, read back from its table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(f"{folder}/archives")
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = write_record(page_id, url, payload, digest, refers_to)
                out.write(member)
                rows.append((page_id, name, at, len(member), url, digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            columns = list(zip(*rows)) if rows else [()] * 8
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        if out is not None:
            out.close()

    spark = records.sparkSession
    records.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_selected(index: DataFrame, folder: str, gap: int = COALESCE_GAP, most: int = COALESCE_MAX) -> DataFrame:
    """Read the index's records: page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives have them."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(f"{folder}/archives")
        held: list[tuple[str, int, int]] = []
        opened, name = None, ""

        def fetch() -> Iterator[tuple]:
            nonlocal opened, name
            file, start, _ = held[0]
            stop = max(o + n for _, o, n in held)
            if file != name:
                if opened is not None:
                    opened.close()
                opened, name = store.open_input_file(f"{root}/{file}"), file
            data = opened.read_at(stop - start, start)
            for _, o, n in held:
                fields, body = read_record(data[o - start : o - start + n])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    digest, size = hashlib.sha1(body).hexdigest(), len(body)
                    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
                else:
                    size = int(fields["X-Payload-Length"])
                yield number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To"))
            held.clear()

        def give(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if held and (file != held[0][0] or offset - (held[-1][1] + held[-1][2]) > gap or offset + length - held[0][1] > most):
                    rows += fetch()
                held.append((file, offset, length))
            yield give(rows)
        if held:
            yield give(list(fetch()))
        if opened is not None:
            opened.close()

    block = F.floor(F.col("offset") / most)  # a file's records are dealt out by stretches, so a large archive has many readers
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-total // most)), 1)
    spread = index.select("file", "offset", "length", block.alias("block")).repartition(tasks, F.col("file"), F.col("block")).sortWithinPartitions("file", "offset").drop("block")
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    return read_selected(write_archives(decide(pages), folder), folder)

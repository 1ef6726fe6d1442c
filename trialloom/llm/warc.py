"""WARC archives with per-record Zstandard frames and an embedded dictionary."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from base64 import b32decode, b32encode

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch, delete

#: Fixed values of the format: first bytes of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3


def record_urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has no block; its payload's size stays in a field of its own."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_urn(page_id, digest)),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = b"" if revisit else payload
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's block does not end where its length says")
    return fields, rest[:n]


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the archive, at most SAMPLE_BYTES; b"" if they are too few."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[: 1 << 17] for r in records[::step]]
    if len(samples) < 8 or sum(map(len, samples)) < 1 << 14:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""  # samples too alike or too short


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary in a leading skippable frame, then one frame for each record."""
    out = io.BytesIO()
    dictionary = train_dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **use)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def read_archive(data: bytes):
    """Yield the records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) if size else b""
    use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    rest, at = memoryview(data), 8 + size
    press = zstandard.ZstdDecompressor(**use)
    while at < len(data):
        one = press.decompressobj()
        yield one.decompress(rest[at:])
        at = len(data) - len(one.unused_data)


def mark_revisits(pages: DataFrame, scratch: Scratch, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = scratch.table(first.select("digest", "kept"), "kept")
    joined = base.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` to archives in ``folder``; rows (file, records).

    The folder must be one that all executors share. A task holds one archive's
    records at most. An archive appears under its name only when it is whole, so
    a task that is lost or run twice leaves no partial or double archive among
    the files returned.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        context = TaskContext.get()
        held, size, part = [], 0, 0

        def flush():
            nonlocal held, size, part
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{part:04d}.warc.zst"
            with fs.open_output_stream(f"{root}/.{name}.tmp", compression=None) as f:
                f.write(write_archive(held))
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(held)], pa.int64())})
            held, size, part = [], 0, part + 1
            return out

        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                for r in batch.slice(s, 64).to_pylist():
                    held.append(warc_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield flush()
        if held:
            yield flush()

    return pages.mapInArrow(run, "file string, records long")


def read_warc(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of every record: page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to, block.

    A response's digest and size are computed from its block and checked
    against the header; a revisit's come from its header.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for record in read_archive(data.as_buffer().to_pybytes()):
                    h, block = parse_record(record)
                    kind, size = h["WARC-Type"], int(h["X-Payload-Length"])
                    digest = _hex(h["WARC-Payload-Digest"])
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    rows.append({"page_id": page and int(page), "url": h.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": refers and int(refers), "block": block})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(paths)
    return files.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")


def _hex(digest: str) -> str:
    return b32decode(digest.removeprefix("sha1:")).hex()


def archive_pages(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to WARC archives in the shared folder and read them back (see ``read_warc``).

    Of records with equal payloads of at least ``least`` bytes that with the
    largest page_id is the response and the others revisit it; all smaller ones
    are responses. A null html is an empty payload. A null page_id counts as
    smallest: such a row revisits the group's response, or is a response if the
    group has no ids. Rows repeated with the largest page_id are responses each.
    A null url leaves the record without a target; line ends in a url are
    percent-encoded. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    marked = mark_revisits(pages, scratch, least, id_col, url_col, html_col)
    files = scratch.table(write_warc(marked, folder), "files")
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")
    # attempts that were run twice leave files that no row names
    names = files.select("file").distinct()
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path")
    extra = listed.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(names, "file", "left_anti")
    for r in extra.toLocalIterator():
        delete(spark, r.path)
    return read_warc(spark, folder)

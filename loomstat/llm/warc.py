"""WARC archives with a Zstandard dictionary, written and read back.

Each task trains a dictionary on records of its own, writes it as the leading skippable frame of
its archive, and then one Zstandard frame per record, compressed with that dictionary, so any
record can be read alone. Archives hold about ``archive_bytes`` of payload and are written through
the file system that the folder's address names; a task that runs again writes the same names.

Equal payloads of at least ``revisit_bytes`` are stored once, with the largest id; the others
become revisit records, which carry the digest and length of the payload and refer to that id.

Defined cases: a null payload is empty; a null id is written without an id and read as null, and
it is the response only if all equal payloads have null ids; rows that repeat the largest id are
all responses; an empty table gives no archive and no rows. Payloads may have any length. Columns
other than id, address and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

MAGIC = 0x184D2A5D          # of the skippable frame that holds the dictionary
SCHEMA = ("id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
          "payload_digest string, payload binary, archive string, offset bigint")


def with_revisits(pages: DataFrame, key: str, payload: str, revisit_bytes: int = 1000) -> DataFrame:
    """(id, url, payload, digest, response): response is the id of the stored record for revisits.
    Only digests and ids are merged, map-side first; large payloads never move for it."""
    digested = pages.withColumn("payload", F.coalesce(F.col(payload), F.lit("")).cast("binary")) \
        .select(F.col(key).cast("long").alias("id"), *[c for c in ("url",) if c in pages.columns], "payload") \
        .withColumn("digest", F.sha1("payload"))
    if "url" not in digested.columns:
        digested = digested.withColumn("url", F.lit(None).cast("string"))
    stored = (digested.filter(F.octet_length("payload") >= revisit_bytes)
              .groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("copies"))
              .filter("copies > 1").select("digest", "response"))
    return (digested.join(stored, "digest", "left")
            .withColumn("response", F.expr("case when not (id <=> response) then response end")))


def _record(row: dict) -> bytes:
    revisit = row["response"] is not None
    body = row["payload"]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n").encode()
    block = http if revisit else http + body
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    name = hashlib.sha1(f"{row['id']}|{row['url']}|{row['digest']}".encode()).hexdigest()
    uuid = f"{name[:8]}-{name[8:12]}-5{name[13:16]}-a{name[17:20]}-{name[20:32]}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid}>",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {''.join(row['url'].split())}")
    if row["id"] is not None:
        head.append(f"X-Record-Key: {row['id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Key: {row['response']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int, samples: int, sample_bytes: int) -> bytes:
    """A dictionary from evenly spaced records; empty where there is too little to train on. The
    sample only shapes the compression: every record is archived whole."""
    chosen = [r[:sample_bytes] for r in records[::max(1, len(records) // samples)]]
    if len(chosen) < 8 or sum(map(len, chosen)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, chosen)) // 8), chosen, k=256, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes], dictionary: bytes, level: int) -> bytes:
    """One archive: the skippable frame with the dictionary, then a frame per record."""
    out = [MAGIC.to_bytes(4, "little"), len(dictionary).to_bytes(4, "little"), dictionary]
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    coder = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    out += [coder.compress(r) for r in records]
    return b"".join(out)


def write_archives(rows: DataFrame, folder: str, dictionary_bytes: int = 32 * 1024, samples: int = 512,
                   sample_bytes: int = 16 * 1024, archive_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Archive the rows of ``with_revisits`` and return (archive, records, bytes) once each is written.
    Every archive is trained on up to ``samples`` of its own records."""
    place, base = fs.FileSystem.from_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names, counts, sizes, held, total = [], [], [], [], 0

        def name_of(number: int) -> str:
            return f"part-{part:06d}-{number:05d}.warc.zst"

        def flush():
            name = name_of(len(names))
            body = pack(held, train(held, dictionary_bytes, samples, sample_bytes), level)
            with place.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(body)
            names.append(name)
            counts.append(len(held))
            sizes.append(len(body))

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    held.append(_record(row))
                    total += len(held[-1])
                    if total >= archive_bytes:
                        flush()
                        held, total = [], 0
        if held:
            flush()
        # an earlier run of this task may have written more archives
        left = len(names)
        while place.get_file_info(f"{base}/{name_of(left)}").type != fs.FileType.NotFound:
            place.delete_file(f"{base}/{name_of(left)}")
            left += 1
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()),
                                          pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    place.create_dir(base, recursive=True)
    return rows.select("id", "url", "payload", "digest", "response").mapInArrow(
        run, "archive string, records bigint, bytes bigint")


def unpack(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the dictionary."""
    if int.from_bytes(body[:4], "little") != MAGIC:
        raise ValueError("not an archive with a leading dictionary frame")
    size = int.from_bytes(body[4:8], "little")
    trained = zstandard.ZstdCompressionDict(body[8:8 + size]) if size else None
    at, view = 8 + size, memoryview(body)
    while at < len(body):
        frame = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        out = io.BytesIO()
        stop = at
        while not frame.eof:
            chunk = view[stop:stop + (1 << 16)]
            if not len(chunk):
                raise ValueError("a record is cut off")
            out.write(frame.decompress(chunk))
            stop += len(chunk)
        yield at, out.getvalue()
        at = stop - len(frame.unused_data)


def _parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    digest = stated if revisit else hashlib.sha1(body).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    key = fields.get("X-Record-Key")
    return {"id": int(key) if key is not None else None, "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Refers-To-Key"]) if revisit else None,
            "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else body}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, with its archive and the offset of its frame. Digests of stored payloads
    are computed again and compared with the stated ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                rows, held = [], 0
                for at, record in unpack(batch.column(1)[i].as_py()):
                    rows.append(_parse(record) | {"archive": name, "offset": at})
                    held += len(record)
                    if held > 2 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                       ("archive", pa.string()), ("offset", pa.int64())])
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
            .select("path", "content").mapInArrow(run, SCHEMA))

"""Dictionary-compressed WARC archives.

Every task writes the pages of its partition to archives of bounded size. For each
archive a Zstandard dictionary is built from its records and put in front in a
skippable frame; every record is a frame of its own, compressed with that dictionary,
so a reader needs nothing but the file. Pages whose payload another page has too are
written as revisits without payload: of pages with equal payloads, the one with the
largest id is the response.

Archives get names of their own per attempt; a manifest written at the end lists those
of the attempts that counted, so files of lost executors are never read. All files are
in a folder that executors and driver share.

A null payload is an empty one. Pages with equal payload and equal id are all
responses if that id is the largest, as nothing tells them apart; null ids are smaller
than any other. A null url is left out of the record. An empty table gives an empty
manifest and no archives. Payloads of any length are one record each.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions.reliability import ensure_checkpoint_dir, small_side
from leadlake.llm.ship import ship_code

#: Fixed values of the format: the skippable frame's magic number that marks a dictionary, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: A dictionary's bytes, and the bytes of records, evenly spread over the archive, that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
LEVEL = 3

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
FIELDS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers_to is None else _urn(refers_to)),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to),
        ("Payload-Length", len(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from an archive's records; their first bytes themselves if there are too few to learn from."""
    share = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[: 16 << 10] for r in records[::share]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    learnt = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=True)
    head = learnt.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(head)), head, *map(packer.compress, records)])


def records_of(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of an archive, read as a stream."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    stream = io.BufferedReader(unpacker.stream_reader(source, read_across_frames=True), 1 << 20)
    while stream.readline():
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        yield fields, block


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_references(pages: DataFrame) -> DataFrame:
    """Add ``refers_to``: the id of the response, for pages that are revisits; null for responses.

    Ids are compared per payload digest and length. Only payloads that come more than once
    are looked up; one with a third of all pages is one row there.
    """
    key = [F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("_sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("_size")]
    told = pages.select(*key, "page_id").groupBy("_sha", "_size").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    again = small_side(told.where("_n > 1 and _last is not null").drop("_n"))
    named = pages.select("*", *key).join(again, ["_sha", "_size"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return named.withColumn("refers_to", F.when(revisit, F.col("_last"))).drop("_sha", "_size", "_last")


def write_archives(pages: DataFrame, folder: str, date: str = "2001-08-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) to archives below ``folder`` and return their stored manifest."""
    ship_code(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done: list[tuple[str, int, int]] = []

        def close(records: list[bytes]) -> None:
            data, name = archive(records), f"{stem}-{len(done):04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            done.append((f"{folder}/{name}", len(records), len(data)))

        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "html", "refers_to")], strict=True):
                held.append(record(*[v.as_py() for v in row], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close(held)
                    held, size = [], 0
        if held:
            close(held)
        columns = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], list(MANIFEST.names))

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    told = with_references(pages.select("page_id", "url", "html")).mapInArrow(write, MANIFEST)
    told.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the archives of a manifest; digests of responses are checked.

    Columns are ``FIELDS``; html only with ``payload``, and null for revisits.
    """
    ship_code(manifest.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()][: None if payload else -1]
    names = list(FIELDS[: len(kinds)])

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        body = block.partition(b"\r\n\r\n")[2]
        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
        ids = [int(fields[f]) if f in fields else None for f in ("Page-ID", "Refers-To-Page-ID")]
        text = body.decode() if payload and kind == "response" else None
        return ids[0], fields.get("WARC-Target-URI"), kind, int(fields["Payload-Length"]), digest, ids[1], text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[: len(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column("path"):
                store, at = _open(path.as_py())
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as source:
                    for fields, block in records_of(source):
                        rows.append(row(fields, block))
                        size += len(block)
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    kind = {"int64": "long", "string": "string"}
    schema = ", ".join(f"{n} {kind[str(t)]}" for n, t in zip(names, kinds, strict=True))
    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(read, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"

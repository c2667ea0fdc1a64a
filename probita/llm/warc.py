"""Zstandard web archives: one frame a record, the dictionary in a leading skippable frame.

Archives are real files below a folder that every executor can reach; they are written with Arrow's file systems, under
a name that carries the task attempt, and a manifest table names those of attempts that were committed. They are read
back with Spark's binary file source, so that a folder in any store it knows can be read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records (not compressed) after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: The dictionary of an archive is trained on the beginnings of its first records: so many, so many bytes of each.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 32 << 10, 200, 4 << 10
#: Records carry no capture time in the source tables.
DATE = "2000-01-01T00:00:00Z"

MANIFEST_SCHEMA = "name string, records bigint, bytes bigint"
RECORD_SCHEMA = ("archive string, frame int, offset bigint, record_id string, record_type string, uri string, date string, refers_to string, "
                 "payload_bytes bigint, payload_digest string, payload binary, problem string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response, or a revisit of ``refers_to`` whose block ends with the HTTP header; either names the full payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", _clean(uri or "about:blank")), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    block = http if refers_to is not None else http + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The records as an archive; without enough of them to train a dictionary there is none."""
    samples = [r[:SAMPLE_BYTES] for r in records[:SAMPLES]]
    dictionary = None
    if len(samples) >= 8:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=64, d=8)
        except zstandard.ZstdError:  # too little in them that repeats
            dictionary = None
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    lead = b""
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    return lead + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of every frame, from frame and block headers alone. ValueError where the bytes break off."""
    at = 0
    while at < len(data):
        start = at
        if at + 8 > len(data):
            raise ValueError(f"truncated frame at {start}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            at += 8 + size
        elif magic == FRAME:
            flags = data[at + 4]
            single = flags >> 5 & 1
            at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                if at + 3 > len(data):
                    raise ValueError(f"truncated frame at {start}")
                header = int.from_bytes(data[at:at + 3], "little")
                last, kind, length = header & 1, header >> 1 & 3, header >> 3
                at += 3 + (1 if kind == 1 else length)
            at += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no frame at {start}")
        if at > len(data):
            raise ValueError(f"truncated frame at {start}")
        yield magic, start, at


def parse(data: bytes) -> dict:
    """Fields of one record, with what is wrong with it under ``problem`` (None: nothing)."""
    head, separator, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    out = {"record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
           "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "payload_bytes": None, "payload_digest": None, "payload": None, "problem": None}
    missing = [n for n in REQUIRED if n not in fields]
    if not separator or lines[0] not in VERSIONS:
        return out | {"problem": "no record header"}
    if missing:
        return out | {"problem": f"missing {', '.join(missing)}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"problem": "content length differs"}
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, separator, payload = rest[:-4].partition(b"\r\n\r\n")
    lengths = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    if out["record_type"] not in ("response", "revisit"):
        return out
    if not separator or not lengths or not lengths[0].isdigit():
        return out | {"problem": "no payload header"}
    out |= {"payload_bytes": int(lengths[0]), "payload_digest": said}
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"]:
            return out | {"problem": "payload length differs"}
        digest = base32_sha1(payload)
        if said not in (None, digest):
            return out | {"problem": "payload digest differs"}
        out |= {"payload": payload, "payload_digest": digest}
    elif out["refers_to"] is None:
        return out | {"problem": "revisit refers to nothing"}
    return out


def records(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(frame number, offset, fields) of an archive's records. What can't be read is a record with a problem, and broken bytes end the archive."""
    reader, number = zstandard.ZstdDecompressor(), 0
    try:
        for number, (magic, start, end) in enumerate(frames(data)):  # noqa: B007
            if magic == DICTIONARY_FRAME and start == 0:
                packed = data[8:end]
                plain = packed if packed[:4] == DICTIONARY_MAGIC else zstandard.ZstdDecompressor().decompressobj().decompress(packed)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
            elif magic == FRAME:
                try:
                    fields = parse(reader.decompressobj().decompress(data[start:end]))
                except zstandard.ZstdError as error:
                    fields = parse(b"") | {"problem": f"frame: {error}"}
                yield number, start, fields
    except (ValueError, IndexError, struct.error, zstandard.ZstdError) as error:
        yield number + 1, len(data), parse(b"") | {"problem": str(error) or "truncated frame"}


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row below ``path`` and returns the manifest (also kept in ``path``/_manifest).

    Of rows with equal payloads (a NULL payload is an empty one) those with the largest id are responses, the others
    revisits that refer to it. Rows that repeat the largest id are responses each; if all ids of a payload are NULL, so
    are they. NULL addresses become ``about:blank``, line breaks in them are escaped. Only payloads that stand more than
    once are joined, by their digest, so nothing of the text is shuffled unless very many do; a payload in a third of
    all rows is then split by the engine's skew join. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(uri_column).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    narrow.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last").write.parquet(f"{path}/_repeated")
    linked = narrow.join(spark.read.parquet(f"{path}/_repeated"), "sha", "left").select(
        "id", "uri", "payload", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")).alias("refers"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        held, size, made = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"archive-{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst"
            data = archive(held)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["name", "records", "bytes"])

        for part in parts:
            for at in range(part.num_rows):
                page, uri, payload, refers = (part.column(i)[at].as_py() for i in range(4))
                held.append(record(f"urn:x-page:{page}", uri, payload, None if refers is None else f"urn:x-page:{refers}"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, made = [], 0, made + 1
        if held:
            yield close()

    linked.mapInArrow(batches, MANIFEST_SCHEMA).write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """A row for every record of the archives below ``path``, or of those that the manifest names; ``payload`` NULL if not asked for.

    ``problem`` says what is wrong with a header or a length; such rows are returned, not dropped. A dictionary is loaded
    from the leading skippable frame if there is one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if manifest is not None:
        files = files.join(manifest.select(F.col("name").alias("archive")), "archive", "left_semi")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"archive": pa.string(), "frame": pa.int32(), "offset": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "uri": pa.string(), "date": pa.string(),
                 "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "problem": pa.string()}
        for part in parts:
            for name, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                rows, size = [], 0
                for frame, offset, fields in records(content.as_py()):
                    if not payload:
                        fields["payload"] = None
                    rows.append({"archive": name, "frame": frame, "offset": offset} | fields)
                    size += len(fields["payload"] or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.mapInArrow(batches, RECORD_SCHEMA)

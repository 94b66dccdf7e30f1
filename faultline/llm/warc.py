"""Web archives: one Zstandard frame per record, with a dictionary built from the records in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.llm.common import rows_of, shared_file, staged, text_bytes

# Fixed values of the archive format.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

REVISIT_BYTES = 100
LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
# Records that the dictionary is built from, and the most bytes of each.
SAMPLES = 1000
SAMPLE_BYTES = 16 * 1024


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None) -> bytes:
    """A response record, or, given the page it repeats, a revisit record that keeps only the headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first_id is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if first_id is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(first_id)),
            ("X-Refers-To-Page-Id", str(first_id)),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises if it is cut short or its block differs from its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {head[:80]!r}")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' own content where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def repeated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``payload``, ``digest``, ``refers_to``): the page whose payload a row repeats, if any.

    Only digests that occur more than once come back to the pages, each with its smallest id.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    sizable = rows.filter(F.length("payload") >= REVISIT_BYTES)
    firsts = sizable.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("digest", "first_id")
    differs = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", differs.alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages``; (``page_id``, ``path``, ``at``, ``size``: the record's frame in its file) per row.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, that with the smallest id is a response and the others
    revisit it; smaller payloads are all responses. Missing html is an empty payload, a missing url an empty address.
    Rows without an id revisit like others and are never revisited if one with an id has the payload; rows that repeat
    the smallest id are all responses. No rows give no archive. One file per task, named after its attempt.
    """
    folder = stage_path(pages.sparkSession, "warc")
    rows = repeated(pages, id_col, url_col, html_col)
    some = pages.select(
        F.xxhash64(F.col(id_col)).alias("draw"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.substring(text_bytes(html_col), 1, SAMPLE_BYTES).alias("payload"),
    )
    # Only the lowest share of the hash range is sorted, so what the tasks send for it does not grow with their number.
    share = min(1.0, 2.0 * SAMPLES / max(1, pages.count()))
    some = some.filter((F.col("draw").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) <= share)
    drawn = some.orderBy("draw", "page_id").limit(SAMPLES).select("page_id", "url", "payload").collect()
    samples = [record(i, u, bytes(p), hashlib.sha256(p).hexdigest(), None) for i, u, p in drawn]
    dictionary = build_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True)
        sink = None
        for batch in batches:
            places = []
            for row in rows_of([batch]):
                if sink is None:
                    store, inner = shared_file(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(inner, compression=None)
                    sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = packer.compress(record(*row))
                places.append((sink.tell(), len(frame)))
                sink.write(frame)
            if places:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([path] * len(places)),
                        pa.array([at for at, _ in places], pa.int64()),
                        pa.array([size for _, size in places], pa.int64()),
                    ],
                    names=["page_id", "path", "at", "size"],
                )
        if sink is not None:
            sink.close()

    return staged(rows.mapInArrow(run, "page_id long, path string, at long, size long"), "warc-index")


class ArchiveReader:
    """Records of one archive, with the dictionary found in the archive itself."""

    def __init__(self, path: str):
        store, inner = shared_file(path)
        self.file = store.open_input_file(inner)
        magic, size = struct.unpack("<II", self.file.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(self.file.read(size)))

    def record_at(self, at: int, size: int) -> tuple[dict[str, str], bytes]:
        self.file.seek(at)
        return parsed(self.unpacker.decompress(self.file.read(size)))

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records in file order, without an index."""
        data = self.file.read()
        while data:
            frame = self.unpacker.decompressobj()
            found = frame.decompress(data)
            yield parsed(found)
            data = frame.unused_data

    def close(self) -> None:
        self.file.close()


def described(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page, payload size, payload digest, type and page referred to, from a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (size != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x) if x else None
    return number(fields["X-Page-Id"]), size, digest, kind, number(fields.get("X-Refers-To-Page-Id"))


def read_archives(index: DataFrame) -> DataFrame:
    """(``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``) of each record, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            found = []
            for path, at, size in rows_of([batch.select(["path", "at", "size"])]):
                if path != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened = ArchiveReader(path), path
                found.append(described(*reader.record_at(at, size)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return index.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )

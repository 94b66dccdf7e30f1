"""Token ids of documents as Arrow files of equal-length sequences, with random access to every document."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.llm.common import rows_of, shared_file, staged, text_bytes

SEQUENCE = 1024
BATCH_SEQUENCES = 256
END_ID = 2
# Words whose ids a worker keeps. Once it has them, other words are encoded each time; after RENEW of those it starts anew.
KEPT_WORDS = 400_000
RENEW = 2_000_000
JOINED_WORDS = 512
_SIGNS = b".,:;!?%&*#$|"

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts for tokenizers that lower-case and drop white space, so that a text's ids are those of its words in turn.

    Words are cut at ASCII white space only, and signs at the end of a word, which the tokenizer never joins to letters,
    are looked up apart from it. Words of Latin letters skip the tokenizer's normalizer and its search for word parts, as
    nothing but lower case is left to do for them; all others, and texts with special tokens, go through it as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.closes = np.zeros(size, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closes[number] = token.endswith("</w>")
        self.ids: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.passed = 0

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def learn_letters(self, stems: list[bytes]) -> None:
        each = iter(stems)
        while part := list(islice(each, JOINED_WORDS)):
            text = b" ".join(part).decode().lower()
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = [0, *((np.flatnonzero(self.closes[ids]) + 1) * self.dtype.itemsize).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer does not close every word")
            data = ids.tobytes()
            self.stems.update((w, data[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))

    def learn(self, words: set[bytes]) -> None:
        split, fresh = [], set()
        for word in words:
            stem = word.rstrip(_SIGNS)
            text = stem.decode()
            if text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text):
                split.append((word, stem))
                if stem not in self.stems:
                    fresh.add(stem)
            else:
                self.ids[word] = self.whole(word)
        self.learn_letters(list(fresh))
        for word, stem in split:
            signs = word[len(stem) :]
            if signs not in self.stems:
                self.stems[signs] = self.whole(signs)
            self.ids[word] = self.stems[stem] + self.stems[signs]

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self.whole(text)
        words = text.lower().split()
        if new := {w for w in words if w not in self.ids}:
            self.learn(new)
        encoded = b"".join(map(self.ids.__getitem__, words))
        if len(self.ids) > KEPT_WORDS:
            self.passed += len(new)
            for word in new:
                del self.ids[word]
                self.stems.pop(word.rstrip(_SIGNS), None)
            if self.passed > RENEW:
                self.ids.clear()
                self.stems.clear()
                self.passed = 0
        return encoded


def schema(dtype: np.dtype, sequence: int) -> pa.Schema:
    value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


def record_batch(ids: np.ndarray, sequence: int) -> pa.RecordBatch:
    """Sequences of ``ids``, the last one filled up with masked zeros."""
    rows = -(-len(ids) // sequence)
    filled = np.zeros(rows * sequence, dtype=ids.dtype)
    filled[: len(ids)] = ids
    mask = np.arange(rows * sequence) < len(ids)
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), sequence) for x in (filled, mask)]
    return pa.RecordBatch.from_arrays(columns, schema=schema(ids.dtype, sequence))


class SequenceReader:
    """Random access to one file: batches have a known number of sequences, so an id's place follows from its number."""

    def __init__(self, path: str):
        store, inner = shared_file(path)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(inner) if local else store.open_input_file(inner)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.sequence, self.rows = int(meta[b"sequence"]), int(meta[b"batch_sequences"])
        self.at, self.ids, self.mask = -1, None, None

    def batch(self, number: int) -> tuple[np.ndarray, pa.Array]:
        if number != self.at:
            batch = self.file.get_batch(number)
            self.ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            self.mask = batch.column(1).flatten()
            self.at = number
        return self.ids, self.mask

    def ids_at(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The ``count`` ids from id ``first`` on, in pieces without copying."""
        size = self.sequence * self.rows
        while count > 0:
            ids, mask = self.batch(first // size)
            at = first % size
            piece = ids[at : at + count]
            if not mask.slice(at, len(piece)).true_count == len(piece):
                raise ValueError(f"masked ids between {first} and {first + len(piece)}")
            yield piece
            first, count = first + len(piece), count - len(piece)

    def close(self) -> None:
        self.source.close()


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    batch_sequences: int = BATCH_SEQUENCES,
    end_id: int = END_ID,
) -> DataFrame:
    """Write the ids of ``docs`` in ascending id order; (``shard``, ``path``, ``doc_id``, ``first``, ``n_tokens``) per row.

    Rows are range-partitioned by id; each task writes one Arrow file, in which documents, each closed by ``end_id``,
    fill sequences one after the other. ``first`` counts ids in the file. A file's name is unique to the attempt that
    wrote it, and the index names files of successful attempts only. Missing and empty texts give the end id alone. Rows
    without an id come first; rows of one id are ordered by text, so repeated rows are interchangeable. No rows give no
    file. A text is encoded whole.
    """
    folder = stage_path(docs.sparkSession, "sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.arrow"
        size = sequence * batch_sequences
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        item = encoder.dtype.itemsize
        meta = {"sequence": str(sequence), "batch_sequences": str(batch_sequences)}
        made = schema(encoder.dtype, sequence).with_metadata(meta)
        held, written, file, sink = bytearray(), 0, None, None
        for batch in batches:
            doc_ids, firsts, counts = batch.column(0), [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py()) + end
                firsts.append(written + len(held) // item)
                counts.append(len(ids) // item)
                held += ids
                while len(held) >= size * item:
                    if file is None:
                        store, inner = shared_file(path)
                        store.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = store.open_output_stream(inner, compression=None)
                        file = pa.ipc.new_file(sink, made)
                    part = np.frombuffer(bytes(held[: size * item]), dtype=encoder.dtype)
                    file.write_batch(record_batch(part, sequence))
                    del held[: size * item]
                    written += size
            if firsts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(firsts), pa.int64()),
                        pa.array([path] * len(firsts)),
                        doc_ids,
                        pa.array(firsts, pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["shard", "path", "doc_id", "first", "n_tokens"],
                )
        if held:
            if file is None:
                store, inner = shared_file(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(inner, compression=None)
                file = pa.ipc.new_file(sink, made)
            file.write_batch(record_batch(np.frombuffer(bytes(held), dtype=encoder.dtype), sequence))
        if file is not None:
            file.close()
            sink.close()

    body = text_bytes(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    ordered = rows.withColumn("tie", F.xxhash64("body")).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "body")
    return staged(
        ordered.mapInArrow(run, "shard long, path string, doc_id long, first long, n_tokens long"), "sequence-index"
    )


def read_sequences(index: DataFrame) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) per row of the index, from the files alone.

    ``start`` counts the ids of all documents before, over all files.
    """
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0).cast("long")).alias("shard_start"))
    placed = index.join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "path", "first"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            sums = []
            for path, first, count in rows_of([batch.select(["path", "first", "n_tokens"])]):
                if path != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened = SequenceReader(path), path
                crc = 0
                for ids in reader.ids_at(first, count):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "start", "n_tokens"]).columns, pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

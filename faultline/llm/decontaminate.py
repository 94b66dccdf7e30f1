"""Benchmark passages in training documents, found by binary search in suffix arrays of the training text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.llm.common import rows_of, shared_file, text_bytes

WINDOW_WORDS = 10
# Words whose suffixes are sorted together; a longer document is a shard of its own.
SHARD_WORDS = 500_000
WORD_BYTES = 6  # about, with the space; for cutting shards only
# Benchmark text that a task holds at once. A larger benchmark is searched in several such blocks.
BLOCK_BYTES = 2_000_000

# Everything but digits, letters and bytes of non-ASCII characters separates words; A-Z become a-z.
_KEEP = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20
    for x in range(256)
)


def named_first(items: Iterable[str | None]) -> list[str | None]:
    """Items in order; one null at the end stands for those without id."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class TestWindows:
    """The windows of benchmark items as rows of word ids. Id 0 is any word that the benchmark does not have."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW_WORDS):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item_id, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item_id)
        self.items = [named_first(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], dtype=np.int64)
        self.words = np.zeros((len(owners), window), dtype=np.int64)
        for row, ids in zip(self.words, owners, strict=True):
            row[: len(ids)] = ids


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``ids`` that begin with a known word, ordered by their first ``depth`` words at least.

    ``ids`` ends with 0. Ranks by one word are refined to two, four, ... words; nothing is known about words 0, which
    end every comparison, so suffixes that start there are left out.
    """
    rank = ids.astype(np.int64)
    known = np.flatnonzero(ids)
    reach = 1
    order = known[np.argsort(rank[known], kind="stable")]
    while reach < depth and len(known):
        behind = np.minimum(known + reach, len(ids) - 1)
        key = rank[known] * (int(rank.max()) + 1) + rank[behind]
        sort = np.argsort(key, kind="stable")
        order, key = known[sort], key[sort]
        fresh = np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))).cumsum()
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(order):
            break
    return order


def _bounds(ids: np.ndarray, order: np.ndarray, tests: TestWindows, upper: bool) -> np.ndarray:
    """Binary search of every test window: first suffix not below it, or above all that begin with it."""
    low = np.zeros(len(tests.words), dtype=np.int64)
    high = np.full(len(tests.words), len(order), dtype=np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        sign = np.zeros(len(low), dtype=np.int64)
        for k in range(tests.window):
            here = ids[np.minimum(at + k, len(ids) - 1)]
            undecided = (sign == 0) & (k < tests.lengths)
            sign = np.where(undecided, np.sign(here - tests.words[:, k]), sign)
        right = (sign <= 0) if upper else (sign < 0)
        low = np.where(open_ & right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def search_shard(texts: list[bytes], blocks: Iterable[TestWindows]) -> list[tuple[int, list[str | None], list[tuple[int, int]]]]:
    """Per text: number of words, ids of the items found, verbatim runs (first word, end)."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(x) for x in words], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # a 0 between documents
    edges = np.zeros(int(starts[-1]) + 2, dtype=np.int64)
    found: list[set[str | None]] = [set() for _ in texts]
    for tests in blocks:
        get = tests.vocabulary.get
        ids = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        for at, own in zip(starts.tolist(), words, strict=False):
            ids[at : at + len(own)] = [get(w, 0) for w in own]
        order = suffix_array(ids, tests.window)
        if not len(order) or not len(tests.words):
            continue
        low, high = _bounds(ids, order, tests, upper=False), _bounds(ids, order, tests, upper=True)
        for t in np.flatnonzero(high > low):
            at = order[low[t] : high[t]]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + tests.lengths[t], -1)
            for d in np.unique(np.searchsorted(starts, at, side="right") - 1):
                found[d].update(tests.items[t])
    hit = np.cumsum(edges) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in turns.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, side="right")) - 1
        runs[d].append((a - int(starts[d]), b - int(starts[d])))
    return [(int(n), named_first(items), own) for n, items, own in zip(lengths, found, runs, strict=True)]


def written_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Write the benchmark's items to the shared folder: files of at most ``block_bytes`` of text, or of one longer item.

    Tasks write the files, about one each, and return their paths; what a failed attempt wrote is not looked at.
    """
    folder = stage_path(benchmark.sparkSession, "benchmark")
    items = benchmark.filter(F.col(text_col).isNotNull())
    items = items.select(F.col(id_col).cast("string").alias("item"), text_bytes(text_col).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0

    def write(block: list[tuple[str | None, bytes]]) -> str:
        path = f"{folder}/block-{uuid.uuid4().hex}.parquet"
        store, inner = shared_file(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        columns = {"item": pa.array([x for x, _ in block], pa.string()), "body": pa.array([x for _, x in block], pa.binary())}
        pq.write_table(pa.table(columns), inner, filesystem=store)
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        block: list[tuple[str | None, bytes]] = []
        held = 0
        for item, body in rows_of(batches):
            if block and held + len(body) > block_bytes:
                paths.append(write(block))
                block, held = [], 0
            block.append((item, body))
            held += len(body)
        if block:
            paths.append(write(block))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    dealt = items.repartition(max(1, -(-int(total) // block_bytes)))
    return sorted(r.path for r in dealt.mapInArrow(run, "path string").collect())


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``longest_run``, ``runs``, ``contaminated``) per row.

    Each task sorts the suffixes of its documents in shards and binary-searches every window of the benchmark in them.
    ``runs`` are the verbatim matches as (first word, end); matches that touch are one run. An item shorter than a window
    is a window. Missing and empty texts have no words, items without words are never found, equal items are all
    named, and all items without id together are one null name at the end of ``items``. Repeated rows give repeated rows, no rows give none, an empty benchmark hits nothing. Tasks read the
    benchmark in files of ``block_bytes``, one at a time, so its size is not limited by their memory.
    """
    paths = written_blocks(benchmark, item_col, item_text_col, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, TestWindows] = {}

        def blocks() -> Iterator[TestWindows]:
            for path in paths:
                if path not in kept:
                    kept.clear()
                    store, inner = shared_file(path)
                    items = pq.read_table(inner, filesystem=store)
                    kept[path] = TestWindows(rows_of(items.to_batches()), window)
                yield kept[path]

        def searched(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
            rows = search_shard(texts, blocks())
            run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([items for _, items, _ in rows], pa.list_(pa.string())),
                    pa.array([[{"first": a, "end": b} for a, b in own] for _, _, own in rows], run_type),
                ],
                names=["doc_id", "n_words", "items", "runs"],
            )

        doc_ids, texts, held = [], [], 0
        for doc_id, text in rows_of(batches):
            if texts and held + len(text) > WORD_BYTES * shard_words:
                yield searched(doc_ids, texts)
                doc_ids, texts, held = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text)
        if texts:
            yield searched(doc_ids, texts)

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    found = body.mapInArrow(
        run, "doc_id long, n_words long, items array<string>, runs array<struct<first:long,end:long>>"
    )
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["first"])
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["end"] - r["first"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        longest.alias("longest_run"),
        "runs",
        (F.size("runs") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``) without the documents that hold a benchmark passage. Rows without an id stay."""
    found = contamination(docs.filter(F.col("doc_id").isNotNull()), benchmark)
    hit = found.filter("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)

"""Repeated byte strings of a corpus: suffix arrays by two-stage sorting over the passages that can repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import rows_of, staged, text_bytes

WINDOW = 400
# Bytes of the string that a window is filed under. Passages of a file that is too large for one task are filed again by
# the next, longer string; at the last a file holds equal windows only.
GRAMS = (64, 232, 358, 390, WINDOW)
# Windows cut at a time from a long text, and in one passage.
CHUNK = 1 << 19
PASSAGE_WINDOWS = 4096
# Bytes of passages whose suffixes are sorted together.
SORT_BYTES = 1 << 19
# Different passages of a file that is sorted in one task.
FILE_PASSAGES = 256

_WORD = 8
_POSITION = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each string of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(n, _STEP)
    powers[0] = 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * np.cumprod(powers))))
    back = np.full(n - width + 1, _BACK)
    back[0] = 1
    return _mixed((sums[width:] - sums[:-width]) * np.cumprod(back))


def passages(text: bytes, gram: int = GRAMS[0]) -> Iterator[tuple[int, int, int, int]]:
    """Cut all windows of a text into passages: (file, first window, windows, strings that named the file).

    A window is filed under the string of ``gram`` bytes in it with the smallest hash, the first of equals. So equal windows
    are in the same file, wherever they stand, and each window is in one passage: neighbours with the same file.
    """
    reach = WINDOW - gram + 1
    for at in range(0, len(text) - WINDOW + 1, CHUNK):
        data = np.frombuffer(text, dtype=np.uint8, offset=at, count=min(len(text) - at, CHUNK + WINDOW - 1))
        grams = rolling(data, gram)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(grams) - reach + 1], least[reach - span :])
        place = (least & _POSITION).astype(np.int64)
        file = grams[place]
        moved = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        same = np.concatenate(([False], file[moved][1:] == file[moved][:-1]))
        heads = np.flatnonzero(~same)
        firsts = moved[heads]
        ends = np.concatenate((firsts[1:], [len(place)]))
        names = np.diff(np.concatenate((heads, [len(moved)])))
        for first, end, key, named in zip(
            firsts.tolist(), ends.tolist(), file[firsts].view(np.int64).tolist(), names.tolist(), strict=True
        ):
            for part in range(first, end, PASSAGE_WINDOWS):
                yield key, at + part, min(PASSAGE_WINDOWS, end - part), named


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, with zeros behind the end."""
    padded = np.concatenate((data, np.zeros(_WORD, dtype=np.uint8))).astype(np.uint64)
    words = np.zeros(len(data), dtype=np.uint64)
    for k in range(_WORD):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    return words


def _rises(data: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than its successor; equal bytes follow the next different pair."""
    n = len(data)
    ends = np.concatenate((np.flatnonzero(data[1:] != data[:-1]), [n - 1]))
    up = np.concatenate((data[ends[:-1]] < data[ends[:-1] + 1], [False]))
    return np.repeat(up, np.diff(np.concatenate(([-1], ends))))


def _sorted_directly(at: np.ndarray, words: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Suffixes at ``at`` in order of their first WINDOW bytes: by eight bytes, then ties by the next eight, and so on.

    Ties whose whole windows have one hash are left as they are.
    """
    order = at[np.argsort(words[at], kind="stable")]
    first = words[order]
    fresh = np.concatenate(([True], first[1:] != first[:-1]))
    slots, depth = np.arange(len(order)), _WORD
    while depth < WINDOW:
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate((starts, [len(slots)])))
        if not len(starts):
            break
        here = window[order[slots]]
        alike = np.concatenate(([True], (here[1:] == here[:-1]) | fresh[1:]))
        open_ = (sizes > 1) & ~np.logical_and.reduceat(alike, starts)
        kept = np.repeat(open_, sizes)
        slots = slots[kept]
        if not len(slots):
            break
        group = np.repeat(np.arange(len(starts)), sizes)[kept]
        own = order[slots]
        behind = own + depth
        key = np.where(behind < len(words), words[np.minimum(behind, len(words) - 1)], np.uint64(0))
        sort = np.lexsort((key, group))
        order[slots] = own[sort]
        key, group = key[sort], group[sort]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        depth += _WORD
    return order


def suffix_array(data: np.ndarray, words: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order of their first WINDOW bytes at least, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly and put at the end of the bucket of their first byte. One
    pass over the buckets in ascending order then places each other suffix when its successor, which is smaller, is met.
    """
    n = len(data)
    rises = _rises(data)
    sizes = np.bincount(data, minlength=256)
    start = np.concatenate(([0], np.cumsum(sizes)))
    direct = np.flatnonzero(rises)
    order = np.empty(n, dtype=np.int64)
    ranked = _sorted_directly(direct, words, window) if len(direct) else direct
    rising = np.bincount(data[direct], minlength=256)
    direct_start = start[1:] - rising
    taken = np.concatenate(([0], np.cumsum(rising)))
    for c in np.flatnonzero(rising):
        order[direct_start[c] : start[c + 1]] = ranked[taken[c] : taken[c + 1]]
    head = start[:-1].copy()
    order[head[data[n - 1]]] = n - 1
    head[data[n - 1]] += 1

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~rises[before]]
        byte = data[before]
        for c, count in enumerate(np.bincount(byte, minlength=256)) if len(before) > 4096 else ():
            if count:
                order[head[c] : head[c] + count] = before[byte == c]
                head[c] += count
        if len(before) <= 4096:
            sort = np.argsort(byte, kind="stable")
            before, byte = before[sort], byte[sort]
            counts = np.bincount(byte, minlength=256)
            shift = np.cumsum(counts) - counts
            order[head[byte] + np.arange(len(before)) - shift[byte]] = before
            head[:] += counts

    for c in np.flatnonzero(sizes):
        done = start[c]
        while done < head[c]:
            end = head[c]
            induce(order[done:end])
            done = end
        induce(order[direct_start[c] : start[c + 1]])
    return order


def common_prefixes(order: np.ndarray, data: np.ndarray, words: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether a suffix and the one before it in ``order`` share WINDOW bytes.

    Hashes tell which can. Where the pair one position earlier in the text shares as many bytes, one more byte decides;
    the others are compared eight bytes at a time.
    """
    n = len(data)
    shared = np.zeros(n, dtype=bool)
    alive = np.flatnonzero(window[order[1:]] == window[order[:-1]]) + 1
    alive = alive[np.maximum(order[alive], order[alive - 1]) + WINDOW <= n]
    before = np.full(n + 1, -1, dtype=np.int64)  # by text position, shifted by one
    before[order[alive] + 1] = order[alive - 1]
    own, other = order[alive], order[alive - 1]
    follows = (before[own] >= 0) & (before[own] + 1 == other)
    good = np.ones(len(alive), dtype=bool)
    good[follows] = data[own[follows] + WINDOW - 1] == data[other[follows] + WINDOW - 1]
    heads = np.flatnonzero(~follows)
    for depth in range(0, WINDOW, _WORD):
        same = words[own[heads] + depth] == words[other[heads] + depth]
        good[heads[~same]] = False
        heads = heads[same]
    if not good.all():  # two different strings had one hash: nothing may rest on its neighbour
        good[:] = True
        for depth in range(0, WINDOW, _WORD):
            good &= words[own + depth] == words[other + depth]
    shared[alive[good]] = True
    return shared


def repeated_windows(bodies: list[bytes], counts: list[int], copies: list[int]) -> list[np.ndarray]:
    """Of each passage (its bytes, windows, occurrences in the corpus) the windows that occur more than once."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    lengths = np.array([len(b) for b in bodies])
    begins = np.cumsum(lengths) - lengths
    weight = np.zeros(len(data), dtype=np.int64)  # 0 where no window of a passage begins
    for begin, count, n in zip(begins.tolist(), counts, copies, strict=True):
        weight[begin : begin + count] = n
    words = words_at(data)
    window = np.concatenate((rolling(data, WINDOW), np.arange(WINDOW - 1, dtype=np.uint64)))[: len(data)]
    order = suffix_array(data, words, window)
    run = np.cumsum(~common_prefixes(order, data, words, window)) - 1
    total = np.bincount(run, weights=weight[order])
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order] = total[run] > 1
    repeated &= weight > 0
    return [np.flatnonzero(repeated[b : b + c]) for b, c in zip(begins.tolist(), counts, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending window starts as covered byte runs (first, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(
        zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + WINDOW).tolist(), strict=True)
    )


_RUN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_RUN_SQL = "array<struct<first:long,end:long>>"


def _filed(rows: DataFrame) -> DataFrame:
    """(``doc``, ``tie``, ``file``, ``digest``, ``start``, ``windows``, ``named``) per passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties, found = [], [], []
            for doc, tie, text in rows_of([batch]):
                for key, start, count, named in passages(text):
                    body = text[start : start + count + WINDOW - 1]
                    docs.append(doc)
                    ties.append(tie)
                    found.append((key, xxhash.xxh3_64_intdigest(body) - (1 << 63), start, count, named))
            columns = [pa.array(docs, pa.int64()), pa.array(ties, pa.int64())]
            columns += [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 5)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc", "tie", "file", "digest", "start", "windows", "named"]
            )

    return rows.mapInArrow(
        run, "doc long, tie long, file long, digest long, start long, windows long, named long"
    )


def _bodies(rows: DataFrame, homes: DataFrame) -> DataFrame:
    """(``file``, ``digest``, ``windows``, ``copies``, ``large``, ``body``) of passages, cut from the document each is found in."""
    wanted = homes.groupBy("doc", "tie").agg(F.collect_list(F.struct("file", "digest", "start", "windows", "copies", "large")).alias("cuts"))
    joined = rows.join(wanted.hint("merge"), ["doc", "tie"]).select("body", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, cuts in rows_of(batches):
            for at in range(0, len(cuts), 1000):
                part = cuts[at : at + 1000]
                columns = [pa.array([c[k] for c in part], pa.int64()) for k in ("file", "digest", "windows", "copies")]
                ends = [(c["start"], c["start"] + c["windows"] + WINDOW - 1) for c in part]
                columns.append(pa.array([c["large"] for c in part], pa.bool_()))
                columns.append(pa.array([text[a:b] for a, b in ends], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "digest", "windows", "copies", "large", "body"])

    return joined.mapInArrow(run, "file long, digest long, windows long, copies long, large boolean, body binary")


def _sorted_marks(bodies: DataFrame) -> DataFrame:
    """(``file``, ``digest``, ``runs``): repeated bytes of passages, whole files sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def marked() -> pa.RecordBatch:
            found = repeated_windows([r[4] for r in held], [r[2] for r in held], [r[3] for r in held])
            keep = [(r[0], r[1], _runs(x)) for r, x in zip(held, found, strict=True) if len(x)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in keep], pa.int64()),
                    pa.array([d for _, d, _ in keep], pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in x] for _, _, x in keep], _RUN),
                ],
                names=["file", "digest", "runs"],
            )

        for row in rows_of(batches):
            if size > SORT_BYTES and row[0] != held[-1][0]:
                yield marked()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
        if held:
            yield marked()

    together = bodies.repartition("file").sortWithinPartitions("file", "digest")
    return together.mapInArrow(run, f"file long, digest long, runs {_RUN_SQL}")


def _filed_again(bodies: DataFrame, gram: int) -> DataFrame:
    """Passages of large files, cut and filed by a longer string: their part from window ``at`` on is (``file2``, ``digest2``).

    Only keys: most of the parts go before anything needs their bytes.
    """
    names = ["file", "digest", "copies", "at", "windows", "named", "file2", "digest2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = []
                for file, digest, _, copies, body in rows_of([batch.slice(at, 256)]):
                    for key, start, count, named in passages(body, gram):
                        mark = xxhash.xxh3_64_intdigest(body[start : start + count + WINDOW - 1]) - (1 << 63)
                        found.append((file, digest, copies, start, count, named * copies, key, mark))
                columns = zip(*found, strict=True) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return bodies.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _cut_again(held: DataFrame, subs: DataFrame) -> DataFrame:
    """(``file``, ``digest``, ``windows``, ``copies``, ``large``, ``body``) of parts, cut from the passages ``held``."""
    wanted = subs.select(
        F.col("part.file").alias("of"), F.col("part.digest").alias("in"), "part.at", "part.windows", "file", "digest", "copies", "large"
    )
    whole = held.select(F.col("file").alias("of"), F.col("digest").alias("in"), F.col("body").alias("whole"))
    body = F.expr(f"substring(whole, cast(at + 1 as int), cast(windows + {WINDOW - 1} as int))").alias("body")
    return wanted.join(whole, ["of", "in"]).select("file", "digest", "windows", "copies", "large", body)


def _shifted(by: str) -> Column:
    return F.transform(
        "runs", lambda r: F.struct((r["first"] + F.col(by)).alias("first"), (r["end"] + F.col(by)).alias("end"))
    )


def _marks(each: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], level: int = 0) -> DataFrame:
    """(``file``, ``digest``, ``runs``) of the distinct passages ``each``, whose bytes ``bodies_of`` gives.

    Files of few passages are sorted whole. The passages of others are filed again at the next level: most of them then
    are alone in their file, as only the strings at the edges of a frequent passage differ, and go. The bytes of all are
    fetched once, as that shuffles whole texts.
    """
    if level + 1 == len(GRAMS):
        return _sorted_marks(bodies_of(each.withColumn("large", F.lit(False))).drop("large"))
    sizes = each.groupBy("file").agg(F.count("*").alias("n"))
    large = staged(sizes.filter(F.col("n") > FILE_PASSAGES).select("file", F.lit(True).alias("large")), "large")
    if large.isEmpty():
        return _sorted_marks(bodies_of(each.withColumn("large", F.lit(False))).drop("large"))
    bodies = staged(bodies_of(each.join(large, "file", "left").fillna(False, ["large"])), "bodies")
    marks = _sorted_marks(bodies.filter("NOT large").drop("large"))
    held = bodies.filter("large").drop("large")
    parts = staged(_filed_again(held, GRAMS[level + 1]), "parts")
    shared = parts.groupBy("file2").agg(F.sum("named").alias("n")).filter("n > 1").select("file2")
    links = parts.join(shared, "file2")
    subs = links.groupBy("file2", "digest2").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("file", "digest", "at", "windows")).alias("part")
    )
    subs = staged(subs.select(F.col("file2").alias("file"), F.col("digest2").alias("digest"), "copies", "part"), "subs")
    found = _marks(subs, lambda some: _cut_again(held, some), level + 1).select(
        F.col("file").alias("file2"), F.col("digest").alias("digest2"), "runs"
    )
    again = links.select("file", "digest", "at", "file2", "digest2").join(found, ["file2", "digest2"])
    return marks.unionByName(again.select("file", "digest", _shifted("at").alias("runs")))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``: remaining bytes) per row of ``docs``.

    Removes every byte of a string of WINDOW bytes that starts more than once anywhere in the corpus, judged on the
    input. Passages are filed so that equal windows meet; files with one entry are dropped, equal passages are counted as
    one, and the suffixes of the rest are sorted file by file, whatever the number of passages in them. Missing and empty texts, and those below WINDOW bytes, stay whole.
    Repeated rows repeat each other. Rows without an id take part like others. No rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("tie", F.xxhash64("body"))
    filed = staged(_filed(rows.filter(F.length("body") >= WINDOW).select("doc", "tie", "body")), "passages")
    shared = filed.groupBy("file").agg(F.sum("named").alias("n")).filter("n > 1").select("file")
    # Every table joined here grows with the texts, so none is broadcast, whatever its estimated size.
    found = staged(filed.join(shared.hint("merge"), "file"), "filed")
    each = found.groupBy("file", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "tie", "start", "windows")).alias("home")
    )
    each = staged(each.select("file", "digest", "copies", "home.*"), "homes")
    once, places = rows, found.select("file", "digest", "doc", "tie", "start")
    if not rows.groupBy("doc", "tie").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        # Rows that share id and text are counted above; from here on one of them stands for all.
        once, places = rows.dropDuplicates(["doc", "tie"]), places.distinct()
    marks = _marks(each, lambda some: _bodies(once, some))
    spans = places.join(marks.hint("merge"), ["file", "digest"])
    spans = spans.select("doc", "tie", _shifted("start").alias("runs"))
    per_doc = spans.groupBy("doc", "tie").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, runs in rows_of([batch.select(["body", "runs"])]):
                made.append(_without(text, [(r["first"], r["end"]) for r in runs or ()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([m[k] for m in made], pa.int64()) for k in range(3)]
                + [pa.array([m[3] for m in made], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.join(per_doc.hint("merge"), ["doc", "tie"], "left").select("doc_id", "body", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _without(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Size of a text, bytes in the runs, number of maximal runs, and the text without them."""
    pieces, at, removed, spans = [], 0, 0, 0
    for first, end in sorted(runs):
        if spans and first <= at:
            removed += max(0, end - at)
            at = max(at, end)
            continue
        pieces.append(text[at:first])
        removed += end - first
        spans, at = spans + 1, end
    pieces.append(text[at:])
    return len(text), removed, spans, b"".join(pieces)

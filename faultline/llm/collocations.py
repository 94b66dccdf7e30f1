"""Phrases that occur more often than their parts suggest, counted over the distinct chunks of a prefix-free parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.llm import spans
from faultline.llm.common import shared_file, staged, text_bytes

# Longest phrase, least occurrences, share of a phrase that makes it part of a longer one, phrases reported.
LONGEST = 3
LEAST = 10
PART_PERCENT = 50
TOP = 2_000
SLICES = 64
# A pair of words ends a chunk if its hash is divisible by this; a chunk without such a pair ends after CHUNK_WORDS.
TRIGGER = 24
CHUNK_WORDS = 256
# Positions of the filter of frequent phrases: 64 MB in each task, whatever the input.
FILTER_BITS = 29

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SPACE, _LINE = 0x20, 0x0A


def _pairs(keys: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return spans.mixed(keys[:-1] * _PAIR + np.roll(keys, -1)[:-1]) if len(keys) else keys


def parse(data: np.ndarray, offsets: np.ndarray, trigger: int = TRIGGER, most: int = CHUNK_WORDS):
    """Chunks of the rows: (row, own words, text) each.

    In the text of a chunk one blank stands between words of a piece and a line break between pieces. Behind its own
    words come those of the next chunk, two at most, that phrases starting in it reach. So each start of a phrase is in one
    chunk. Chunks end at pairs of words chosen by their content, so the same passage is cut alike wherever it stands.
    """
    kind = _CLASS[data]
    inside = kind == _WORD
    starts, ends, row = spans.words(inside, offsets)
    n = len(starts)
    if not n:
        return
    lower = _LOWER[data]
    breaks = np.concatenate(([0], np.cumsum(kind == _BREAK)))
    same_row = np.concatenate((row[1:] == row[:-1], [False]))
    linked = same_row & (breaks[ends] == breaks[np.concatenate((starts[1:], [len(data)]))])
    size = ends - starts
    out_start = np.cumsum(size + 1) - (size + 1)
    out = np.empty(int((size + 1).sum()), dtype=np.uint8)
    first = np.zeros(len(data), dtype=np.int64)
    first[starts] = 1
    word_of = np.cumsum(first)[inside] - 1
    out[np.arange(len(word_of)) + word_of] = lower[inside]
    out[out_start + size] = np.where(linked, _SPACE, _LINE)
    keys = spans.hashes(out, out_start, out_start + size)
    cut = ~same_row
    cut[1:] |= same_row[:-1] & (_pairs(keys) % np.uint64(trigger) == 0)
    at = np.arange(n)
    begun = np.maximum.accumulate(np.where(np.concatenate(([True], cut[:-1])), at, 0))
    cut |= (at - begun) % most == most - 1
    last = np.flatnonzero(cut)
    head = np.concatenate(([0], last[:-1] + 1))
    reach = last + linked[last]
    reach = reach + (reach > last) * linked[np.minimum(reach, n - 1)]
    text = out.tobytes()
    begin, end = out_start[head], out_start[reach] + size[reach]
    for r, own, a, b in zip(row[head].tolist(), (last - head + 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        yield r, own, text[a:b]


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(``lang``, ``body``, ``own``, ``n``): distinct chunks per language and how often the parse uses each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for at, offsets, data in spans.blocks(batch.column(1)):
                found = list(parse(data, offsets))
                rows, own, bodies = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array([at + r for r in rows], pa.int64())), pa.array(bodies, pa.binary()), pa.array(own, pa.int32())],
                    names=["lang", "body", "own"],
                )

    picked = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("body")
    )
    chunks = picked.mapInArrow(run, "lang string, body binary, own int")
    return chunks.groupBy("lang", "body", "own").agg(F.count("*").alias("n"))


class _Phrases:
    """Words of the chunks in a block, and where phrases of two and three words start."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, own: np.ndarray, seed: np.ndarray):
        self.starts, self.ends, self.row = spans.words((data != _SPACE) & (data != _LINE), offsets)
        n = len(self.starts)
        nth = np.arange(n) - np.searchsorted(self.row, self.row)
        self.owned = nth < own[self.row]
        next_row = np.concatenate((self.row[1:] == self.row[:-1], [False]))
        after = data[np.minimum(self.ends, len(data) - 1)] if n else self.ends
        self.linked = next_row & (after == _SPACE)
        self.words = spans.mixed(spans.hashes(data, self.starts, self.ends) ^ seed[self.row])
        self.pairs = np.concatenate((_pairs(self.words), np.zeros(min(n, 1), dtype=np.uint64)))
        self.two = self.owned & self.linked
        self.three = self.two & np.concatenate((self.linked[1:], [False]))[:n]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    own, seed = batch.column(2).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
    for at, offsets, data in spans.blocks(batch.column(1)):
        end = at + len(offsets) - 1
        yield at, offsets, data, own[at:end], seed[at:end]


def frequent_filter(chunks: DataFrame, least: int = LEAST, bits: int = FILTER_BITS) -> str:
    """Folder in the shared space with the positions of all words and pairs that may occur ``least`` times.

    Hashes are counted, so a phrase that does occur so often is never missing; one that does not may be in. The size
    has a bound; with very many frequent phrases more of the others pass, and cost a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy()
            for at, offsets, data, own, seed in _blocks(batch):
                p = _Phrases(offsets, data, own, seed)
                weight = n[at : at + len(own)][p.row]
                keys = np.concatenate((p.words[p.owned], p.pairs[p.two])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.concatenate((weight[p.owned], weight[p.two])))], names=["key", "n"]
                )

    keys = _seeded(chunks).mapInArrow(run, "key long, n long")
    frequent = keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    position = F.shiftrightunsigned("key", 64 - bits)
    found = frequent.groupBy(F.shiftright(position, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int)))").alias("set")
    )
    path = stage_path(chunks.sparkSession, "frequent")
    found.write.parquet(path)
    return path


def _load(path: str, bits: int) -> np.ndarray:
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    store, inner = shared_file(path)
    for info in store.get_file_info(fs.FileSelector(inner)):
        if info.path.endswith(".parquet"):
            part = pq.read_table(info.path, filesystem=store)
            table[part.column("word").to_numpy()] = part.column("set").to_numpy().view(np.uint64)
    return table


def _seeded(chunks: DataFrame) -> DataFrame:
    return chunks.select("lang", "body", "own", "n", F.xxhash64("lang").alias("seed"))


def phrase_counts(chunks: DataFrame, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """(``lang``, ``phrase``, ``f``) of the phrases of up to three words that occur ``least`` times or more.

    Three words are counted where both of their pairs may be frequent, as no part is rarer than the whole. Counts are by
    the words themselves; equal phrases of a block are put together first, byte by byte.
    """
    path = frequent_filter(chunks, least, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(path, bits)

        def may(keys: np.ndarray) -> np.ndarray:
            at = keys >> np.uint64(64 - bits)
            return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

        for batch in batches:
            n = batch.column(3).to_numpy()
            code = batch.column(0).dictionary_encode().indices.to_numpy()
            for at, offsets, data, own, seed in _blocks(batch):
                p = _Phrases(offsets, data, own, seed)
                pair = may(p.pairs)
                one = np.flatnonzero(p.owned & may(p.words))
                two = np.flatnonzero(p.two & pair)
                three = np.flatnonzero(p.three & pair & np.concatenate((pair[1:], [False]))[: len(pair)])
                begin = np.concatenate((one, two, three))
                end = p.ends[np.concatenate((one, two + 1, three + 2))]
                row = at + p.row[begin]
                begin = p.starts[begin]
                first = spans.representatives(data, begin, end, code[row])
                sums = np.zeros(len(begin), dtype=np.int64)
                np.add.at(sums, first, n[row])
                kept = np.flatnonzero(first == np.arange(len(first)))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[kept])),
                        pa.array([raw[a:b] for a, b in zip(begin[kept].tolist(), end[kept].tolist(), strict=True)], pa.binary()),
                        pa.array(sums[kept]),
                    ],
                    names=["lang", "phrase", "n"],
                )

    counted = _seeded(chunks).mapInArrow(run, "lang string, phrase binary, n long")
    phrase = F.col("phrase").cast("string").alias("phrase")
    counts = counted.select("lang", phrase, "n").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.filter(F.col("f") >= least)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, bits: int = FILTER_BITS
) -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the best ``top`` phrases per language.

    Texts in lower case (A-Z) are split into pieces at punctuation and line ends and into words at blanks. A phrase of
    two or three words that occurs ``least`` times has the score floor(10^6 a a / (l r)) of its worst cut. A phrase is
    left out if a longer one with at least PART_PERCENT of its occurrences holds it.

    Missing and empty texts have no words; a missing language is ``und``. Repeated rows count as often as they stand.
    Ties of score and occurrences go by the bytes of the phrase. A text of any length is parsed whole. No rows, or no
    frequent phrases, give none. Other columns are not read.
    """
    chunks = staged(dictionary(docs, lang_col, text_col), "dictionary")
    counts = staged(phrase_counts(chunks, least, bits), "phrases")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    words = F.split("phrase", " ")
    long = counts.withColumn("w", words).filter(F.size("w") > 1)
    cuts = long.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w"
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("right"),
    )
    named = counts.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("f"))

    def with_count(df: DataFrame, part: str, name: str) -> DataFrame:
        found = df.join(named, (F.col("lang") == F.col("part_lang")) & (F.col(part) == F.col("part")))
        return found.drop("part_lang", "part").withColumnRenamed("f", name)

    cuts = with_count(with_count(cuts, "left", "l"), "right", "r")
    exact = "decimal(15,0)"
    score = F.expr(f"(cast(a as {exact}) * cast(a as {exact}) * 1000000) div (cast(l as {exact}) * cast(r as {exact}))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.filter(F.size("w") == LONGEST).select(
        "lang", F.explode(F.array(*(F.array_join(F.slice("w", k, 2), " ") for k in (1, 2)))).alias("phrase"), "f"
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < PART_PERCENT * F.col("a"))
    )
    # The best of each slice of a language first: one task then ranks SLICES times ``top`` phrases at most.
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    near = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order)))
    best = Window.partitionBy("lang").orderBy(*order)
    ranked = near.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )

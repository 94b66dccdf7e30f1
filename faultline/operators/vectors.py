"""Word vectors, document vectors and user-supplied encoders."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import checkpointed, stage_path
from faultline.functions.text import unfold
from faultline.operators.vocab import fits_dictionary

# Fixed values of the word vector training.
VECTOR_SIZE = 300
WINDOW = 5
MIN_COUNT = 2
SEED = 42
EPOCHS = 10
MAX_VOCAB = 10_000
# Words that one task counts, unless all cores are busy anyway.
TASK_WORDS = 250_000
# Steps over all counted pairs that stand for one epoch, and the first step's size.
EPOCH_STEPS = 2
STEP_SIZE = 0.1
# Trained words whose pairs are one task, and those whose scores a task holds at a time.
TASK_TERMS = 256
# Words of one slice of a batch, and pairs that a task counts before it sends them on.
SLICE_WORDS = 200_000
HELD_PAIRS = 4_000_000


def frequent_enough(words: DataFrame, min_count: int, max_vocab: int) -> tuple[int, int]:
    """(smallest count that keeps at most ``max_vocab`` terms, number of words) of (``term``, ``tf``).

    Terms are reduced to how many share a count before they meet; there are few different counts.
    """
    shared = words.groupBy("tf").agg(F.count(F.lit(1)).alias("terms"))
    falling = Window.orderBy(F.col("tf").desc())
    upto = shared.withColumn("upto", F.sum("terms").over(falling))
    kept = F.min(F.when((F.col("upto") <= max_vocab) & (F.col("tf") >= min_count), F.col("tf")))
    most = F.max("tf") + 1
    row = upto.agg(F.coalesce(kept, F.greatest(most, F.lit(min_count))).alias("least"), F.sum(F.col("tf") * F.col("terms")).alias("n")).first()
    return int(row["least"] or min_count), int(row["n"] or 0)


class WordVectors(NamedTuple):
    """Trained words and their vectors, row by row."""

    spark: SparkSession
    terms: list[str]
    matrix: np.ndarray


def _counted(keys: list[np.ndarray], weights: list[int], width: int) -> pa.RecordBatch:
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, np.repeat(weights, [len(k) for k in keys])).astype("int64")
    columns = [pa.array((pairs // width).astype("int32")), pa.array((pairs % width).astype("int32")), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "ctx", "n"])


def pair_counts(df: DataFrame, tokens: str, trained: Sequence[str], window: int = WINDOW) -> DataFrame:
    """(word, ctx, n): how often two trained words, by number, meet within a window, in both orders.

    Other words are left out of the texts first. A pair of neighbours counts ``window`` times, one at the edge of the window
    once: the share of the windows of random width, 1 to ``window``, that hold it. Pairs are counted in the tasks first.
    """
    shared = df.sparkSession.sparkContext.broadcast(pa.array(list(trained), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = max(len(known), 1)
        keys, weights, size = [], [], 0
        for batch in batches:
            column = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
            words = pc.index_in(column.flatten().cast(pa.string()), value_set=known)
            numbers = pc.fill_null(words, -1).to_numpy(zero_copy_only=False).astype("int64")
            text = np.repeat(np.arange(len(lengths)), lengths)[numbers >= 0]
            numbers = numbers[numbers >= 0]
            for low in range(0, len(numbers), SLICE_WORDS):
                for gap in range(1, window + 1):
                    high = min(low + SLICE_WORDS, len(numbers) - gap)
                    if high <= low:
                        break
                    same = text[low:high] == text[low + gap : high + gap]
                    one, two = numbers[low:high][same], numbers[low + gap : high + gap][same]
                    keys.append(np.minimum(one, two) * width + np.maximum(one, two))
                    weights.append(window + 1 - gap)
                    size += len(one)
                if size > HELD_PAIRS:
                    yield _counted(keys, weights, width)
                    keys, weights, size = [], [], 0
        if size:
            yield _counted(keys, weights, width)

    pairs = df.select(tokens).mapInArrow(run, "word int, ctx int, n bigint")
    pairs = pairs.groupBy("word", "ctx").agg(F.sum("n").alias("n"))
    one, two = "named_struct('word', word, 'ctx', ctx, 'n', n)", "named_struct('word', ctx, 'ctx', word, 'n', n)"
    twice = "named_struct('word', word, 'ctx', ctx, 'n', 2 * n)"
    return pairs.select(F.inline(F.expr(f"IF(word = ctx, array({twice}), array({one}, {two}))")))


def _slopes(rows: DataFrame, own: np.ndarray, other: np.ndarray, totals: np.ndarray, norms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(slope of the likelihood of the counted pairs ``rows`` per row of ``own``, logarithm of each row's summed scores).

    ``own`` are the words' vectors and ``other`` those of the contexts; with ``norms``, the logarithms that the words had,
    it is the other way round. A slope is that of the mean over the pairs of a row.
    """
    shared = rows.sparkSession.sparkContext.broadcast((own, other, totals, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, totals, norms = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TASK_TERMS):
                part = batch.slice(at, TASK_TERMS)
                word = part.column(0).to_numpy()
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                place = np.repeat(np.arange(len(word)), lengths), part.column(1).flatten().to_numpy()
                n = part.column(2).flatten().to_numpy()
                scores = own[word] @ other.T
                if norms is None:
                    top = scores.max(axis=1)
                    scores -= top[:, None]
                    np.exp(scores, out=scores)
                    summed = scores.sum(axis=1)
                    norm = top + np.log(summed)
                    scores *= (-totals[word] / summed)[:, None]
                else:
                    norm = np.zeros(len(word))
                    scores -= norms
                    np.exp(scores, out=scores)
                    scores *= -totals
                scores[place] += n
                slope = (scores @ other) / totals[word][:, None]
                columns = [part.column(0), pa.array([x.tobytes() for x in slope], pa.binary()), pa.array(norm.astype("float64"))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "slope", "norm"])

    found = rows.mapInArrow(run, "word int, slope binary, norm double").toArrow()
    shared.destroy()
    word = found.column("word").to_numpy()
    slope, norm = np.zeros_like(own), np.zeros(len(own), "float32")
    slope[word] = np.frombuffer(b"".join(found.column("slope").to_pylist()), "float32").reshape(-1, own.shape[1])
    norm[word] = found.column("norm").to_numpy()
    return slope, norm


class _Climber:
    """Steps along averaged slopes, each component on its own scale (Adam); their size falls to zero over all steps."""

    def __init__(self, values: np.ndarray, steps: int):
        self.values, self.steps, self.done = values, steps, 0
        self.mean, self.square = np.zeros_like(values), np.zeros_like(values)

    def step(self, slope: np.ndarray) -> None:
        size = STEP_SIZE * (1 - self.done / self.steps)
        self.done += 1
        self.mean += 0.1 * (slope - self.mean)
        self.square += 0.01 * (slope * slope - self.square)
        scale = np.sqrt(self.square / (1 - 0.99**self.done)) + 1e-9
        self.values += (size / (1 - 0.9**self.done)) * self.mean / scale


def _train(texts: DataFrame, tokens: str, terms: DataFrame, size: int, window: int, epochs: int, words: int, task_words: int) -> WordVectors:
    """Skip-gram vectors of the words ``terms`` (``term``, ``tf``) by the counts of all their pairs."""
    spark = texts.sparkSession
    names = [r["term"] for r in terms.orderBy(F.col("tf").desc(), "term").collect()]
    wanted = min(spark.sparkContext.defaultParallelism, math.ceil(words / task_words))
    dealt_out = texts.select(tokens)
    if dealt_out.rdd.getNumPartitions() < wanted:
        dealt_out = dealt_out.repartition(wanted)
    pairs = pair_counts(dealt_out, tokens, names, window)
    by_word = pairs.groupBy("word").agg(F.collect_list("ctx").alias("ctx"), F.collect_list(F.col("n").cast("float")).alias("n"))
    tasks = max(1, math.ceil(len(names) / TASK_TERMS))
    rows = checkpointed(by_word.repartition(tasks, "word").sortWithinPartitions("word"))
    sums = rows.select("word", F.aggregate("n", F.lit(0.0), lambda x, y: x + y).alias("n")).toArrow()
    totals = np.zeros(len(names), "float32")
    totals[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    start = (np.random.default_rng(SEED).random((len(names), size), "float32") - np.float32(0.5)) / np.float32(size)
    steps = EPOCH_STEPS * epochs
    word, context = _Climber(start, steps), _Climber(np.zeros_like(start), steps)
    for _ in range(steps if len(sums) else 0):
        slope, norms = _slopes(rows, word.values, context.values, totals, None)
        context.step(_slopes(rows, context.values, word.values, totals, norms)[0])
        word.step(slope)
    return WordVectors(spark, names, word.values.astype(float))


def fit_word_vectors(
    train: DataFrame,
    tokens: str,
    size: int = VECTOR_SIZE,
    window: int = WINDOW,
    min_count: int = MIN_COUNT,
    epochs: int = EPOCHS,
    max_vocab: int = MAX_VOCAB,
    task_words: int = TASK_WORDS,
) -> WordVectors:
    """Skip-gram vectors with the full softmax, trained on the counts of all pairs of words within a window.

    The texts are read once, for the counts; how long a step takes depends on the trained words, not on the texts. Every
    step is two jobs, the slopes of the words and those of the contexts, TASK_TERMS words a task. Driver and tasks hold one
    vector per word and context, so at most ``max_vocab`` terms are trained: the count that a term needs rises until they
    fit.
    """
    terms = train.select(unfold(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    terms = checkpointed(terms.filter("term IS NOT NULL"))
    least, words = frequent_enough(terms, min_count, max_vocab)
    return _train(train, tokens, terms.filter(F.col("tf") >= least), size, window, epochs, words, task_words)


def word_vector_table(model: WordVectors) -> DataFrame:
    """(term, vec) of trained vectors."""
    path = stage_path(model.spark, "word-vectors")
    vec = pa.array(list(model.matrix), pa.list_(pa.float64()))
    model.spark.createDataFrame(pa.table({"term": pa.array(model.terms, pa.string()), "vec": vec})).write.parquet(path)
    return model.spark.read.parquet(path)


def _context_keys(codes: np.ndarray, context: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, trained word) codes of all pairs within the window of one slice of texts.

    A word without a trained word in its window takes the nearest one on each side of its text.
    """
    lonely = np.ones(len(codes), bool)
    for gap in range(1, min(window, len(codes) - 1) + 1):
        same = text[:-gap] == text[gap:]
        for here, there in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
            met = same & (context[there] >= 0)
            lonely[here] &= ~met
            yield codes[here][met], context[there][met]
    places = np.arange(len(codes))
    before = np.maximum.accumulate(np.where(context >= 0, places, -1))
    after = np.minimum.accumulate(np.where(context >= 0, places, len(codes))[::-1])[::-1]
    for near in (before, after):
        asked = np.flatnonzero(lonely & (context < 0) & (near >= 0) & (near < len(codes)))
        asked = asked[text[near[asked]] == text[asked]]
        yield codes[asked], context[near[asked]]


def context_counts(df: DataFrame, tokens: str, trained: Sequence[str], window: int = WINDOW) -> DataFrame:
    """(term, ctx, n): how often a word stands within the window of the trained word number ``ctx``.

    Pairs are counted in the tasks first. They meet by word and trained word, so a frequent word is not one task's work.
    """
    shared = df.sparkSession.sparkContext.broadcast(pa.array(list(trained), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = max(len(known), 1)

        def counted(keys: list[np.ndarray], terms: pa.Array) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(keys), return_counts=True)
            columns = [terms.take(pa.array(pairs // width)), pa.array((pairs % width).astype("int32")), pa.array(n.astype("int64"))]
            return pa.RecordBatch.from_arrays(columns, names=["term", "ctx", "n"])

        for batch in batches:
            column = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
            coded = column.flatten().cast(pa.string()).dictionary_encode()
            terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype("int64")
            if not len(codes):
                continue
            numbers = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
            context, text = numbers[codes].astype("int64"), np.repeat(np.arange(len(lengths)), lengths)
            # Whole texts per slice: cut where a text begins beyond the next multiple of the slice size.
            begins = np.concatenate([[0], np.cumsum(lengths)])
            cuts = begins[np.unique(begins // SLICE_WORDS, return_index=True)[1]]
            held, size = [], 0
            for low, high in zip(cuts, [*cuts[1:], len(codes)]):
                for word, other in _context_keys(codes[low:high], context[low:high], text[low:high], window):
                    held.append(word * width + other)
                    size += len(word)
                    if size > HELD_PAIRS:
                        yield counted(held, terms)
                        held, size = [], 0
            if size:
                yield counted(held, terms)

    pairs = df.select(F.array_compact(tokens).alias(tokens)).mapInArrow(run, "term string, ctx int, n bigint")
    return pairs.groupBy("term", "ctx").agg(F.sum("n").alias("n"))


def context_means(terms: DataFrame, counts: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(term, vec): mean vector of the trained words around every word of ``terms``; zeros where none is around.

    A word has at most as many rows as there are trained words. Sums run over sorted rows, batch by batch.
    """
    shared = terms.sparkSession.sparkContext.broadcast(matrix)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = shared.value
        word, total, weight = None, None, 0.0
        for frame in frames:
            names, ctx = frame["term"].to_numpy(), frame["ctx"].to_numpy()
            n = np.where(ctx < 0, 0, frame["n"].to_numpy()).astype(float)
            if not len(names):
                continue
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            sums = np.add.reduceat(vectors[np.maximum(ctx, 0)] * n[:, None], starts)
            weights = np.add.reduceat(n, starts)
            firsts = names[starts]
            if word is not None and firsts[0] == word:
                sums[0] += total
                weights[0] += weight
            elif word is not None:
                yield pd.DataFrame({"term": [word], "vec": [total / max(weight, 1.0)]})
            means = sums[:-1] / np.maximum(weights[:-1], 1.0)[:, None]
            if len(means):
                yield pd.DataFrame({"term": firsts[:-1], "vec": list(means)})
            word, total, weight = firsts[-1], sums[-1], weights[-1]
        if word is not None:
            yield pd.DataFrame({"term": [word], "vec": [total / max(weight, 1.0)]})

    joined = terms.select("term").join(counts, "term", "left").fillna({"ctx": -1, "n": 0})
    return joined.repartition("term").sortWithinPartitions("term", "ctx").mapInPandas(run, "term string, vec array<double>")


def _ridge(around: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least squares map from context means to trained vectors, slightly damped."""
    gram = around.T @ around
    damping = 1e-3 * np.trace(gram) / len(gram)
    if not damping > 0:
        return np.eye(len(gram))
    return np.linalg.solve(gram + damping * np.eye(len(gram)), around.T @ wanted)


def all_word_vectors(
    train: DataFrame,
    tokens: str,
    size: int = VECTOR_SIZE,
    window: int = WINDOW,
    min_count: int = MIN_COUNT,
    epochs: int = EPOCHS,
    max_vocab: int = MAX_VOCAB,
    task_words: int = TASK_WORDS,
) -> DataFrame:
    """(term, vec) of every word that occurs at least ``min_count`` times, however many there are.

    The training holds its vectors on the driver, so it gets the ``max_vocab`` most frequent words. The vectors of all other
    words are induced (a la carte embedding): a linear map takes the mean vector of the trained words around a word to its
    vector, fitted by least squares on the trained words, where both are known. Only counts and sums of that are shuffled;
    driver and tasks hold at most ``max_vocab`` vectors and one matrix of ``size`` x ``size``.

    A word with no trained word in any text of its own has the zero vector. If nothing can be trained, all have it.
    """
    spark = train.sparkSession
    path = stage_path(spark, "word-counts")
    counted = train.select(unfold(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    counted.filter(F.col("term").isNotNull() & (F.col("tf") >= min_count)).write.parquet(path)
    terms = spark.read.parquet(path)
    least, words = frequent_enough(terms, min_count, max_vocab)
    if terms.filter(F.col("tf") >= least).isEmpty():
        return terms.select("term", F.array_repeat(F.lit(0.0), size).alias("vec"))
    model = _train(train, tokens, terms.filter(F.col("tf") >= least), size, window, epochs, words, task_words)
    trained, names, matrix = word_vector_table(model), model.terms, model.matrix
    if terms.count() == len(names):
        return trained
    path = stage_path(spark, "word-contexts")
    context_means(terms, context_counts(train, tokens, names, window), matrix).write.parquet(path)
    means = spark.read.parquet(path)
    frequent = F.broadcast(trained.select("term"))
    seen = means.join(frequent, "term").toArrow()
    place = {name: i for i, name in enumerate(names)}
    order = [place[name] for name in seen.column("term").to_pylist()]
    around = np.array(seen.column("vec").combine_chunks().flatten(), float).reshape(-1, size)
    turn = spark.sparkContext.broadcast(_ridge(around, matrix[order]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(vec=list(np.stack(frame["vec"].to_numpy()) @ turn.value))

    rare = means.join(frequent, "term", "left_anti").select("term", "vec")
    return trained.unionByName(rare.mapInPandas(run, "term string, vec array<double>"))


def document_vectors(df: DataFrame, key: str, tokens: str, vectors: DataFrame, size: int, out: str = "vec") -> DataFrame:
    """Mean of the known word vectors of every text, zeros where none is known. ``size`` is the length of the vectors.

    Within the dictionary limit the vector table is broadcast, and every task sums up whole texts, one column per
    component, so that one row per text is shuffled and no vector is. Beyond it words are counted per text first and
    joined, so a word enters a mean once with its count as weight.
    """
    side = checkpointed(vectors.select("term", F.col("vec").cast("array<double>").alias("__v")))
    words = df.select(key, unfold(tokens).alias("term"))
    if fits_dictionary(side.select("term")):
        known = words.join(F.broadcast(side), "term").withColumn("tf", F.lit(1.0))
    else:
        known = words.groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf")).join(side, "term")
    known = known.filter("__v IS NOT NULL")
    parts = [F.sum(F.get("__v", F.lit(i)) * F.col("tf")).alias(f"__s{i}") for i in range(size)]
    sums = known.groupBy(key).agg(F.sum("tf").alias("__n"), *parts)
    means = sums.select(key, F.array(*[F.col(f"__s{i}") / F.col("__n") for i in range(size)]).alias("__m"))
    joined = df.select(key).join(means.hint("merge"), key, "left")
    return joined.select(key, F.coalesce("__m", F.array_repeat(F.lit(0.0), size)).alias(out))


def pair_vectors(previous: DataFrame, current: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Vectors of the old and the new text of a change, one behind the other."""
    return previous.join(current.withColumnRenamed(vec, "__cur").hint("merge"), key).select(
        key, F.concat(vec, "__cur").alias(vec)
    )


Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(
    df: DataFrame, keys: Sequence[str], text: str, encoder_factory: Callable[[], Encoder], batch: int = 8, out: str = "vec"
) -> DataFrame:
    """Encode texts in batches with an encoder that every task creates once."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield frame[list(keys)].assign(**{out: [[float(x) for x in v] for v in vectors]})

    return df.select(*keys, text).mapInPandas(run, schema)

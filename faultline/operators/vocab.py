"""Vocabularies, id sequences, term counts and character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import DICTIONARY_ROWS, checkpointed
from faultline.functions.text import let, tokenize_code, unfold, unfold_numbered
from faultline.operators.grams import gram_counts, gram_documents, listed_grams
from faultline.operators.ranking import row_index

# Special ids, lengths and caps of the two model families, and of the word counts.
SEQUENCE_MODEL = {"pad": 0, "unknown": 1, "length": 1024}
GRAPH_MODEL = {"pad": 1, "unknown": 0, "length": 128}
MAX_VOCAB = 10_000
MAX_FEATURES = 10_000
# Most frequent entries of a joined vocabulary that every task gets, as they are in almost every text.
FREQUENT = 1_000
CHAR_GRAM_RANGE = (3, 6)
CHAR_MIN_DF = 10


# --- vocabulary and id sequences -----------------------------------------------------------------


def fit_vocabulary(
    train: DataFrame,
    key: str,
    tokens: str,
    max_vocab: int = MAX_VOCAB,
    min_freq: int = 0,
    reserved: int = 2,
) -> DataFrame:
    """(token, id, freq): most frequent first, the first occurrence in (key, position) order breaks ties.

    Counting is pre-aggregated per task, and only ``max_vocab - reserved`` rows survive the top-n, so the
    row numbers below run over a bounded table.
    """
    words = train.select(F.col(key).alias("__key"), unfold_numbered(tokens, "__pos", "token"))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min(_place(words)).alias("__first"))
    top = (
        counted.filter(F.col("freq") >= min_freq)
        .orderBy(F.col("freq").desc(), "__first")
        .limit(max_vocab - reserved)
    )
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("freq").desc(), "__first"))
    return top.select("token", (rank - 1 + reserved).cast("int").alias("id"), "freq")


def _place(words: DataFrame) -> Column:
    """A value in the order of (``__key``, ``__pos``), missing keys first.

    For whole numbers it is one decimal, whose minimum is kept in a hash table; structs would be sorted, word by word.
    """
    if not isinstance(words.schema["__key"].dataType, T.IntegralType):
        return F.struct("__key", "__pos")
    number = F.coalesce(F.col("__key").cast("decimal(20,0)"), F.lit(Decimal(-(10**19))))
    return number * F.lit(Decimal(10**10)) + F.col("__pos").cast("decimal(10,0)")


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")


class Dictionary:
    """A bounded vocabulary as literal arrays addressed by the token's hash: a lookup needs no join."""

    def __init__(self, text: str, slots: int):
        content = F.from_json(F.lit(text), "struct<k:array<array<string>>,v:array<array<int>>>")
        self._tokens, self._ids, self._slots = content["k"], content["v"], slots

    def id_of(self, token: Column) -> Column:
        """Id of a token, NULL when it is unknown."""
        slot = _slot(token, self._slots)
        position = F.array_position(F.get(self._tokens, slot), token)
        return F.get(F.get(self._ids, slot), (position - 1).cast("int"))

    def ids_of(self, tokens: Column, unknown: int) -> Column:
        return F.transform(tokens, lambda t: F.coalesce(self.id_of(t), F.lit(unknown)))


def freeze(vocabulary: DataFrame, slots: int = 2048) -> Dictionary | None:
    """Fetch a fitted vocabulary as a dictionary; None when it has more than ``DICTIONARY_ROWS`` entries."""
    bounded = vocabulary.select("token", "id").limit(DICTIONARY_ROWS + 1)
    parts = bounded.groupBy(_slot(F.col("token"), slots).alias("slot")).agg(
        F.collect_list("token").alias("k"), F.collect_list("id").alias("v"), F.count(F.lit(1)).alias("n")
    )
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", F.struct("k", "v"))))
    every = F.sequence(F.lit(0), F.lit(slots - 1))
    frozen = parts.agg(F.sum("n").alias("n"), by_slot.alias("m")).select(
        "n",
        F.to_json(
            F.struct(
                F.transform(every, lambda s: F.coalesce(F.try_element_at("m", s)["k"], F.array())).alias("k"),
                F.transform(every, lambda s: F.coalesce(F.try_element_at("m", s)["v"], F.array())).alias("v"),
            )
        ).alias("text"),
    )
    row = frozen.first()
    if row["n"] is not None and row["n"] > DICTIONARY_ROWS:
        return None
    return Dictionary(row["text"] or '{"k":[],"v":[]}', slots)


def encode(
    df: DataFrame, tokens: str, vocabulary: DataFrame, out: str, unknown: int, key: str | None = None
) -> DataFrame:
    """Add the id sequence of a token array; tokens outside the vocabulary get ``unknown``.

    A vocabulary up to the dictionary limit needs no shuffle of the texts. A larger one is joined token by token.
    """
    found = freeze(vocabulary)
    if found is not None:
        return df.withColumn(out, found.ids_of(F.col(tokens), unknown))
    return encode_joined(df, tokens, vocabulary, out, unknown, key)


def encode_joined(df: DataFrame, tokens: str, vocabulary: DataFrame, out: str, unknown: int, key: str | None = None) -> DataFrame:
    """The same ids through a join, for vocabularies of any size.

    Different token arrays are encoded once and joined back by their digest. The FREQUENT first ids, which are in almost
    every text, are a literal dictionary; the join runs on distinct (array, token) pairs of the other tokens.
    """
    keyed = df.withColumn("__key", F.col(key) if key else F.md5(F.to_json(tokens)))
    texts = keyed.select("__key", tokens).dropDuplicates(["__key"])
    side = checkpointed(vocabulary.select(F.col("token").alias("__token"), F.col("id").alias("__id")))
    often = side.orderBy("__id").limit(min(FREQUENT, DICTIONARY_ROWS)).select(F.col("__token").alias("token"), F.col("__id").alias("id"))
    found = freeze(often)
    others = F.filter(F.array_distinct(tokens), lambda t: found.id_of(t).isNull())
    per_row = texts.select("__key", unfold(others).alias("__token")).join(side, "__token").groupBy("__key").agg(
        F.map_from_entries(F.collect_list(F.struct("__token", "__id"))).alias("__ids")
    )
    joined = keyed.join(per_row, "__key", "left")
    ids = F.transform(tokens, lambda t: F.coalesce(found.id_of(t), F.try_element_at("__ids", t), F.lit(unknown)))
    return joined.withColumn(out, ids).drop("__ids", "__key")


def pad(ids: Column, length: int, pad_id: int) -> Column:
    """Cut or fill an id sequence to ``length``."""
    return F.slice(F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad_id), length)), 1, length)


def encode_text(
    df: DataFrame, columns: Sequence[str], vocabulary: DataFrame, model: dict[str, int] = SEQUENCE_MODEL
) -> DataFrame:
    """Padded id sequences ``<column>_feature`` for several text columns, sharing one capped vocabulary."""
    found = freeze(vocabulary)

    def words(column: str) -> Column:
        return F.slice(tokenize_code(F.coalesce(F.col(column), F.lit(""))), 1, model["length"])

    if found is None:
        for c in columns:
            df = encode_joined(df.withColumn("__words", words(c)), "__words", vocabulary, "__ids_of", model["unknown"])
            df = df.withColumn(f"{c}_feature", pad(F.col("__ids_of"), model["length"], model["pad"])).drop("__words", "__ids_of")
        return df

    def ids(column: str) -> Column:
        return pad(found.ids_of(words(column), model["unknown"]), model["length"], model["pad"])

    return df.withColumns({f"{c}_feature": ids(c) for c in columns})


def decode(df: DataFrame, ids: str, vocabulary: DataFrame, out: str, pad_id: int, specials: Sequence[str]) -> DataFrame:
    """Tokens of an id sequence without padding; ``specials`` lists the reserved tokens by id.

    Ids are dense, so an array indexed by id is the inverse dictionary.
    """
    if not fits_dictionary(vocabulary):
        return decode_joined(df, ids, vocabulary, out, pad_id, specials)
    listed = F.array_sort(F.collect_list(F.struct("id", "token")))
    text = vocabulary.agg(F.to_json(F.transform(listed, lambda w: w["token"])).alias("t")).first()["t"]
    by_id = F.concat(F.array(*[F.lit(s) for s in specials]), F.from_json(F.lit(text), "array<string>"))
    kept = F.filter(ids, lambda i: i != pad_id)
    return df.withColumn(out, F.transform(kept, lambda i: F.get(by_id, i)))


def decode_joined(df: DataFrame, ids: str, vocabulary: DataFrame, out: str, pad_id: int, specials: Sequence[str]) -> DataFrame:
    """The same tokens through a join, for vocabularies of any size; different id sequences are decoded once."""
    keyed = df.withColumn("__key", F.md5(F.to_json(ids)))
    texts = keyed.select("__key", F.filter(ids, lambda i: i != pad_id).alias("__kept")).dropDuplicates(["__key"])
    listed = vocabulary.select(F.col("id").cast("int").alias("__id"), F.col("token").alias("__token"))
    if specials:
        fixed = df.sparkSession.createDataFrame(list(enumerate(specials)), "__id int, __token string")
        listed = listed.unionByName(fixed)
    each = texts.select("__key", unfold(F.array_distinct(F.col("__kept").cast("array<int>"))).alias("__id"))
    per_text = each.join(listed, "__id").groupBy("__key").agg(
        F.map_from_entries(F.collect_list(F.struct("__id", "__token"))).alias("__tokens")
    )
    joined = keyed.join(per_text, "__key", "left")
    kept = F.filter(ids, lambda i: i != pad_id)
    tokens = F.transform(kept, lambda i: F.try_element_at("__tokens", i.cast("int")))
    return joined.withColumn(out, tokens).drop("__tokens", "__key")


def vocabulary_size(vocabulary: DataFrame, reserved: int = 2) -> DataFrame:
    return vocabulary.agg((F.count(F.lit(1)) + reserved).alias("size"))


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda i: (i != pad_id).cast("int"))


# Bucket count and multipliers of the hashed n-grams.
GRAM_BUCKETS = 250_499
GRAM_PRIME_1 = 14_918_087
GRAM_PRIME_2 = 18_408_749


def hashed_bigrams(ids: Column) -> Column:
    """Hash of the previous id at every position (0 before the first)."""

    def hashes(a: Column) -> Column:
        def at(_, i: Column) -> Column:
            previous = F.coalesce(F.get(a, i - 1), F.lit(0)).cast("bigint")
            return F.pmod(previous * GRAM_PRIME_1, F.lit(GRAM_BUCKETS)).cast("int")

        return F.transform(a, at)

    return let(ids, hashes)


def hashed_trigrams(ids: Column) -> Column:
    """Hash of the two previous ids at every position; reduced step by step, so no id overflows BIGINT."""

    def hashes(a: Column) -> Column:
        def at(_, i: Column) -> Column:
            one = F.coalesce(F.get(a, i - 1), F.lit(0)).cast("bigint")
            two = F.coalesce(F.get(a, i - 2), F.lit(0)).cast("bigint")
            far = F.pmod(two * GRAM_PRIME_1, F.lit(GRAM_BUCKETS)) * GRAM_PRIME_2
            return F.pmod(far + F.pmod(one * GRAM_PRIME_1, F.lit(GRAM_BUCKETS)), F.lit(GRAM_BUCKETS)).cast("int")

        return F.transform(a, at)

    return let(ids, hashes)


# --- term counts ---------------------------------------------------------------------------------


def fit_terms(train: DataFrame, tokens: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, idx): the most frequent terms, columns in alphabetical order.

    Ties at the cap go to the alphabetically first term.
    """
    counted = train.select(unfold(tokens).alias("term")).groupBy("term").count()
    top = counted.orderBy(F.col("count").desc(), "term").limit(max_features).select("term")
    return index_terms(top)


def index_terms(terms: DataFrame) -> DataFrame:
    """Alphabetical column numbers for a bounded set of terms."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term"))
    return terms.select("term", (rank - 1).cast("int").alias("idx"))


def term_counts(df: DataFrame, key: str, tokens: str, terms: DataFrame) -> DataFrame:
    """Sparse matrix in long form: (key, idx, tf). Terms outside the list go before the shuffle."""
    side = checkpointed(terms.select("term", "idx"))
    if fits_dictionary(side):
        side = F.broadcast(side)
    words = df.select(key, unfold(tokens).alias("term"))
    return words.join(side, "term").groupBy(key, "idx").agg(F.count(F.lit(1)).alias("tf"))


def stack_blocks(*blocks: tuple[DataFrame, int]) -> DataFrame:
    """Put sparse blocks side by side: (long table, width) pairs become one table with shifted columns."""
    shifted, offset = [], 0
    for block, width in blocks:
        shifted.append(block.withColumn("idx", (F.col("idx") + offset).cast("int")))
        offset += width
    result = shifted[0]
    for block in shifted[1:]:
        result = result.unionByName(block)
    return result


# --- character n-grams ---------------------------------------------------------------------------


def char_text(c: Column) -> Column:
    """Lower-cased text in which every run of two or more blanks is one space."""
    return F.regexp_replace(F.lower(c), r"\s\s+", " ")


def char_grams(c: Column, low: int, high: int) -> Column:
    """All substrings of low..high characters, found with one linear look-ahead scan per length."""
    text = char_text(c)
    grams = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(low, high + 1)]
    return F.flatten(F.array(*grams))


def fit_char_grams(
    train: DataFrame, text: str, low: int = CHAR_GRAM_RANGE[0], high: int = CHAR_GRAM_RANGE[1], min_df: int = CHAR_MIN_DF
) -> DataFrame:
    """(term, df): grams that occur in at least ``min_df`` texts; each text counts once per gram."""
    return gram_documents(train.select(char_text(F.col(text)).alias("__text")), "__text", low, high).filter(F.col("df") >= min_df)


def select_subwords(grams: DataFrame) -> DataFrame:
    """Grams that hold exactly one blank-free word of two or more characters, stripped."""
    word = F.regexp_extract("term", r"^\s*(\S{2,})\s*$", 1)
    return grams.select(word.alias("term")).filter(F.col("term") != "").distinct()


def words_without_subwords(terms: DataFrame, subwords: DataFrame) -> DataFrame:
    return terms.select("term").join(subwords, "term", "left_anti")


def char_counts(
    df: DataFrame, key: str, text: str, terms: DataFrame, low: int = CHAR_GRAM_RANGE[0] - 1, high: int = CHAR_GRAM_RANGE[1]
) -> DataFrame:
    """Counts of the listed grams: (key, idx, tf).

    A list of up to ``grams.LISTED_GRAMS`` is sent to the tasks, which count the texts there. A longer one is joined after
    counting, when every gram of a text is down to one row.
    """
    listed = listed_grams(terms)
    if listed is not None:
        texts = df.select(key, char_text(F.col(text)).alias("__text"))
        return gram_counts(texts, key, "__text", listed, low, high)
    found = df.select(key, unfold(char_grams(F.col(text), low, high)).alias("term"))
    counted = found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.join(terms.select("term", "idx"), "term").select(key, "idx", "tf")


def subword_features(
    train: DataFrame,
    every: DataFrame,
    key: str,
    text: str,
    max_features: int = MAX_FEATURES,
    min_df: int = CHAR_MIN_DF,
) -> tuple[DataFrame, DataFrame]:
    """(features, counts): word columns that are no subword, then subword columns; counts for all texts.

    ``features`` is (kind, term, idx). Both term lists come from training texts only and are checkpointed,
    because every later step reads them.
    """
    tokens = train.select(tokenize_code(text).alias("__tokens"))
    found = checkpointed(select_subwords(fit_char_grams(train, text, min_df=min_df)))
    subwords = checkpointed(index_terms_large(found))
    words = checkpointed(
        index_terms(words_without_subwords(fit_terms(tokens, "__tokens", max_features), subwords.select("term")))
    )
    n_words = words.count()
    word_tf = term_counts(every.select(key, tokenize_code(text).alias("__tokens")), key, "__tokens", words)
    char_tf = char_counts(every, key, text, subwords)
    counts = stack_blocks((word_tf, n_words), (char_tf, 0))
    features = words.select(F.lit("word").alias("kind"), "term", "idx").unionByName(
        subwords.select(F.lit("char").alias("kind"), "term", (F.col("idx") + n_words).cast("int").alias("idx"))
    )
    return features, counts


def fits_dictionary(df: DataFrame, rows: int = DICTIONARY_ROWS) -> bool:
    """Whether a table is small enough for a deliberate broadcast; looks at no more than ``rows + 1`` rows."""
    return df.limit(rows + 1).count() <= rows


def index_terms_large(terms: DataFrame) -> DataFrame:
    """Alphabetical column numbers for a term set without a bound: numbered per first two bytes."""
    head = F.rpad(F.substring(F.hex(F.encode("term", "UTF-8")), 1, 4), 4, "0")
    ranked = row_index(terms, "idx", [F.col("term")], F.conv(head, 16, 10).cast("int"))
    return ranked.select("term", F.col("idx").cast("int").alias("idx"))

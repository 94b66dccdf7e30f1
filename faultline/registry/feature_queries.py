"""Queries over vocabularies, counts, n-grams and vectors of the documents."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.cluster import checkpointed
from faultline.functions.text import TOKEN_PATTERN, tokenize_code
from faultline.operators import parallel, splits, trees, vectors, vocab
from faultline.plans import baseline
from faultline.registry.catalog import query, sql_quote, table
from faultline.registry.clean_queries import sql_split

_TOKENS = sql_quote(TOKEN_PATTERN)
_DOCS_SQL = f"""docs AS (SELECT doc_id, text, {sql_split('doc_id')} AS partition,
    regexp_extract_all(text, {_TOKENS}) AS tokens FROM documents),
  words AS (SELECT doc_id, partition, unnest(tokens) AS t, unnest(range(len(tokens))) AS p FROM docs)"""
_VOCAB_SQL = f"""{_DOCS_SQL},
  vocab AS (SELECT t, n, row_number() OVER (ORDER BY n DESC, first) + 1 AS id FROM (
    SELECT t, count(*) AS n, min((doc_id, p)) AS first FROM words WHERE partition = 'train' GROUP BY t)
    ORDER BY n DESC, first LIMIT 9998)"""
_CAP = 10000


def _docs(spark, d):
    docs = splits.assign_split(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumn("tokens", tokenize_code("text"))


def _vocabulary(docs):
    return vocab.fit_vocabulary(docs.filter("partition = 'train'"), "doc_id", "tokens", max_vocab=_CAP)


def _text(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@query("vocabulary", f"WITH {_VOCAB_SQL} SELECT t AS token, id::int AS id, n AS freq FROM vocab")
def vocabulary(spark, d):
    return _vocabulary(_docs(spark, d))


@query("vocabulary_size", f"WITH {_VOCAB_SQL} SELECT count(*) + 2 AS size FROM vocab")
def vocabulary_size(spark, d):
    return vocab.vocabulary_size(_vocabulary(_docs(spark, d)))


_IDS_SQL = f"""{_VOCAB_SQL}, ids AS (SELECT d.doc_id, coalesce(i.ids, []) AS ids, coalesce(i.kept, []) AS kept
  FROM docs d LEFT JOIN (
    SELECT w.doc_id, list(coalesce(v.id, 1) ORDER BY p) AS ids,
      list(coalesce(v.t, '<unk>') ORDER BY p) FILTER (p < 128) AS kept
    FROM words w LEFT JOIN vocab v ON w.t = v.t GROUP BY w.doc_id) i ON d.doc_id = i.doc_id)"""


@query("token_ids", f"WITH {_IDS_SQL} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def token_ids(spark, d):
    docs = _docs(spark, d)
    return vocab.encode(docs, "tokens", _vocabulary(docs), "ids", unknown=1).select("doc_id", _text("ids"))


@query("token_ids_by_join", f"WITH {_IDS_SQL} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def token_ids_by_join(spark, d):
    docs = _docs(spark, d)
    ids = vocab.encode_joined(docs, "tokens", _vocabulary(docs), "ids", 1, "doc_id")
    return ids.select("doc_id", _text("ids"))


_PADDED = "list_slice(list_concat(ids, list_transform(range({n}), lambda i: {pad})), 1, {n})"


@query(
    "padded_features",
    f"""WITH {_IDS_SQL}, models AS (SELECT doc_id, {_PADDED.format(n=1024, pad=0)} AS wide,
      {_PADDED.format(n=128, pad=1)} AS narrow FROM (SELECT doc_id, ids FROM ids))
    SELECT doc_id, array_to_string(wide, ' ') AS wide,
      array_to_string(list_transform(narrow, lambda i: i), ' ') AS narrow FROM models""",
)
def padded_features(spark, d):
    docs = _docs(spark, d)
    found = _vocabulary(docs)
    wide = vocab.encode_text(docs, ["text"], found, vocab.SEQUENCE_MODEL).withColumnRenamed("text_feature", "wide")
    model = {**vocab.GRAPH_MODEL, "unknown": 1}
    both = vocab.encode_text(wide, ["text"], found, model).withColumnRenamed("text_feature", "narrow")
    return both.select("doc_id", _text("wide"), _text("narrow"))


@query(
    "decoded_tokens",
    f"WITH {_IDS_SQL} SELECT doc_id, array_to_string(kept, ' ') AS tokens FROM ids",
)
def decoded_tokens(spark, d):
    docs = _docs(spark, d)
    found = _vocabulary(docs)
    ids = vocab.encode_text(docs.select("doc_id", "text"), ["text"], found, {"pad": 0, "unknown": 1, "length": 128})
    plain = vocab.decode(ids, "text_feature", found, "tokens", 0, ["<pad>", "<unk>"])
    return plain.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "attention_masks",
    f"""WITH {_IDS_SQL} SELECT doc_id, array_to_string(list_transform(range(128), lambda i: (i < len(ids))::int), '')
    AS mask FROM ids""",
)
def attention_masks(spark, d):
    docs = _docs(spark, d)
    model = {"pad": 0, "unknown": 1, "length": 128}
    ids = vocab.encode_text(docs.select("doc_id", "text"), ["text"], _vocabulary(docs), model)
    mask = vocab.attention_mask(F.col("text_feature"), 0)
    return ids.select("doc_id", F.array_join(mask.cast("array<string>"), "").alias("mask"))


_GRAM_SQL = f"""WITH {_IDS_SQL}, placed AS (SELECT doc_id, unnest(ids)::hugeint AS id, unnest(range(len(ids))) AS p FROM ids),
  shifted AS (SELECT doc_id, p, coalesce(lag(id, 1) OVER w, 0) AS t1, coalesce(lag(id, 2) OVER w, 0) AS t2 FROM placed
    WINDOW w AS (PARTITION BY doc_id ORDER BY p))
  SELECT d.doc_id, coalesce(string_agg((t1 * 14918087 % 250499)::varchar, ' ' ORDER BY p), '') AS bigrams,
    coalesce(string_agg(((t2 * 14918087 * 18408749 + t1 * 14918087) % 250499)::varchar, ' ' ORDER BY p), '') AS trigrams
  FROM docs d LEFT JOIN shifted s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@query("hashed_ngrams", _GRAM_SQL)
def hashed_ngrams(spark, d):
    docs = _docs(spark, d)
    ids = vocab.encode(docs, "tokens", _vocabulary(docs), "ids", unknown=1)
    grams = ids.select(
        "doc_id",
        vocab.hashed_bigrams(F.col("ids")).alias("bigrams"),
        vocab.hashed_trigrams(F.col("ids")).alias("trigrams"),
    )
    return grams.select("doc_id", _text("bigrams"), _text("trigrams"))


# --- counts ----------------------------------------------------------------------------------------

_TERMS_SQL = f"""{_DOCS_SQL}, terms AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (
    SELECT t FROM words WHERE partition = 'train' GROUP BY t ORDER BY count(*) DESC, t LIMIT 10000))"""


@query("bag_of_words_terms", f"WITH {_TERMS_SQL} SELECT t AS term, idx::int AS idx FROM terms")
def bag_of_words_terms(spark, d):
    return vocab.fit_terms(_docs(spark, d).filter("partition = 'train'"), "tokens")


@query(
    "bag_of_words",
    f"""WITH {_TERMS_SQL} SELECT doc_id, idx::int AS idx, count(*) AS tf FROM words JOIN terms USING (t)
    GROUP BY doc_id, idx""",
)
def bag_of_words(spark, d):
    docs = _docs(spark, d)
    terms = vocab.fit_terms(docs.filter("partition = 'train'"), "tokens")
    return vocab.term_counts(docs, "doc_id", "tokens", terms)


def _grams_sql(low, high, where=""):
    """All n-grams of consecutive characters, one window per length."""
    parts = [
        "SELECT doc_id, c" + "".join(f" || lead(c, {k}) OVER w" for k in range(1, n)) + f" AS g FROM chars {where} "
        "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
        for n in range(low, high + 1)
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


_CHARS_SQL = f"""texts AS (SELECT doc_id, partition, string_split(regexp_replace(lower(text), '\\s\\s+', ' ', 'g'), '') AS cs
    FROM docs),
  chars AS (SELECT doc_id, partition, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM texts),
  grams AS (SELECT DISTINCT doc_id, g FROM {_grams_sql(3, 6, "WHERE partition = 'train'")} WHERE g IS NOT NULL),
  frequent AS (SELECT g, count(*) AS df FROM grams GROUP BY g HAVING count(*) >= 10)"""


@query("char_grams", f"WITH {_DOCS_SQL}, {_CHARS_SQL} SELECT g AS term, df FROM frequent")
def char_grams(spark, d):
    return vocab.fit_char_grams(_docs(spark, d).filter("partition = 'train'"), "text")


_SUBWORD_SQL = f"""{_TERMS_SQL}, {_CHARS_SQL},
  subwords AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT trim(g, E' \\t\\n\\r') AS term
    FROM frequent WHERE regexp_matches(g, '^\\s*\\S\\S+\\s*$'))),
  plain AS (SELECT t AS term, row_number() OVER (ORDER BY t) - 1 AS idx FROM terms
    WHERE t NOT IN (SELECT term FROM subwords))"""


@query(
    "subword_terms",
    f"""WITH {_SUBWORD_SQL} SELECT 'word' AS kind, term, idx::int AS idx FROM plain
    UNION ALL SELECT 'char', term, (idx + (SELECT count(*) FROM plain))::int FROM subwords""",
)
def subword_terms(spark, d):
    docs = _docs(spark, d)
    return vocab.subword_features(docs.filter("partition = 'train'"), docs, "doc_id", "text")[0]


_SUBWORD_COUNTS_SQL = f"""WITH {_SUBWORD_SQL}, every AS (SELECT doc_id, g AS term FROM {_grams_sql(2, 6)} WHERE g IS NOT NULL)
    SELECT doc_id, idx::int AS idx, count(*) AS tf FROM words JOIN plain ON t = term GROUP BY ALL
    UNION ALL SELECT doc_id, (idx + (SELECT count(*) FROM plain))::int, count(*) FROM every JOIN subwords USING (term)
    GROUP BY ALL"""


@query("subword_counts", _SUBWORD_COUNTS_SQL)
def subword_counts(spark, d):
    docs = _docs(spark, d)
    return vocab.subword_features(docs.filter("partition = 'train'"), docs, "doc_id", "text")[1]


@query("subword_vectors", _SUBWORD_COUNTS_SQL)
def subword_vectors(spark, d):
    docs = _docs(spark, d).select("doc_id", "partition", "text")
    features = vocab.subword_features(docs.filter("partition = 'train'"), docs, "doc_id", "text")[0]
    vectors_of = baseline.stacked_counts(docs, "text", checkpointed(features)).select("doc_id", *trees.entries("features"))
    cells = vectors_of.select("doc_id", F.inline(F.arrays_zip("at", "values"))).filter("values <> 0")
    return cells.select("doc_id", F.col("at").alias("idx"), F.col("values").cast("long").alias("tf"))


# --- vectors: the word with id i has the embedding with vec_id i ---------------------------------------

_DOCVEC_SQL = f"""{_VOCAB_SQL}, known AS (SELECT w.doc_id, e.embedding::double[] AS x, count(*) AS tf FROM words w
    JOIN vocab v ON v.t = w.t JOIN embeddings e ON e.vec_id = v.id GROUP BY ALL),
  parts AS (SELECT doc_id, tf, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS dim FROM known),
  means AS (SELECT doc_id, dim, sum(v * tf) / sum(tf) AS v FROM parts GROUP BY doc_id, dim)"""


def _word_vectors(spark, d, found):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"))
    return found.join(rows, "id").select(F.col("token").alias("term"), "vec")


@query(
    "document_vectors",
    f"""WITH {_DOCVEC_SQL} SELECT d.doc_id, k::int AS dim, round(coalesce(m.v, 0), 6) + 0.0 AS value
    FROM docs d CROSS JOIN range(1, 65) r(k) LEFT JOIN means m ON m.doc_id = d.doc_id AND m.dim = k""",
)
def document_vectors(spark, d):
    docs = _docs(spark, d)
    found = vocab.fit_vocabulary(docs.filter("partition = 'train'"), "doc_id", "tokens", max_vocab=_CAP)
    vecs = vectors.document_vectors(docs, "doc_id", "tokens", _word_vectors(spark, d, found), 64)
    rows = vecs.select("doc_id", F.posexplode("vec").alias("pos", "v"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("dim"), (F.round("v", 6) + F.lit(0.0)).alias("value"))


@query(
    "pair_vector_sizes",
    "SELECT doc_id, 128 AS size FROM documents",
)
def pair_vector_sizes(spark, d):
    docs = _docs(spark, d)
    words = checkpointed(_word_vectors(spark, d, _vocabulary(docs)))
    one = vectors.document_vectors(docs, "doc_id", "tokens", words, 64)
    lowered = docs.select("doc_id", tokenize_code(F.lower("text")).alias("tokens"))
    other = vectors.document_vectors(lowered, "doc_id", "tokens", words, 64)
    return vectors.pair_vectors(one, other, "doc_id").select("doc_id", F.size("vec").alias("size"))


_PAIR_MEANS = """SELECT doc_id, avg(length(t)) AS a, avg(CASE WHEN t LIKE '%e' THEN 1.0 ELSE 0.0 END) AS b
      FROM words JOIN vocab USING (t) {where} GROUP BY doc_id"""


@query(
    "pair_vector_values",
    f"""WITH {_VOCAB_SQL}, whole AS ({_PAIR_MEANS.format(where="")}), head AS ({_PAIR_MEANS.format(where="WHERE p < 40")})
    SELECT docs.doc_id, round(coalesce(whole.a, 0), 6) AS v1, round(coalesce(whole.b, 0), 6) AS v2,
      round(coalesce(head.a, 0), 6) AS v3, round(coalesce(head.b, 0), 6) AS v4
    FROM docs LEFT JOIN whole ON docs.doc_id = whole.doc_id LEFT JOIN head ON docs.doc_id = head.doc_id""",
)
def pair_vector_values(spark, d):
    """Vectors of whole texts and of their first 40 tokens side by side, from word vectors that SQL can compute too."""
    docs = _docs(spark, d)
    ends = F.col("token").endswith("e").cast("double")
    words = _vocabulary(docs).select(F.col("token").alias("term"), F.array(F.length("token").cast("double"), ends).alias("vec"))
    words = checkpointed(words)
    whole = vectors.document_vectors(docs, "doc_id", "tokens", words, 2)
    head = vectors.document_vectors(docs.withColumn("tokens", F.slice("tokens", 1, 40)), "doc_id", "tokens", words, 2)
    both = vectors.pair_vectors(whole, head, "doc_id")
    return both.select("doc_id", *[F.round(F.col("vec")[k], 6).alias(f"v{k + 1}") for k in range(4)])


@query(
    "word_vectors",
    f"""WITH {_DOCS_SQL}
    SELECT t AS term, 300 AS size FROM words WHERE partition = 'train' GROUP BY t HAVING count(*) >= 2""",
)
def word_vectors(spark, d):
    found = vectors.all_word_vectors(_docs(spark, d).filter("partition = 'train'"), "tokens")
    return found.select("term", F.size("vec").alias("size"))


def _length_encoder():
    return lambda texts: [(len(t), t.count("\n"), t.count(" ")) for t in texts]


@query(
    "encoder_vectors",
    """SELECT doc_id, length(text)::float AS chars, (length(text) - length(replace(text, chr(10), '')))::float AS breaks,
      (length(text) - length(replace(text, ' ', '')))::float AS spaces FROM documents""",
)
def encoder_vectors(spark, d):
    vecs = vectors.embed(table(spark, d, "documents"), ["doc_id"], "text", _length_encoder)
    return vecs.select("doc_id", *[F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(("chars", "breaks", "spaces"))])


@query(
    "parallel_map",
    "SELECT conv_id, turn, (length(text) + length(role))::int AS result FROM conversations",
)
def parallel_map(spark, d):
    rows = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    mapped = parallel.parallel_map(rows, _total_length, T.IntegerType(), "key", ["role", "text"])
    return mapped.select("key.conv_id", "key.turn", "result")


def _total_length(record):
    return len(record["role"]) + len(record["text"])

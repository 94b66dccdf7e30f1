import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.cluster import stage_path
from faultline.functions.text import tokenize_code
from faultline.operators import clean, labels, models, parallel, splits, vectors, vocab
from faultline.operators import history as H
from faultline.operators.ranking import quantile_bucket, row_index
from faultline.plans import baseline, dataset
from faultline.plans import history as history_plan
from faultline.sources import files, html, tables
from faultline.streaming import texts


def words(spark, text, key=1):
    return spark.createDataFrame([(key, text)], "id int, code string").withColumn("tokens", tokenize_code("code"))


def test_vocabulary_order(spark):
    rows = vocab.fit_vocabulary(words(spark, "b a b c a d"), "id", "tokens", max_vocab=5).orderBy("id").collect()
    assert [(r["token"], r["id"], r["freq"]) for r in rows] == [("b", 2, 2), ("a", 3, 2), ("c", 4, 1)]


def test_padding(spark):
    found = spark.createDataFrame([("b", 2)], "token string, id int")
    ids = vocab.encode_text(words(spark, "b z"), ["code"], found, {"pad": 1, "unknown": 0, "length": 4})
    assert ids.first()["code_feature"] == [2, 0, 1, 1]
    plain = vocab.decode(ids, "code_feature", found, "out", 1, ["<unk>", "<pad>"]).first()["out"]
    assert plain == ["b", "<unk>"]


def test_encoding_by_join_equals_dictionary(spark):
    df = words(spark, "a b c a x y a")
    found = vocab.fit_vocabulary(df, "id", "tokens", max_vocab=5)
    one = vocab.encode(df, "tokens", found, "ids", 0).first()["ids"]
    two = vocab.encode_joined(df, "tokens", found, "ids", 0, "id").first()["ids"]
    assert one == two == [2, 3, 4, 2, 0, 0, 2]


def test_large_vocabulary_is_joined(spark, monkeypatch):
    monkeypatch.setattr(vocab, "DICTIONARY_ROWS", 2)
    df = words(spark, "a b c a")
    found = vocab.fit_vocabulary(df, "id", "tokens")
    assert vocab.freeze(found) is None
    assert vocab.encode(df, "tokens", found, "ids", 0, key="id").first()["ids"] == [2, 3, 4, 2]


def test_hashed_grams(spark):
    df = spark.createDataFrame([([2, 3, 4],)], "ids array<int>")
    row = df.select(vocab.hashed_bigrams(F.col("ids")).alias("b"), vocab.hashed_trigrams(F.col("ids")).alias("t")).first()
    size, p, q = 250499, 14918087, 18408749
    assert row["b"] == [0, 2 * p % size, 3 * p % size]
    assert row["t"] == [0, 2 * p % size, (2 * p * q + 3 * p) % size]
    big = spark.createDataFrame([([2**31 - 1, 2**31 - 1, 0],)], "ids array<int>")
    assert big.select(vocab.hashed_trigrams(F.col("ids")).alias("t")).first()["t"][2] == ((2**31 - 1) * (p * q + p)) % size


def test_char_grams(spark):
    df = spark.createDataFrame([(1, "Ab  \n\nÉd"), (2, "xy")], "id int, c string")
    rows = {r["id"]: r["g"] for r in df.select("id", vocab.char_grams(F.col("c"), 3, 4).alias("g")).collect()}
    assert rows[1] == ["ab ", "b é", " éd", "ab é", "b éd"] and rows[2] == []


def test_subwords(spark):
    texts_ = [(i, "if(x) foo_bar" if i < 3 else "zz") for i in range(4)]
    df = spark.createDataFrame(texts_, "id int, code string")
    features, counts = vocab.subword_features(df, df, "id", "code", min_df=3)
    chars = {r["term"] for r in features.filter("kind = 'char'").collect()}
    assert "if(" in chars and "foo" in chars and "o_" not in chars and not any(" " in c for c in chars)
    terms = {r["term"] for r in features.filter("kind = 'word'").collect()}
    assert "zz" in terms and "foo" not in terms
    indexes = sorted(r["idx"] for r in features.collect())
    assert indexes == list(range(len(indexes)))
    idx = features.filter("kind = 'char' AND term = 'fo'").first()
    assert idx is None or counts.filter(F.col("idx") == idx["idx"]).count() == 3


def test_document_vectors(spark):
    df = words(spark, "a a b q").unionByName(words(spark, "q", 2))
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0])], "term string, vec array<double>")
    rows = {r["id"]: r["vec"] for r in vectors.document_vectors(df, "id", "tokens", table, 2).collect()}
    assert rows == {1: [2.0, 1.0], 2: [0.0, 0.0]}


def test_parallel_map(spark):
    df = spark.createDataFrame([(i, f"t{i}", i * 2) for i in range(20)], "id int, a string, b int")
    from pyspark.sql import types as T

    one = parallel.parallel_map(df, str.upper, T.StringType(), "id", "a", ordered=True, workers=3)
    assert [r["result"] for r in one.collect()] == [f"T{i}" for i in range(20)]
    both = parallel.parallel_map(df, lambda r: r["b"] + len(r["a"]), T.IntegerType(), "id", ["a", "b"])
    assert {r["id"]: r["result"] for r in both.collect()}[12] == 24 + 3


# --- cleaning, splits, labels -----------------------------------------------------------------------


def test_every_duplicate_goes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, c string")
    assert sorted(r["id"] for r in clean.drop_all_duplicates(df, "c", "id").collect()) == [2, 4]


def test_missing_pairs_count_as_unchanged(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "a", "a")], "id int, x string, y string")
    assert [r["id"] for r in clean.changed_rows(df, "x", "y").collect()] == [2]


def test_splits(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    exact = {r["partition"]: r["count"] for r in splits.assign_split(df, "k", exact=True).groupBy("partition").count().collect()}
    assert exact == {"train": 802, "test": 101, "valid": 100}
    one = {tuple(r) for r in splits.assign_split(df.repartition(1), "k", exact=True).collect()}
    seven = {tuple(r) for r in splits.assign_split(df.repartition(7), "k", exact=True).collect()}
    assert one == seven


def test_fold_sizes(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    folds = splits.contiguous_folds(df, "k", 3, quantile_bucket(df, "k"))
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sizes == {0: 4, 1: 3, 2: 4}
    roles = splits.fold_roles(folds, 3, "k").groupBy("round", "role").count().collect()
    assert {(r["round"], r["role"]): r["count"] for r in roles}[(0, "valid")] == 3


def test_unknown_label_fails(spark):
    df = spark.createDataFrame([("Q",)], "cvss2_C string")
    with pytest.raises(Exception, match="unknown cvss2_C label Q"):
        labels.encode_labels(df).collect()
    assert labels.encode_labels(df, on_unknown="null").first()["cvss2_C"] is None


def test_strict_lookup_fails(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    table = spark.createDataFrame([(1, 5, "x"), (1, 4, "y")], "id int, o int, label string")
    assert [tuple(r) for r in labels.lookup_labels(df, table, "id", "o", ["label"]).collect()] == [(1, "y")]
    with pytest.raises(Exception, match="no label for key 2"):
        labels.lookup_labels(df, table, "id", "o", ["label"], strict=True).collect()


def test_metrics_of_a_page(spark):
    page = '<a id="Cvss2CalculatorAnchor" href="#">7.5 HIGH</a><span class="x tooltipCvss2NistMetrics y">(AV:N/AC:L/Au:N/C:P/I:P/A:P)</span>'
    df = spark.createDataFrame([("CVE-1", page), ("CVE-2", "<p>gone</p>")], "`cve id` string, html string")
    fields = html.extract_metric_fields(df, "html", ["cve id"])
    metrics = labels.parse_metrics(fields)
    records = spark.createDataFrame([(1, "CVE-1"), (2, "CVE-2")], "id int, `CVE ID` string")
    rows = {r["id"]: r for r in labels.attach_metrics(records, metrics).collect()}
    assert (rows[1]["SCORE"], rows[1]["label"], rows[1]["AC"]) == (7.5, "HIGH", "L")
    assert (rows[2]["SCORE"], rows[2]["label"], rows[2]["A"]) == (-1.0, "-1", "-1")


# --- classifiers ------------------------------------------------------------------------------------


def points(spark, n=40):
    rows = [(i, i % 3, [float((i * 7) % 11), float((i * 5) % 13)]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, vec array<double>")


def test_neighbours_by_blocks_equal_broadcast(spark):
    train = points(spark)
    queries = spark.createDataFrame([(100 + i, [float(i), 2.5]) for i in range(9)], "qid bigint, vec array<double>")
    for norm in (1, 2):
        one = {tuple(r) for r in models.nearest_rows(train, queries, 4, norm).collect()}
        two = {tuple(r) for r in models.nearest_rows(train, queries, 4, norm, block_rows=8).collect()}
        assert one == two and len(one) == 36
    assert models.vote(models.nearest_rows(train, queries, 4), "distance").count() == 9


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    known, asked = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    known[200:] = known[0]  # a third of the rows in one cell, all ties
    train = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(known)], "id bigint, label int, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, vec array<double>")
    for norm in (1, 2):
        gap = np.abs(asked[:, None] - known[None])
        distance = gap.sum(-1) if norm == 1 else np.sqrt((gap * gap).sum(-1))
        want = {(q, int(i)) for q in range(40) for i in np.lexsort((np.arange(300), distance[q]))[:6]}
        rows = models.nearest_rows(train, queries, 6, norm, block_rows=25).collect()
        assert {(r["qid"], r["id"]) for r in rows} == want
    none = spark.createDataFrame([], "id bigint, label int, vec array<double>")
    assert models.nearest_rows(none, queries, 3).count() == 0


def test_neighbours_in_many_tasks(spark, monkeypatch):
    """Both sides of a part meet when no partitions are merged; huge and equal values, and cells of several parts."""
    rng = np.random.default_rng(4)
    known, asked = np.float32(rng.normal(size=(400, 5))).astype(float), np.float32(rng.normal(size=(60, 5))).astype(float)
    known[300:] = known[0]
    asked[:20] = known[:20]
    monkeypatch.setattr(models, "PART_ROWS", 60, raising=False)
    monkeypatch.setattr(models, "STEP_DISTANCES", 700, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for norm, scale in ((1, 1.0), (2, 1e20)):
            train = spark.createDataFrame([(i, i % 3, (v * scale).tolist()) for i, v in enumerate(known)], "id bigint, label int, vec array<double>")
            queries = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(asked)], "qid bigint, vec array<double>")
            gap = np.abs(asked[:, None] * scale - known[None] * scale)
            distance = gap.sum(-1) if norm == 1 else np.sqrt((gap * gap).sum(-1))
            want = {(q, int(i)) for q in range(60) for i in np.lexsort((np.arange(400), distance[q]))[:7]}
            rows = models.nearest_rows(train, queries, 7, norm, block_rows=40).collect()
            assert {(r["qid"], r["id"]) for r in rows} == want and len(rows) == 420
            assert [r["distance"] for r in rows] == pytest.approx([distance[r["qid"], r["id"]] for r in rows])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_word_vectors_in_several_tasks(spark):
    rng = np.random.default_rng(5)
    topics = [[f"{t}{i}" for i in range(8)] for t in ("sea", "sky")]
    texts = [(i, [str(w) for w in rng.choice(topics[i % 2], 12)]) for i in range(600)]
    df = spark.createDataFrame(texts, "id int, tokens array<string>").repartition(4)
    model = vectors.fit_word_vectors(df, "tokens", size=16, epochs=10, task_words=2_400)
    vec = {r["term"]: np.array(r["vec"]) for r in vectors.word_vector_table(model).collect()}
    unit = {w: v / np.linalg.norm(v) for w, v in vec.items()}
    near = [max((x for x in unit if x != w), key=lambda x: unit[w] @ unit[x])[:3] == w[:3] for w in unit]
    assert len(unit) == 16 and all(near)


def _brute_contexts(texts, trained, window):
    """Counts of (word, number of a trained word) by looking at every pair of places."""
    number = {w: i for i, w in enumerate(trained)}
    found = {}
    for words in texts:
        places = [i for i, w in enumerate(words) if w in number]
        for i, w in enumerate(words):
            near = [j for j in places if j != i and abs(j - i) <= window]
            if not near and w not in number:
                near = [j for j in places if j < i][-1:] + [j for j in places if j > i][:1]
            for j in near:
                found[w, number[words[j]]] = found.get((w, number[words[j]]), 0) + 1
    return found


def test_context_counts_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [[f"w{int(x)}" for x in rng.zipf(1.4, int(k)) % 60] for k in rng.integers(0, 60, 80)]
    rows = [(t,) for t in texts + [["w1"], ["lone"], ["x"] * 30 + ["w2"], []]] + [(None,)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    trained = ["w1", "w2", "w3", "w4", "never"]
    want = _brute_contexts([t for (t,) in rows if t], trained, 4)
    for words, pairs in ((200_000, 4_000_000), (50, 100)):
        monkeypatch.setattr(vectors, "SLICE_WORDS", words)
        monkeypatch.setattr(vectors, "HELD_PAIRS", pairs)
        got = vectors.context_counts(df, "tokens", trained, 4).collect()
        assert {(r["term"], r["ctx"]): r["n"] for r in got} == want and len(got) == len(want)
    assert vectors.context_counts(df, "tokens", [], 4).count() == 0


def test_context_means_over_small_batches(spark):
    matrix = np.arange(12.0).reshape(4, 3)
    counts = [("a", 0, 3), ("a", 1, 1), ("a", 3, 2), ("b", 2, 5), ("c", 0, 1), ("c", 3, 1)]
    terms = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "term string")
    pairs = spark.createDataFrame([*counts, ("dropped", 1, 4)], "term string, ctx int, n bigint")
    want = {"none": [0.0] * 3}
    for w in "abc":
        n = np.array([k for t, _, k in counts if t == w], float)
        want[w] = list(n @ matrix[[c for t, c, _ in counts if t == w]] / n.sum())
    for size in ("1", "2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r["term"]: r["vec"] for r in vectors.context_means(terms, pairs, matrix).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == set(want) and all(np.allclose(got[w], want[w]) for w in want)


def test_pair_counts_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [[f"w{int(x)}" for x in rng.zipf(1.4, int(k)) % 60] for k in rng.integers(0, 60, 80)] + [["w1"], ["x", "w2", None, "w2"], []]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "tokens array<string>").repartition(3)
    trained = ["w1", "w2", "w3", "w4", "never"]
    want = {}
    for words in texts:
        numbers = [trained.index(w) for w in words if w in trained]
        for i, one in enumerate(numbers):
            for j in range(max(0, i - 4), min(len(numbers), i + 5)):
                if i != j:
                    want[one, numbers[j]] = want.get((one, numbers[j]), 0) + 5 - abs(i - j)
    for words, pairs in ((200_000, 4_000_000), (50, 100)):
        monkeypatch.setattr(vectors, "SLICE_WORDS", words)
        monkeypatch.setattr(vectors, "HELD_PAIRS", pairs)
        got = vectors.pair_counts(df, "tokens", trained, 4).collect()
        assert {(r["word"], r["ctx"]): r["n"] for r in got} == want and len(got) == len(want)
    assert vectors.pair_counts(df, "tokens", [], 4).count() == 0


def test_slopes_equal_softmax(spark, monkeypatch):
    rng = np.random.default_rng(13)
    counts = rng.integers(0, 4, (9, 9))
    counts = counts + counts.T
    counts[7], counts[:, 7] = 0, 0  # a word that meets no other
    met = [i for i in range(9) if i != 7]
    rows = [(i, [int(j) for j in np.flatnonzero(counts[i])], [float(n) for n in counts[i][counts[i] > 0]]) for i in met]
    table = spark.createDataFrame(rows, "word int, ctx array<int>, n array<float>").repartition(2)
    word, context = rng.normal(size=(2, 9, 5)).astype("float32")
    totals = counts.sum(1).astype("float32")
    scores = word @ context.T
    share = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    miss = counts - totals[:, None] * share
    for size in (256, 2):
        monkeypatch.setattr(vectors, "TASK_TERMS", size)
        slope, norms = vectors._slopes(table, word, context, totals, None)
        assert np.allclose(slope[met], (miss @ context / np.maximum(totals, 1)[:, None])[met], atol=1e-4) and not slope[7].any()
        assert np.allclose(norms[met], np.log(np.exp(scores).sum(1))[met], atol=1e-4)
        slope, _ = vectors._slopes(table, context, word, totals, norms)
        assert np.allclose(slope[met], (miss.T @ word / np.maximum(totals, 1)[:, None])[met], atol=1e-4)


def test_word_vectors_cost_no_more_for_repeated_texts(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [([str(w) for w in rng.choice([f"w{i}" for i in range(20)], 12)],) for _ in range(200)]
    known, pairs = [], vectors._slopes
    monkeypatch.setattr(vectors, "_slopes", lambda table, *some: known.append(table.count()) or pairs(table, *some))
    made = []
    for times in (1, 1, 3):  # the same vectors again, and from three times the texts
        model = vectors.fit_word_vectors(spark.createDataFrame(rows * times, "tokens array<string>"), "tokens", size=8, epochs=2, task_words=500)
        made.append({r["term"]: r["vec"] for r in vectors.word_vector_table(model).collect()})
    assert set(known) == {20} and len(known) == 3 * 2 * 2 * vectors.EPOCH_STEPS
    assert all(np.allclose(made[0][w], x[w], atol=1e-3) for x in made[1:] for w in x) and set(made[0]) == set(made[2])
    none = vectors.fit_word_vectors(spark.createDataFrame([(None,), (["alone"] * 1,)], "tokens array<string>"), "tokens", size=4)
    assert vectors.word_vector_table(none).count() == 0


def test_vectors_of_all_words(spark):
    rng = np.random.default_rng(6)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sea", "sky")]
    # The last six words of a topic are too rare for the trainer's ten or so.
    odds = np.array([1.0] * 6 + [0.05] * 6)
    texts = [[str(w) for w in rng.choice(topics[i % 2], 12, p=odds / odds.sum())] for i in range(600)]
    rows = [(t,) for t in [*texts, ["far", "off"], ["far", "off"], ["once"], []]] + [(None,)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(4)
    options = dict(size=16, epochs=10, max_vocab=12, task_words=2_400)
    vec = {r["term"]: np.array(r["vec"]) for r in vectors.all_word_vectors(df, "tokens", **options).collect()}
    assert set(vec) == {w for t in topics for w in t} | {"far", "off"}
    assert not vec.pop("far").any() and not vec.pop("off").any()
    unit = {w: v / np.linalg.norm(v) for w, v in vec.items()}
    near = [max((x for x in unit if x != w), key=lambda x: unit[w] @ unit[x])[:3] == w[:3] for w in unit]
    assert all(near)
    # Everything fits: the trainer's own vectors.
    assert vectors.all_word_vectors(df.filter("get(tokens, 0) != 'far'"), "tokens", size=8, epochs=1).count() == 24
    assert vectors.all_word_vectors(df.limit(0), "tokens", size=8).count() == 0
    none = vectors.all_word_vectors(df, "tokens", size=4, max_vocab=0)
    assert {tuple(r["vec"]) for r in none.collect()} == {(0.0,) * 4} and none.count() == 26


def test_vocabulary_counts_in_a_hash_table(spark):
    rows = [(5, ["c", "b", "a"]), (None, ["z", "y"]), (-7, ["q", "p"]), (5, ["d", "b", "b"]), (2**63 - 1, ["n", "a"]), (-(2**63), ["m"]), (None, ["y"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    for keyed in (df, df.withColumn("k", F.col("k").cast("string"))):
        first = {}
        number = keyed.schema["k"].dataType.typeName() == "long"
        for k, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0 if number else str(r[0]))):
            for p, t in enumerate(tokens):
                place = (k is not None, (k or 0) if number else str(k), p)
                n, least = first.get(t, (0, place))
                first[t] = (n + 1, min(least, place))
        order = sorted(first, key=lambda t: (-first[t][0], first[t][1]))
        found = vocab.fit_vocabulary(keyed, "k", "tokens")
        assert {r["token"]: r["id"] for r in found.collect()} == {t: i + 2 for i, t in enumerate(order)}
    plan = vocab.fit_vocabulary(df, "k", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_vocabulary_of_word_vectors_is_bounded(spark):
    rows = [("a", 9), ("b", 7), ("c", 7), ("d", 2), ("e", 1)]
    counted = spark.createDataFrame(rows, "term string, tf bigint")
    assert vectors.frequent_enough(counted, 2, 10) == (2, 26)
    assert vectors.frequent_enough(counted, 2, 3) == (7, 26)
    assert vectors.frequent_enough(counted, 2, 2) == (9, 26)  # equal counts stay together
    assert vectors.frequent_enough(counted.limit(0), 2, 2) == (2, 0)


def test_frequent_value_is_cut_by_ties(spark):
    hot = F.when(F.col("id") % 10 != 0, 7).otherwise((F.col("id") % 13).cast("int"))
    df = spark.range(5000).select(hot.alias("o"), F.col("id").alias("t"))
    bucket = quantile_bucket(df, "o", tie="t")
    largest = df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 5000 / 64
    rows = row_index(df, "n", [F.col("o"), F.col("t")], bucket).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["o"], r["t"]))] == list(range(5000))


def test_zero_distance_decides(spark):
    near = spark.createDataFrame([(1, 5, 0, 0.0), (1, 6, 1, 0.1), (1, 7, 1, 0.1)], "qid int, id int, label int, distance double")
    assert models.vote(near, "distance").first()["prediction"] == 0
    assert models.vote(near).first()["prediction"] == 1


def test_baseline_end_to_end(spark):
    rows = []
    for i in range(60):
        kind = "strcpy(a, b);" if i % 2 else "free(p);"
        part = "train" if i < 40 else "valid" if i < 50 else "test"
        rows.append((i, f"int f{i}() {{\n{kind}\nreturn {i};\n}}", [2], "P" if i % 2 else "N", part))
    df = spark.createDataFrame(rows, "id int, func_before string, delete_lines array<int>, cvss2_C string, partition string")
    scoped = baseline.scope_table(df, "whole")
    for features in (baseline.word_features(scoped), baseline.subword_vectors(scoped, min_df=5)):
        results, best = baseline.run_baseline(features, ["cvss2_C"], ["rf"], {"rf": (("3", "5"), ("4",))})
        assert results.count() == 2 and best.count() == 1
        assert best.first()["test_accuracy"] == 1.0


# --- sources, streams, plans ------------------------------------------------------------------------


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('Unnamed: 0,code,n\n1,"a ""x""\n b, c",2\n2,,3\n')
    df = tables.read_csv(spark, str(path), "`Unnamed: 0` bigint, code string, n int")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a "x"\n b, c', 2), (2, None, 3)]


def test_result_files(spark, tmp_path):
    for name in ("code_hc_word_3_x.csv", "code_hc_word_cvss2_C_3_x.csv", "other.csv"):
        (tmp_path / name).write_text("mcc\n0.5\n")
    five = tables.read_results(spark, str(tmp_path), 5, "mcc double")
    seven = tables.read_results(spark, str(tmp_path), 7, "mcc double")
    assert [(r["mcc"], r["fold"]) for r in five.collect()] == [(0.5, "3")]
    assert [(r["scenario"], r["fold"]) for r in seven.collect()] == [("cvss2_C", "3")]


def test_result_files_by_header(spark, tmp_path):
    (tmp_path / "code_hc_word_3_x.csv").write_text("mcc,f1\n0.1,0.2\n")
    (tmp_path / "code_hc_word_4_x.csv").write_text("f1,mcc\n0.4,0.3\n")
    (tmp_path / "code_hc_word_5_x.csv").write_text("mcc\n0.5\n")
    (tmp_path / "code_hc_word_cvss3_C_3_x.csv").write_text("mcc\n0.9\n")
    rows = tables.read_results(spark, str(tmp_path), 5, "mcc double, f1 double").collect()
    assert {r["fold"]: (r["mcc"], r["f1"]) for r in rows} == {"3": (0.1, 0.2), "4": (0.3, 0.4), "5": (0.5, None)}
    assert tables.read_results(spark, str(tmp_path), 7, "mcc double").count() == 0
    with pytest.raises(ValueError, match="not in the schema"):
        tables.read_results(spark, str(tmp_path), 5, "mcc double").count()


def test_result_files_in_all_shapes(spark, tmp_path):
    bodies = {
        "0": ' "mcc" , f1\r\n0.5,"1"\r\n\r\n,2\r\n',  # blanks and quotes, an empty line, an empty cell
        "1": ",f1,mcc\n9,0.25,NaN\n",  # an index column without a name
        "2": "Unnamed: 0,mcc\n1,x\n2,1e-3",  # no number, no last line end
        "3": "mcc\n",
        "4": "",
        "5": "f1\n1\n1\n",  # equal rows stay
    }
    for fold, body in bodies.items():
        (tmp_path / f"code_hc_word_{fold}_x.csv").write_bytes(body.encode())
    got = tables.read_results(spark, str(tmp_path), 5, "mcc double, f1 double")
    assert got.columns == ["feature_type", "feature_scope", "token", "fold", "mcc", "f1"]
    rows = sorted((r["fold"], str(r["mcc"]), str(r["f1"])) for r in got.collect())
    assert rows == [
        ("0", "0.5", "1.0"), ("0", "None", "2.0"), ("1", "nan", "0.25"), ("2", "0.001", "None"), ("2", "None", "None"),
        ("5", "None", "1.0"), ("5", "None", "1.0"),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and "Union" not in plan
    (tmp_path / "code_hc_word_6_x.csv").write_text("mcc,f1,a,b\n1,2,3,4\n")
    with pytest.raises(ValueError, match="not in the schema"):
        tables.read_results(spark, str(tmp_path), 5, "mcc double, f1 double")


def test_one_file_per_row(spark, tmp_path):
    rows = [("a.txt", "é\n"), ("b.txt", None), (None, "lost"), ("c.txt", "x" * 300_000)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    folder = files.write_files(df, str(tmp_path / "new" / "folder"), "name", "text")
    found = {r["file"]: r["value"] for r in spark.read.text(folder, wholetext=True).selectExpr("_metadata.file_name AS file", "value").collect()}
    assert found == {"a.txt": "é\n", "c.txt": "x" * 300_000} | ({"b.txt": ""} if "b.txt" in found else {})
    assert sorted(os.listdir(folder)) == ["a.txt", "b.txt", "c.txt"]
    assert os.listdir(files.write_files(df.limit(0), str(tmp_path / "none"), "name", "text")) == []


def test_encoding_above_the_dictionary_limit(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b a = z", "a b"), (2, "b a = z", None), (3, "", "c")], "id int, one string, two string")
    found = vocab.fit_vocabulary(words(spark, "a b c a = = ="), "id", "tokens")
    model = {"length": 3, "unknown": 0, "pad": 1}
    small = vocab.encode_text(df, ["one", "two"], found, model).orderBy("id").collect()
    plain = vocab.decode(df.select(F.array(F.lit(0), F.lit(3), F.lit(1)).alias("ids")), "ids", found, "out", 1, ["<unk>", "<pad>"]).collect()
    monkeypatch.setattr(vocab, "DICTIONARY_ROWS", 1)
    monkeypatch.setattr(vocab, "FREQUENT", 1)
    monkeypatch.setattr(vocab.fits_dictionary, "__defaults__", (1,))
    assert vocab.encode_text(df, ["one", "two"], found, model).orderBy("id").collect() == small
    assert vocab.decode(df.select(F.array(F.lit(0), F.lit(3), F.lit(1)).alias("ids")), "ids", found, "out", 1, ["<unk>", "<pad>"]).collect() == plain


def test_project_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "linux"), (2, "php")], "id int, project string")
    path = tables.write_by_project(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("project=*")) == ["project=linux", "project=php"]
    assert spark.read.parquet(path).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"int f() {{\n  // c{i}\n  return {i};\n}}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, code string")
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    batch = texts.prepare_stream(df, "id", "code")
    found = vocab.freeze(vocab.fit_vocabulary(batch, "id", "tokens", 20))
    expected = {tuple(map(str, r)) for r in texts.encode_stream(batch, found, vocab.GRAPH_MODEL).collect()}
    stream = texts.prepare_stream(spark.readStream.schema(df.schema).parquet(source), "id", "code")
    encoded = texts.encode_stream(stream, found, vocab.GRAPH_MODEL)
    path = texts.run_available(encoded, str(tmp_path / "out"), str(tmp_path / "state"))
    texts.run_available(encoded, path, str(tmp_path / "state"))  # a second run finds nothing new
    assert {tuple(map(str, r)) for r in spark.read.parquet(path).collect()} == expected


def test_dataset_plan(spark):
    before = "int f(int a)\n{\n  if (a) {\n    x = 1; // old\n  }\n  return x;\n}\n"
    after = before.replace("x = 1; // old", "x = 2;")
    raw = spark.createDataFrame(
        [(1, before, after, 1), (2, before, before, 1), (3, "b;\n", "c;\n", 1), (4, "d;\n", "e;\n", 1), (5, "g;\n", "h;\n", 0)],
        "id bigint, func_before string, func_after string, del_lines int",
    )
    metrics = spark.createDataFrame(
        [(i, f"CVE-{i}", "HIGH", "N", "L", "N", "P", "P", "-1" if i == 4 else "P") for i in range(1, 6)],
        "id bigint, `CVE ID` string, label string, AV string, AC string, AU string, C string, I string, A string",
    )
    cleaned = dataset.clean_functions(dataset.label_functions(raw, metrics))
    rows = {r["id"]: r for r in cleaned.collect()}
    assert sorted(rows) == [1, 3]
    assert rows[1]["delete_lines"] == rows[1]["add_lines"] == [4] and rows[1]["cvss2_AC"] == "L"
    rejects = spark.createDataFrame([("3", "no edges")], "graph_id string, reason string")
    gated = dataset.gate_functions(cleaned, rejects)
    blamed = spark.createDataFrame([(1, "c0", None, after)], "id bigint, blaming_commit string, blaming_func_before string, blaming_func_after string")
    merged = dataset.split_functions(dataset.merge_history(gated, blamed)).first()
    assert merged["blaming_delete_lines"] == [] and merged["blaming_add_lines"] == list(range(1, 8))
    assert merged["pre_context"] == "" and "if (a) {" in merged["cur_context"]
    assert merged["partition"] in ("train", "test", "valid")


def test_blame_and_match(spark):
    deleted = spark.createDataFrame(
        [(1, "p", "a/x.c", 10, 100, "a/x.c"), (1, "p", "y.c", 20, 100, "a/x.c"), (2, "p", "y.c", 20, 100, "none.c")],
        "fix_id int, project string, file string, line_key int, fix_ts int, fix_file string",
    )
    lines = spark.createDataFrame(
        [("p", "a/x.c", 10, "c1", 5), ("p", "a/x.c", 10, "c2", 50), ("p", "a/x.c", 10, "c3", 100), ("p", "y.c", 20, "c4", 7)],
        "project string, file string, line_key int, commit string, commit_ts int",
    )
    bucket = quantile_bucket(lines.withColumnRenamed("commit_ts", "ts"), "ts", 4)
    found = H.blame_candidates(deleted, lines, bucket)
    assert sorted((r["fix_id"], r["commit"]) for r in found.collect()) == [(1, "c2"), (2, "c4")]
    fixes = spark.createDataFrame([(1, "a/x.c", "int *foo(int a)\n{}"), (2, "d/y.c", "void bar(void)\n{}")], "fix_id int, file_name string, func_before string")
    methods = spark.createDataFrame(
        [("c2", "a/x.c", 0, "other", "other()", 1, 1, 1, 1), ("c2", "a/x.c", 1, "foo", "foo( int a )", 2, 3, 1, 2),
         ("c4", "y.c", 0, "my_bar_x", "my_bar_x(int)", 1, 1, 1, 1)],
        "commit string, file string, position int, name string, long_name string, before_start int, before_end int, after_start int, after_end int",
    )
    files = spark.createDataFrame([("c2", "a/x.c", "l1\nl2\nl3", "n1\nn2"), ("c4", "y.c", "q", "r")], "commit string, file string, source_before string, source_after string")
    rows = {r["fix_id"]: tuple(r)[1:] for r in H.introducing_functions(fixes, found, methods, files).collect()}
    assert rows == {1: ("c2", "l2\nl3", "n1\nn2"), 2: ("c4", "q", "r")}
    plan = history_plan.blame_fixes(fixes, deleted, lines, methods, files, bucket)
    assert sorted(r["id"] for r in plan.collect()) == [1, 2]
    tiers = {r["fix_id"]: r["tier"] for r in H.match_methods(fixes, found, methods).collect()}
    assert tiers == {1: 1, 2: 2}


def test_stage_paths_are_fresh(spark):
    assert stage_path(spark, "a") != stage_path(spark, "a")
    assert json.dumps(tables.RESULT_LAYOUTS[5]) == '["feature_type", "feature_scope", "token", "fold"]'

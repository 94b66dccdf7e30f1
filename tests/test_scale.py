"""Steps that have to stand large tables: no table is sent whole to the driver, and repeated rows are not paired."""

import re
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultline import cluster
from faultline.operators import grams
from faultline.operators import graph as G
from faultline.operators import history as H
from faultline.operators import runs as R
from faultline.operators import models, vectors, vocab
from faultline.registry import QUERIES
from faultline.sources import files
from faultline.sources import graphs as S


def never_broadcast(df):
    """Whether no join of the plan sends a table to all tasks, however small it is estimated."""
    return "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_methods_and_fixes_are_not_paired(spark):
    n = 60_000
    ids = spark.range(n)
    name = F.when(F.col("id") % 2 == 0, "find_ring").otherwise("gear")
    methods = ids.select(
        F.lit(7).cast("bigint").alias("commit"), F.lit("lib/a.c").alias("file"), (n - F.col("id")).alias("position"),
        name.alias("name"), F.concat(name, F.lit(" ( int x )")).alias("long_name"),
    )
    function = F.when(F.col("id") % 2 == 0, "ring").otherwise("gear")
    fixes = ids.select(
        F.col("id").alias("fix_id"), F.lit("src/a.c").alias("file_name"), F.concat(F.lit("int "), function, F.lit(" (int x)\n{}")).alias("func_before")
    )
    candidates = ids.select(F.col("id").alias("fix_id"), F.lit(3).alias("commit_ts"), F.lit(7).cast("bigint").alias("commit"))
    started = time.time()
    found = H.match_methods(fixes, candidates, methods).groupBy((F.col("fix_id") % 2).alias("odd"), "tier", "commit", "file", "position").count()
    # All pairs would be 1.8 billion, minutes of work.
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2, 7, "lib/a.c", 2, n // 2), (1, 1, 7, "lib/a.c", 1, n // 2)]
    assert time.time() - started < 60


def test_introducing_functions_send_no_table_to_the_driver(spark):
    fixes = spark.createDataFrame([(1, "a.c", "int f (int x)\n{}")], "fix_id long, file_name string, func_before string")
    candidates = spark.createDataFrame([(1, 7, 1)], "fix_id long, commit long, commit_ts long")
    methods = spark.createDataFrame(
        [(7, "b/a.c", 0, "f", "f ( int x )", 1, 1, 1, 1)],
        "commit long, file string, position long, name string, long_name string, before_start int, before_end int, "
        "after_start int, after_end int",
    )
    files = spark.createDataFrame([(7, "b/a.c", "old", "new")], "commit long, file string, source_before string, source_after string")
    found = H.introducing_functions(fixes, candidates, methods, files)
    assert never_broadcast(found)
    assert [tuple(r) for r in found.collect()] == [(1, 7, "old", "new")]


def test_lines_of_locals_send_no_table_to_the_driver(spark):
    nodes = spark.createDataFrame(
        [(1, "10", "LOCAL", "v", None), (1, "5", "TYPE", "int", None), (1, "11", "BLOCK", "", 2), (2, "10", "LOCAL", "w", None),
         (2, "5", "TYPE", "int", None), (2, "12", "CALL", "", None)],
        "graph_id long, id string, label string, name string, line int",
    )
    edges = spark.createDataFrame(
        [(g, a, b, kind) for g, up in ((1, "11"), (2, "12")) for a, b, kind in (("10", "9", "REF"), ("9", "5", "EVAL_TYPE"), (up, "10", "AST"))],
        "graph_id long, innode string, outnode string, etype string",
    )
    lines = spark.createDataFrame([(1, i, "int v;") for i in (1, 3, 4)], "graph_id long, line_no int, text string")
    assigned, rejects = G.assign_lines_to_locals(nodes, edges, lines)
    assert never_broadcast(assigned) and never_broadcast(rejects)
    assert [tuple(r) for r in assigned.collect()] == [(1, "10", 3)]
    assert [tuple(r) for r in rejects.collect()] == [(2, "not one enclosing block")]


def _log_runs(spark):
    epoch = "Epoch {0}/9\n - {0}s - loss: 0.5\nValidation time: {0}.5 s.\nSaving best model at epoch {0}\n".format
    text = "Current partition: 0\nRun # 0\n" + epoch(1) + epoch(2) + "Evaluating the best model on valid\nx\n"
    text += "Evaluating the best model on test\nValidation time: 7.5 s.\nRun # 1\n" + epoch(1) + epoch(3)
    return R.log_runs(spark.createDataFrame([("a", text)], "path string, text string"))


def test_log_times_send_no_table_to_the_driver(spark):
    runs = _log_runs(spark)
    times = R.log_times(runs, R.log_epochs(runs))
    assert never_broadcast(times)
    columns = ["run", "number_of_epoch_at_best_model", "total_train_time_at_finish", "final_evaluation_time"]
    assert sorted(tuple(r) for r in times.select(*columns).collect()) == [(0, 2, 3, 7.5), (1, 3, 4, None)]


def test_log_times_read_the_epochs_once(spark):
    block = "Epoch 1/9\n - 3s - loss: 1\nValidation time: 1.5 s.\nSaving best model at epoch 1\nEpoch 2/9\n - 4s - loss: 1\nValidation time: 2.5 s.\n"
    text = f"Current partition: 0\nRun # 0\n{block}Evaluating the best model on valid\nx\nEvaluating the best model on test\nValidation time: 7.5 s.\n"
    logs = spark.createDataFrame([("a", text), ("a", text), ("b", text)], "path string, text string")
    runs = R.log_runs(logs)
    times = R.log_times(runs, R.log_epochs(runs))
    plan = times._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window") == 1
    columns = ["path", "number_of_epoch_at_best_model", "total_train_time_at_best_model", "total_train_time_at_finish", "final_evaluation_time"]
    found = sorted(tuple(r) for r in times.select(*columns).collect())
    assert found == [("a", 1, 6, 14, 7.5), ("a", 1, 6, 14, 7.5), ("b", 1, 3, 7, 7.5)]


def test_log_violations_keep_epochs_single(spark):
    runs = _log_runs(spark)
    found = R.log_violations(runs, R.log_epochs(runs), partitions=1, runs_each=2)
    # Several distinct counts in one step multiply its rows.
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 1, "epoch numbers"), ("a", 0, 1, "evaluation blocks")]


@pytest.mark.parametrize("query", ["streamed_functions", "streamed_token_ids"])
def test_streams_read_tables_of_one_and_of_many_files(spark, tmp_path, query):
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("a b\nc").alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    pq.write_table(pa.table({"doc_id": range(8), "text": ["a b\nc"] * 8}), tmp_path / "one" / "documents.parquet")
    rows = [sorted(tuple(r) for r in QUERIES[query](spark, str(tmp_path / kind)).collect()) for kind in ("many", "one")]
    assert len(rows[0]) == 8 and rows[0] == rows[1]


def test_pairing_keys_pass_64_bits(spark, tmp_path):
    rows = [(9_000_000 + i, i, 1, 1, float(i % 5), 0.1, "R", "OF"[i % 2]) for i in range(40)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["signed_rank_test"](spark, str(tmp_path)).collect()
    assert len(found) == 1 and found[0]["n"] > 0
    assert len(QUERIES["compared_results"](spark, str(tmp_path)).collect()) == 4


def test_files_are_listed_and_read_by_the_tasks(spark, tmp_path):
    texts = spark.range(300).select(F.concat(F.col("id").cast("string"), F.lit(".c")).alias("name"), F.concat(F.lit("ä\r\n"), "id").alias("text"))
    flat, sliced = (files.write_files(texts, str(tmp_path / str(s)), "name", "text", sliced=s) for s in (False, True))
    for name in ("empty.c", "_hidden.c", ".hidden.c", "other.txt"):
        (tmp_path / "False" / name).write_text("" if name == "empty.c" else "x")
    (tmp_path / "False" / "sub").mkdir()
    (tmp_path / "False" / "sub" / "1.c").write_text("x")
    for folder in (flat, sliced):
        found = files.read_files(spark, folder, ".c")
        # A scan of files would list them on the driver.
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted((f"{i}.c", f"ä\r\n{i}") for i in range(300))
    assert S.read_texts(spark, sliced, ".c", "code").filter("graph_id = '7'").first()["code"] == "ä\r\n7"


def test_document_vectors_shuffle_texts_only(spark):
    words = [("a" * n, [float(n), None if n == 9 else 1.0]) for n in range(1, 10)] + [("none", None)]
    table = spark.createDataFrame(words, "term string, vec array<double>")
    tokens = ["a" * (1 + i * i % 7) for i in range(127)]
    tokens += ["a" * 9, "none", "unknown"]
    docs = spark.createDataFrame([(1, tokens), (2, ["unknown"]), (2, ["a"]), (3, None)], "id long, tokens array<string>")
    found = vectors.document_vectors(docs, "id", "tokens", table, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # One row per text is shuffled, no row per text and word.
    assert plan.count("Exchange hashpartitioning") == 2
    known = [len(t) for t in tokens[:128]]
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, [sum(known) / 128, 127 / 128]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])
    ]


@pytest.mark.parametrize("alphabet", ["ab \n", "abcdefghijk éß😀", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 4_000))])
def test_grams_are_counted_in_the_tasks(spark, monkeypatch, alphabet):
    at = iter(range(10**6))
    texts = ["".join(alphabet[next(at) ** 2 * 7919 % len(alphabet)] for _ in range(n)) for n in (0, 1, 2, 5, 40, 2_500)]
    rows = [*enumerate(texts), (9, texts[4]), (4, texts[5]), (None, texts[3]), (None, texts[3]), (10, None)]
    df = spark.createDataFrame(rows, "id long, c string").repartition(3)
    found = vocab.fit_char_grams(df, "c", 2, 8, min_df=2)
    # One row per gram of a task is shuffled, no row per text and gram.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    each = [(key, {g for g in _grams(text, 2, 8)}) for key, text in rows if text is not None]
    df_of = {g: sum(g in s for _, s in each) for _, s in each for g in s}
    assert {r["term"]: r["df"] for r in found.collect()} == {g: n for g, n in df_of.items() if n >= 2}

    terms = vocab.index_terms(found.select("term"))
    idx = {r["term"]: r["idx"] for r in terms.collect()}
    want = Counter((key, idx[g]) for key, text in rows for g in _grams(text, 2, 8) if g in idx)
    assert want
    got = vocab.char_counts(df, "id", "c", terms, 2, 8)
    assert sorted(map(str, got.collect())) == sorted(f"Row(id={k}, idx={i}, tf={n})" for (k, i), n in want.items())
    vecs = models.gram_count_vectors(df, "c", terms, 2, 8)
    assert "Generate" not in vecs._jdf.queryExecution().executedPlan().toString()
    sums = Counter()
    for r in vecs.collect():
        assert len(r["features"]) == len(idx)
        sums.update({(r["id"], int(i)): int(n) for i, n in zip(r["features"].indices, r["features"].values, strict=True)})
    assert sums == want
    monkeypatch.setattr(grams, "LISTED_GRAMS", 1)
    joined = vocab.char_counts(df, "id", "c", terms, 2, 8).collect()
    assert sorted(map(str, joined)) == sorted(f"Row(id={k}, idx={i}, tf={n})" for (k, i), n in want.items())


def _grams(text, low, high):
    text = re.sub(r"\s\s+", " ", text or "", flags=re.ASCII)
    return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


def test_steps_share_their_shuffles(spark):
    rows = [(g, f"n{i}", f"n{(i * 7 + g) % 9}") for g in (1, 2) for i in range(9)] + [(1, "n1", None), (2, None, "n3"), (None, "n1", "n2"), (1, "n1", "n2"), (1, "n1", "n2")]
    edges = spark.createDataFrame(rows, "graph_id long, innode string, outnode string")
    seeds = spark.createDataFrame([(1, "n1"), (1, "n1"), (1, "n4"), (2, "n3"), (2, None), (None, "n1"), (2, "none")], "graph_id long, seed string")
    pairs = {(g, a, b) for g, x, y in rows for a, b in ((x, y), (y, x)) if g and a}
    front, want = {(g, s, s) for g, s in [(1, "n1"), (1, "n4"), (2, "n3")]}, set()
    for hop in (1, 2, 3):
        front = {(g, s, b) for g, s, n in front for h, a, b in pairs if (h, a) == (g, n)}
        want |= {(g, s, hop, n) for g, s, n in front}
    got = [tuple(r) for r in G.neighbours(edges, seeds, 3).collect()]
    assert len(got) == len(want) and set(got) == want
    whole = G.neighbours(edges.dropna(), seeds, 3)
    whole.collect()
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Frontiers are not written, and the pairs are shuffled once for the three steps.
    assert "ExistingRDD" not in plan.replace("Scan ExistingRDD[graph_id", "") and "ReusedExchange" in plan
    assert len(G.neighbours(edges, seeds, 3, intermediate=False).collect()) == sum(h == 3 for _, _, h, _ in want)
    assert {tuple(r) for r in G.neighbours(edges, seeds, 1).collect()} == {r for r in want if r[2] == 1}


def test_dependences_use_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TASK_ROWS", 100)
    n = 500
    lines = spark.range(1, n + 1).select(F.lit(1).alias("graph_id"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("l"), "id").alias("text"))
    nodes = lines.select("graph_id", F.col("line_no").alias("line"))
    edges = lines.filter(f"line_no < {n}").select("graph_id", F.col("line_no").alias("innode"), (F.col("line_no") + 1).alias("outnode"), F.lit("CDG").alias("etype"))
    sets, texts = G.dependence_sets(nodes, edges), G.dependence_contexts(nodes, edges, lines)
    for found in (sets, texts):
        assert found.rdd.getNumPartitions() == 20
    assert {(r["line"], tuple(r["control"]), tuple(r["data"])) for r in sets.collect()} == {
        (i, tuple(k for k in (i - 1, i, i + 1) if 1 <= k <= n), (i,)) for i in range(1, n + 1)
    }
    assert {r["line"]: r["control"] for r in texts.collect()}[2] == "l1\nl2\nl3"


def test_frequent_tokens_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(vocab, "FREQUENT", 2)
    found = spark.createDataFrame([(t, i + 2) for i, t in enumerate("abcd")], "token string, id int")
    rows = [(1, list("abcdxa")), (1, list("abcdxa")), (2, ["a", None]), (3, []), (4, None), (5, ["x", "d", "d"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    ids = vocab.encode_joined(df, "tokens", found, "ids", 1, "id")
    # Tokens are unfolded once, for the join of the others.
    assert ids._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
    got = [(r["id"], r["ids"]) for r in ids.collect()]
    assert sorted(got, key=str) == sorted([(1, [2, 3, 4, 5, 1, 2])] * 2 + [(2, [2, 1]), (3, []), (4, None), (5, [1, 5, 5])], key=str)

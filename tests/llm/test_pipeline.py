"""The corpus pipeline against a plain version of its stages on a small fixture."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_corpus import SPACED, brute_components, brute_fingerprint, brute_targets, lowered, prose, ranked
from tokenizers import Tokenizer

from faultline.llm import quality


def tables(spark, folder):
    passage = prose(90, 14)
    docs = []
    for k in range(150):
        kind = ("good", "poor")[k % 3 == 0]
        text = " ".join([f"{kind}{j % 3}" for j in range(30)]) + " " + prose(k, 30)
        docs.append((k, text + (f" {passage} tail" if k % 10 == 4 else ""), "en", f"s{k % 4}", 5))
    docs += [(200, docs[1][1], "en", "s1", 5), (201, docs[1][1] + " end.", "en", None, 5), (202, None, "en", "s0", None), (203, "", None, "s0", 0)]
    labels = [(k, int(k % 3 != 0), int(k % 3 == 0)) for k in range(150)]
    items = [(1, passage), (2, None), (3, prose(91, 12))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_run_equals_the_plain_stages(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), quality.rating())
    good = {r.doc_id for r in quality.score(docs, model).filter("keep").collect()}
    assert 0 < len(good) < len(rows)
    left = [r for r in rows if r[0] in good]
    prints = [brute_fingerprint(r[1]) for r in left]
    groups = brute_components([r[0] for r in left], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    left = [r for r, g in zip(left, groups, strict=True) if r[0] == g]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words_of(t)] for k in range(max(1, len(w) - 9) if w else 0)}
    clean = lambda w: not any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))
    left = [r for r in left if clean(words_of(r[1]))]
    assert 0 < len(left) < len(good)
    size = lambda t: len(SPACED.findall(t or ""))
    sums = {}
    for r in left:
        sums[r[3]] = sums.get(r[3], 0) + size(r[1])
    mixed = []
    for source, target in brute_targets(sums).items():
        own = [(hashlib.md5(f"mix|{r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest(), r) for r in left if r[3] == source]
        passes = int(target) // sums[source] if sums[source] else 0
        rest = int(target) - passes * sums[source]
        for _, r in sorted(own):
            n = size(r[1])
            taken = passes * n + max(0, min(n, rest))
            rest -= n
            mixed += [r] * ((2 * taken + n) // (2 * n) if n else 1)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in sorted(mixed, key=lambda r: r[0])]
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    expected = [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(ids, starts, strict=False)]
    made = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert ranked(map(tuple, made)) == ranked(expected)

"""Personal data, filter audit and collocations against brute force and on odd inputs."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import SCHEMA, SPACED, lowered, prose, same, texts

from faultline.llm import audit, collocations, pii, spans


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 12 else "en", "s", None, "k", "f") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(text):
    """The base patterns as they are stated, tried at every position."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        twice = [2 * x - 9 * (x > 4) for x in d[1::2]]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(twice)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_personal_data_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "1", "22", "4111 1111 1111 1111", "255", "256", "é", "%", "(", ")", "+1 555 123 4567", "a@b.c"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.detect(text) == brute_spans(text), text


DISGUISED = [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("x é john (at) mail [dot] example (dot) org y", "email", "john (at) mail [dot] example (dot) org"),
    ("jоhn＠example．com", "email", "jоhn＠example．com"),
    ("a&#64;b&#46;com", "email", "a&#64;b&#46;com"),
    ("maria arroba correo punto es.", "email", "maria arroba correo punto es"),
    ("call plus four four seven seven zero zero nine zero zero one two", "phone", "plus four four seven seven zero zero nine zero zero one two"),
    ("é +1 555​ 123 4567 ok", "phone", "+1 555​ 123 4567"),
    ("+33 1 23 45 67 89", "phone", "+33 1 23 45 67 89"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ("vier eins eins eins 1111 1111 1111 1", None, None),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("192 [.] 168 [.] 0 [.] 1", "ip", "192 [.] 168 [.] 0 [.] 1"),
    ("we met at the dot com place at noon, one two", None, None),
    ("un point de vue at dot", None, None),
    ("plain a@b.com and +1 555 123 4567", None, None),
]


@pytest.mark.parametrize("text, kind, found", DISGUISED)
def test_disguised_personal_data(text, kind, found):
    base, spans_ = pii.find(text)
    added = [(pii.KINDS[k], text[a:b]) for a, k, b in spans_ if (a, k, b) not in base]
    assert added == ([(kind, found)] if kind else []) and set(base) <= set(spans_)


def test_rewriting_maps_back_every_position():
    rng = random.Random(5)
    for _ in range(500):
        source = "".join(rng.choice("abcdef") for _ in range(30))
        cuts = sorted(rng.sample(range(31), 2 * rng.randint(0, 5)))
        edits = [(a, b, rng.choice(["", "X"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        step = pii.Rewriting(source, edits)
        owner = []  # (first, end, replaced) of the source of each output character, one character at a time
        at = 0
        for first, end, new in edits:
            owner += [(k, k + 1, False) for k in range(at, first)] + [(first, end, True)] * len(new)
            at = end
        owner += [(k, k + 1, False) for k in range(at, len(source))]
        assert len(owner) == len(step.text)
        for i in range(len(owner)):
            for j in range(i + 1, min(len(owner), i + 6) + 1):
                a, b = owner[i][0], owner[j - 1][1]
                inside = any(a <= f and e <= b for f, e, _ in edits)
                assert step.source_span(i, j) == (a, b, inside)


def test_personal_data(spark, docs, empty):
    more = [(50, "é a@b.cd 10.0.0.1 x" * 40, "en", "s", None, "", ""), (50, "é a@b.cd 10.0.0.1 x" * 40, "en", "s", None, "", ""),
            (51, "a@" * 200_000, "en", "s", None, "", ""), (None, "+1 555 123 4567 " + "9" * 5000, "en", "s", None, "", "")]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    expected = []
    for r in both.collect():
        found = brute_spans(r.text or "") if r.doc_id != 51 else []
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        expected.append((r.doc_id, *(sum(k == n for _, k, _ in found) for n in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    made = pii.find_personal_data(both)
    same(made.drop("n_disguised"), expected)
    assert pii.find_personal_data(empty).count() == 0


def test_verified_spans():
    rng = random.Random(1)
    for _ in range(200):
        rows = [bytes(rng.choice(b"ab \xc3\xa9A#\n") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(rng.randint(0, 6))]
        data = np.frombuffer(b"".join(rows), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        found = audit.transduce(data, offsets)[0]
        for i, r in enumerate(rows):
            w = r.split()
            want = [len(w), len(set(w)), sum(65 <= b <= 90 for b in r), sum(b & 0xC0 != 0x80 for b in r), sum(b in b"#$%&*|" for b in r)]
            assert found[:, i].tolist() == want
            assert audit._long_text(np.frombuffer(r, np.uint8), 4).tolist() == want
    words = [b"x" * 70, b"x" * 69 + b"y", b"x" * 70, b"ab", b"ab", b"", b""]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert spans.representatives(data, starts, ends, np.zeros(7, np.int64)).tolist() == [0, 1, 0, 3, 3, 5, 5]
    column = pa.array(words, pa.binary()).slice(1, 5)
    assert [w for _, o, d in spans.blocks(column, 75) for w in [d[a:b].tobytes() for a, b in zip(o, o[1:], strict=False)]] == words[1:6]


def test_filter_audit(spark, docs, empty):
    rows = [(k, ("Word " * 30 + prose(k % 5, 100) + (" # $" if k % 7 == 0 else "")), ("en", "de", None)[k % 3]) for k in range(40)]
    rows += [(100, "AAA " * 20, "fr"), (100, "AAA " * 20, "fr"), (None, "AAA " * 20, "fr"), (None, None, "x"), (101, None, "x"), (102, "", "x")]
    table = spark.createDataFrame([(*r, r[1], 5) for r in rows], "doc_id long, text string, lang string, digest string, n_words int")
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(30)] + [(3, 1, 1), (None, 1, 1), (100, None, 1)]
    judged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fails = {}
    for i, t, lang in rows:
        t = t or ""
        w = SPACED.findall(t)
        failed = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        good = any(j == i and q == 1 for j, q, _ in labels if i is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if i is not None)
        fails.setdefault(lang or "", []).append(({x for x in failed if failed[x]}, good, toxic))
    expected, shares = [], {}
    for part, some in fails.items():
        for order in map("".join, permutations("ABCDE")):
            left = some
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                redundant = sum(x in f[0] for f in some) - len(gone)
                only = sum(f[0] == {x} for f in some)
                shares[part, x] = shares.get((part, x), 0) + len(gone)
                expected.append([part, order, step, len(left), len(gone), redundant, only, sum(f[1] for f in gone), sum(f[2] for f in gone), x])
    expected = [(*e[:-1], shares[e[0], e[-1]]) for e in expected]
    same(audit.audit(table, judged), expected)
    assert audit.audit(docs, judged.limit(0)).count() == 1200 and audit.audit(empty, judged).count() == 0


def brute_collocations(rows, least, top):
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = (lang, " ".join(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if len(w) > 1 and a >= least:
            cuts = [(counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
            inside = len(w) == 2 and any(
                g == lang and b >= least and 100 * b >= 50 * a and len(p.split(" ")) == 3 and f" {phrase} " in f" {p} "
                for (g, p), b in counts.items()
            )
            if not inside:
                found.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    for lang, some in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


@pytest.mark.parametrize("bits", [12, 20])  # nearly every phrase passes the small filter
def test_collocations(spark, docs, empty, bits):
    rng = np.random.default_rng(2)
    rows = [(lang, " ".join(rng.choice(["a", "B", "cé", "d,", "e.", "f\n", "g\t", "h"], 400))) for lang in ("en", "de", None, "und")]
    rows += [("en", "x y z. " * 30 + "x y q " * 9), ("en", "w " * 3000), ("en", None), ("fr", ""), (None, " ,. \n")]
    rows += [(r.lang, r.text) for r in docs.collect()]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "lang string, text string, phrase string, n int")
    made = collocations.collocations(table.repartition(3), least=3, top=150, bits=bits)
    same(made, brute_collocations(rows, 3, 150))
    assert collocations.collocations(empty).count() == 0


def test_parse_assigns_every_phrase_once():
    rng = np.random.default_rng(4)
    texts_ = [" ".join(rng.choice(["a", "b", "c.", "dd"], n)).encode() for n in (0, 1, 2, 3, 50, 300)]
    data = np.frombuffer(b"".join(texts_), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts_]))).astype(np.int64)
    for trigger, most in ((1, 8), (3, 8), (10**9, 8), (10**9, 10**9)):
        chunks = list(collocations.parse(data, offsets, trigger, most))
        for r, text in enumerate(texts_):
            own = [w for row, n, body in chunks if row == r for w in body.replace(b"\n", b" ").split()[:n]]
            assert own == text.replace(b".", b" ").split()
        assert {tuple(c[1:]) for c in chunks} <= {tuple(c[1:]) for c in collocations.parse(data, offsets, trigger, most)}

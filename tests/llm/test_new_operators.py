"""Ranked search, resampling and the projection forest against brute force, with nulls, ties, repeats, empty and long texts."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from gridloom.llm import op11_ranked_search as op11
from gridloom.llm import op12_importance_resampling as op12
from gridloom.llm import op13_projection_forest as op13

#: The columns after the texts clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, n long, score string, rank int, m string"


def words(text):
    lower = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [w + str(k) for k in range(25) for w in ("alpha", "Beta", "gämma", "ß")]
    sentence = lambda n: rng.choice(["", "  ", "\n"]).join([" ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=n)), "."])
    out = [(i, sentence(rng.choice([1, 3, 10, 25, 60, 61, 200]))) for i in range(260)]
    out += [(300 + i, out[i % 4][1]) for i in range(60)] + [(7, out[7][1]), (7, out[8][1]), (None, out[3][1]), (None, out[3][1]), (400, None), (401, ""), (402, "!!"), (403, " ".join(["Alpha1 beta2"] * 20_000)), (-5, out[5][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items():
    return [(1, "alpha1 Beta2 alpha1 gämma3"), (2, "nothing of it"), (3, None), (4, "... "), (None, "ß7"), (5, "ß7"), (5, "beta0"), (6, " ".join(f"Beta{k} ß{k}" for k in range(25)))]


def ranked(rows, items, k):
    terms = [(i, Counter(words(t))) for i, t in rows]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            scores += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def found(df):
    return sorted(map(str, ((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())))


@pytest.mark.parametrize("first,growth,block,item_bytes", [(8, 8, 4096, 1 << 20), (1, 2, 3, 60)])
def test_ranked_search(spark, docs, rows, items, monkeypatch, first, growth, block, item_bytes):
    """Also with blocks of three documents, strata visited one by one, and several passes over the documents."""
    monkeypatch.setattr(op11, "BLOCK_DOCS", block)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    assert found(op11.ranked_documents(docs, asked, item_bytes=item_bytes, first=first, growth=growth)) == ranked(rows, items, 10)
    assert op11.ranked_documents(docs.limit(0), asked).count() == op11.ranked_documents(docs, asked.limit(0)).count() == 0


def test_search_skips_strata(spark):
    """Short documents that hold the item bound out the strata of long ones, whatever these hold."""
    rng = random.Random(5)
    rows = [(i, "key " + " ".join(f"w{rng.randrange(3000)}" for _ in range(2))) for i in range(20)] + [(100 + i, "key " + " ".join(f"w{rng.randrange(3000)}" for _ in range(40 + i))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = op11.Items.of([(1, b"key")])
    vectors = op11.term_vectors(docs, own.vocabulary)
    op11.weights(own, op11.document_counts(vectors, 1), len(rows))
    best, visited, every = op11.search_strata(op11.stratified_index(vectors, len(rows), sum(len(t.split()) for _, t in rows)), own, 10, 1, 2)
    assert [r.doc_id for r in best.orderBy("rank").collect()] == list(range(10)) and visited < every / 10


def test_block_scores_beyond_doubles():
    """Integers that doubles do not hold are added as integers."""
    items = op11.Items.of([(1, b"a b")])
    items.times = np.array([(1 << 54) // 900_000 + 1, 3])
    arrays = [np.array(x, t).tobytes() for x, t in (([7], np.int64), ([0, 1], np.int32), ([50, 1], np.int32), ([0, 1, 2], np.int32), ([0, 0], np.int32))]
    row = type("Row", (), dict(zip(("ids", "terms", "tfs", "begins", "docs"), arrays)) | {"m": 30, "nameless": False, "longest": 9})
    block = op11.Block(row)
    assert block.scores(items, 0)[0] == items.times[0] * (50 * 10**9 // 50_240) + 3 * (10**9 // 1240) == block.bounds(items)[0]


@pytest.mark.parametrize("n,most_words,most_pairs,buckets", [(1, 20_000, 20_000, 10_000), (3, 30, 40, 97), (2, 0, 0, 10_000)])
def test_resampling(spark, docs, rows, items, n, most_words, most_pairs, buckets):
    features = lambda w: [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]
    counts = [Counter(crc32(f.encode()) % buckets for f in features(words(t))) for _, t in rows]
    wanted = Counter(crc32(f.encode()) % buckets for _, t in items for f in features(words(t)))
    source = sum(counts, Counter())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (source.total() + buckets) / ((source[b] + 1) * (wanted.total() + buckets))))
    expected, scores = [], []
    for (i, t), c in zip(rows, counts):
        weight = sum(gain(b) * k for b, k in c.items())
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if len(words(t)) >= 20:
            scores.append(expected[-1])
    for r, row in enumerate(sorted(scores, key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))[: 10 * len(scores) // 100], 1):
        row[4] = r
    target = spark.createDataFrame(items, "item_id long, text string")
    got = op12.resample(docs, target, n=n, buckets=buckets, most_words=most_words, most_pairs=most_pairs)
    assert sorted(map(str, map(list, got.collect()))) == sorted(map(str, expected))
    assert op12.resample(docs.limit(0), target).count() == 0
    assert {r.weight > 0 for r in op12.resample(docs.filter("doc_id = 403"), target.limit(0)).collect()} == {False}


def test_head_words_are_found(spark):
    """Counting by part leaves out rare words only."""
    texts = spark.createDataFrame([("common " + " ".join(f"w{i}x{k}" for k in range(40)),) for i in range(60)], "text string")
    head = op12.find_head(texts, 2, 1, 5)
    assert list(head.words) == [b"common"] and head.states[0] == crc32(b"common")


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x and [v if v is None else float(v) for v in x], 0, 0.5) for i, x in rows], "vec_id long, embedding array<float>, label int, score double")


def neighbours(rows, every, k):
    usable = [(i, np.array(x)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    width = max(len(x) for _, x in usable)
    usable = [(i, np.append(x.astype(np.float32).astype(float), np.zeros(width - len(x)))) for i, x in usable]
    out = {}
    for q in {i for i, _ in usable if i % every == 0}:
        found = sorted((-max(sum(a * b for a, b in zip(x.tolist(), y.tolist())) for p, x in usable if p == q), j) for j, y in usable if j != q)
        out[q] = [(j, -s) for s, j in found[:k]]
    return out


def test_forest_small(spark):
    """In one leaf a tree the search is exact: ties, copies beyond k, repeated and null ids, vectors that take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 2, 0, -1, 0, 1]) for i in range(40)] + [(40, rows[40][1])] * 8 + [(60, [2.0, 1, 0])] + [(61, [2.0, 1, 0])] * 7
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None]), (204, [float("nan")] * 6), (205, [float("inf"), 1.0]), (None, [1.0] * 6)]
    got = {}
    for r in op13.nearest(vectors_of(spark, rows).repartition(3), 20, 5).orderBy("rank").collect():
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert got == neighbours(rows, 20, 5)
    few = vectors_of(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])])
    assert [tuple(r) for r in op13.nearest(few).collect()] == [(0, 1, 1, 3.0)]
    assert op13.nearest(few.limit(0)).count() == op13.nearest(few.limit(1)).count() == 0


@pytest.mark.parametrize("norms,sample_rows", [(False, 65_536), (True, 300)])
def test_forest_recall(spark, norms, sample_rows, monkeypatch):
    """Recall of at least 0.9 with few rows to a leaf, levels below the sample's, and vectors of unlike lengths."""
    monkeypatch.setattr(op13, "FIRST_LEAVES", 1)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))) * (rng.uniform(0.5, 1.5, (3000, 1)) if norms else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = []
    real = op13.leaves_needed
    monkeypatch.setattr(op13, "leaves_needed", lambda *a: asked.append(a[0].depth) or asked.append(real(*a)) or asked[-1])
    got = op13.nearest(vectors_of(spark, rows), 20, 20, leaf_rows=16, sample_rows=sample_rows).toPandas()
    y = x.astype(np.float32).astype(float)
    hit = 0
    for q, part in got.groupby("query_id"):
        assert sorted(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(y[part.vec_id] @ y[q], part.score, rtol=0, atol=1e-12)
        score = y @ y[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(part.vec_id))
    assert got.query_id.nunique() == 150 and hit >= 0.9 * 20 * 150
    assert asked[0] == 8 and asked[1] < (4 << 8) / 2  # most leaves are not visited

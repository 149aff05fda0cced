"""Centroid clustering, ranked search and removal of repeated strings, against plain versions and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from scriptorium.llm import clustering, search, substrings


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance) and centroids, all distances computed with Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first] or [[0] * 64]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else old for n, old in enumerate(c)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], c


def test_clusters(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for k in range(400)]
    rows += [(1000 + k, [0.25] * 64) for k in range(100)]  # many equal ones, in trees of their own
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [float("nan")]), (2003, [None] * 64), (2004, [float("-inf")] * 64), (2005, [-0.001] * 64)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, distance string")
    want, centroids = plain_clusters(rows)
    for tree in (64, 4096):
        got = clustering.cluster(table, tree=tree).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
        inertia = Counter()
        for _, n, d in want:
            inertia[n] += d
        assert all(r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values()) for r in got)
        assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in got)
    assert clustering.cluster(table.limit(0)).count() == 0
    few = clustering.cluster(table.filter("vec_id IN (1, 2)")).collect()
    assert sorted(r["distance"] for r in few) == [0, 0] and len({r["cluster"] for r in few}) == 2
    assert [(r["vec_id"], r["cluster"]) for r in clustering.cluster(table.filter("vec_id IS NULL")).collect()] == [(None, 0)]
    with pytest.raises(PySparkException, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e7] * 64)], "vec_id long, embedding array<double>"))


def test_tree_prunes_and_agrees():
    rng = np.random.default_rng(2)
    for spread in (3, 300, 1 << 25):
        centres = rng.integers(-spread, spread, (8, 64))
        x = centres[rng.integers(0, 8, 3000)] + rng.integers(-2, 3, (3000, 64))
        c = x[rng.choice(3000, 20, replace=False)]
        tree, order = clustering.Tree.build(x)
        assert sorted(order.tolist()) == list(range(3000)) and (tree.points == x[order]).all()
        want = np.array([min((int(((v - y) ** 2).sum()), k) for k, y in enumerate(c))[1] for v in tree.points])
        assert (tree.labels(c) == want).all()
        n, total = tree.totals(c)
        assert (n == np.bincount(want, minlength=20)).all() and all((total[k] == tree.points[want == k].sum(0)).all() for k in range(20))
    whole = [b - a for _, a, b, what in tree.assign(np.stack([tree.points.min(0) - 10, tree.points.max(0) * 4]))]
    assert max(whole) > clustering.LEAF  # some node was assigned without looking at its vectors


def plain_ranking(docs, items, top=10):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    own = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 25 + (75 * sum(c.values()) * n) // max(total, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i, s))
        for rank, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, s))
    return out


def odd_documents():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éa", "straße", "x9", "the", "the", "the"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30, 200])))) for k in range(300)]
    docs += [(400 + k, docs[3][1]) for k in range(40)] + [(7, docs[7][1])] * 3 + [(None, docs[9][1]), (None, None), (900, ""), (901, " .,- "), (902, "the " * 60000 + "rare"), (903, "THE-w1;W2")]
    return docs


def test_search(spark, monkeypatch):
    docs = odd_documents()
    items = [(k, " ".join(d[1].split()[:12])) for k, d in enumerate(docs[:40])] + [(None, "w1 w1 W2"), (50, None), (51, "nowhere"), (52, "rare"), (53, "the"), (3, "straße éa Éa"), (54, "")]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, query int")
    queries = spark.createDataFrame([(*q, "y") for q in items], "item_id long, text string, doc_id string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain_ranking(docs, items), key=key)
    assert sorted(map(tuple, search.ranked(table, queries).collect()), key=key) == want
    for name, value in (("BLOCK_DOCS", 16), ("BLOCK_POSTINGS", 300), ("CELLS", 64), ("QUERY_BYTES", 500)):
        monkeypatch.setattr(search, name, value)
    assert sorted(map(tuple, search.ranked(table, queries).collect()), key=key) == want
    assert search.ranked(table.limit(0), queries).count() == 0 and search.ranked(table, queries.limit(0)).count() == 0
    assert search.ranked(table.filter("text IS NULL"), queries).count() == 0


def test_bounds_hold():
    """Bytes bound impacts from both sides."""
    tf, n = np.meshgrid(np.array([1, 2, 3, 50, 10**6]), np.array([1, 2, 90, 10**4, 10**7]))
    exact = search.impact(tf.ravel(), np.maximum(tf, n).ravel(), 1000, 100_000)
    byte = -(-exact // search.STEP)
    assert byte.max() <= 255 and (exact <= byte * search.STEP).all() and (exact >= np.where(byte > 0, (byte - 1) * search.STEP + 1, 0)).all()


def plain_removed(texts, length):
    """Spans that are repeated, by a table of all strings of the length."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    return [substrings.merged([(p, p + length) for p in range(len(d) - length + 1) if n[d[p : p + length]] > 1]) for d in data]


def shared_texts(rng, length, letters="abcdefgh é"):
    say = lambda n: "".join(rng.choices(letters, k=n))
    base = say(12 * length)
    texts = [base] * 5 + [base[: 5 * length] + say(3) + base[5 * length + 3 :] for _ in range(6)]
    passage = say(2 * length)
    texts += [say(rng.randrange(3 * length)) + passage + say(rng.randrange(3 * length)) for _ in range(8)]
    texts += [say(length) + passage[:length - 1] + say(9), passage[: length + 1], passage[1 : length], "z" * (3 * length), "ab" * (2 * length), say(6 * length), say(length) * 3]
    short = say(length // 2)
    texts += [say(rng.randrange(length)) + short + say(rng.randrange(2 * length)) for _ in range(30)]  # buckets of many, no window alike
    for _ in range(6):  # near copies with changes at many places
        t = list(base)
        for at in rng.sample(range(len(t)), 9):
            t[at] = rng.choice(letters)
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("length,gram,piece", [(40, 8, 1 << 20), (100, 16, 130), (400, 32, 1000)])
def test_repeated_strings(spark, monkeypatch, length, gram, piece):
    rng = random.Random(length)
    texts = [*shared_texts(rng, length), None, "", "x", "é" * length]
    monkeypatch.setattr(substrings, "PIECE", piece)
    ids = [*range(len(texts) - 2), None, None]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in zip(ids, texts)], "doc_id long, text string, row string, hull int").repartition(3)
    want = []
    for i, t, gone in zip(ids, texts, plain_removed(texts, length)):
        data = (t or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)]))
        want.append((i, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    done = substrings.deduplicated(docs, length=length, gram=gram)
    assert sorted((tuple(r)[:5] for r in done.collect()), key=key) == sorted(want, key=key)
    both = done.filter("doc_id IS NOT NULL").join(docs.select("doc_id", "text"), "doc_id").selectExpr("kept_sha256", "text", "spans")
    back = both.select("kept_sha256", substrings.kept_text(both["text"], both["spans"]).alias("kept")).collect()
    assert back and all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in back)
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_windows_and_anchors():
    """Every window has the first of its grams with the least hash, whatever stands around it and however a text is cut."""
    rng = random.Random(1)
    data = "".join(rng.choices("abc", k=900)).encode() + b"a" * 300
    h = substrings.gram_hashes(np.frombuffer(data, np.uint8), 8)
    want = [(min(range(p, p + 33), key=lambda i: (h[i], i)), p) for p in range(len(data) - 39)]
    for piece in (1 << 20, 50, 7):
        got = [(x, p) for xs, los, his in substrings.runs(data, 40, 8, piece) for x, lo, hi in zip(xs.tolist(), los.tolist(), his.tolist()) for p in range(lo, hi + 1)]
        assert got == want

"""SimHash, language model, BPE and the classifiers, against brute force or on held-out rows."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from scriptorium.llm import bpe, common, langid, lm, quality, queries, simhash, svm, toxicity

BASE = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    """The least number reachable by steps of at most 2 bits, over (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(k)
    return {i: min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(fps))}


def test_fingerprints():
    for text in ("", " \t\n", "One", "one two", "A b c", "a  b\tc\x0bd e f é É", "x " * 200_000, "ab cd ef gh " * 5 + "q"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_of_chains_and_clusters(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(4):  # chains of steps of 1 or 2 bits, ids in no order
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    center = rng.getrandbits(64)
    fps += [center ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(80)] + [center] * 5 + [0, 0, 3, (1 << 64) - 1]
    ids = rng.sample(range(10_000), len(fps))
    ids[5] = ids[-1] = None
    rows = list(zip(ids, fps, strict=True))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "doc_id long, fp long")
    first = {r["fp"]: r["first"] for r in simhash.component_ids(df, least=df["doc_id"]).collect()}
    want = plain_components(rows)
    for i, (_, f) in enumerate(rows):
        assert first[f - (1 << 64) if f >> 63 else f] == want[i]


def test_pivots_discard_pairs_and_lose_no_link(spark):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for x in list(fps):
        for bits in (1, 2, 2, 3, 5, 9):  # near, and near enough for a key only
            y = x
            for b in rng.sample(range(32 if bits > 2 else 64), bits):
                y ^= 1 << b
            fps.add(y)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    pairs, crowded = simhash.candidates(simhash.pivot_table(df))
    tried = {(r["a"], r["b"]) for r in pairs.selectExpr("least(x.fp, y.fp) AS a", "greatest(x.fp, y.fp) AS b").collect()}
    kept = {(r["a"], r["b"]) for r in simhash.survivors(pairs).selectExpr("least(x.fp, y.fp) AS a", "greatest(x.fp, y.fp) AS b").collect()}
    true = {(a, b) for a in map(signed, fps) for b in map(signed, fps) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert true <= kept < tried and len(tried - kept) > 50 and crowded.count() == 0
    assert {(r["b"], r["a"]) for r in simhash.links(df).collect()} == true


def test_near_duplicates_and_the_kept_documents(spark):
    rng = random.Random(4)
    long = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(300)) for _ in range(4)]
    texts = long + [t + " end" for t in long] + [long[0], "", None, "  ", "unique words here", long[1]]
    rows = [(100 - k, t, "x") for k, t in enumerate(texts)] + [(None, long[2], "n"), (5, "single", "a"), (5, "single", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 AS first", "2 AS point")
    got = simhash.near_duplicates(df).collect()
    fps = [(k, plain_fingerprint(t)) for k, t, _ in rows]
    want = plain_components(fps)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, f"{f:016x}", want[i]) for i, (k, f) in enumerate(fps)), key=repr)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def lm_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\n"]


def test_language_model_counts_and_automaton(spark):
    rng = random.Random(5)
    words = ["the", "of", "A", "b c", "É", "é"] + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(words, weights=[30, 20, 9, 5, 3, 3] + [1] * 40, k=rng.randint(0, 40))), "x") for k in range(120)] + [(500, None, ""), (501, "", ""), (None, "the of never learned", ""), (502, "unseen words the of", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").selectExpr("*", "1 AS ids", "2 AS block").repartition(3)
    short, kept = 0.004, 0.002
    got = {r["doc_id"]: r for r in lm.score_texts(df, short=short, kept=kept).collect()}
    rem = {k: None if k is None else zlib.crc32(str(k).encode()) % 7 for k, *_ in rows}
    train = [lm_tokens(t) for k, t, _ in rows if k is not None and rem[k] != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, n1 / (n1 + 2 * n2)) if n1 else 1 / (2 * v)
    listed = {w for w, x in c.items() if x >= short * n and x >= 2}
    two = Counter(p for t in train for p in zip([None, *t], t) if (p[0] is None or p[0] in listed) and p[1] in listed)
    two = {g: x for g, x in two.items() if x >= kept * n and x >= 2}
    three = Counter(g for t in train for g in zip([None, *t], t, t[1:]) if g[:2] in two and g[1:] in two)
    three = {g: x for g, x in three.items() if x >= kept * n and x >= 2}
    hist = c | {None: len(train)}

    def p(w, h):
        if not h:
            return (c[w] - d) / n if c[w] else d * v / n
        grams, total = (three, two.get(h)) if len(h) == 2 else (two, hist.get(h[0]))
        follow = {g[-1]: x for g, x in grams.items() if g[:-1] == h}
        if not follow or not total:
            return p(w, h[1:])
        gamma = (total - sum(x - lm.DISCOUNT for x in follow.values())) / total
        return (max(follow.get(w, 0) - lm.DISCOUNT, 0) / total) + gamma * p(w, h[1:])

    for k, text, _ in rows:
        t, r = lm_tokens(text), got[k]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        seen, score = [None], 0.0
        for w in t:
            h = tuple(seen[-2:])
            score += math.log10(p(w, h))
            seen = [*seen, w] if w in listed else []
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (rem[k] == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score), k
    assert sum(p(w, (b"the",)) for w in c) + p(b"never", (b"the",)) == pytest.approx(1)


def test_language_model_keeps_rare_ngrams_of_a_large_corpus(spark):
    # Two occurrences are a share of 5e-6 of these 400,000 tokens.
    many = spark.range(1000, 1400).selectExpr("id AS doc_id", "repeat('a b c d ', 250) AS text")
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2]
    out = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    rare = [(ids[0], "q1 q2 q3 q4"), (ids[1], "q1 q2 q3 q4"), (out[0], "q1 q2 q3 q4"), (out[1], "q3 q1 q4 q2")]
    got = {r["doc_id"]: r for r in lm.score_texts(many.unionByName(spark.createDataFrame(rare, "doc_id long, text string"))).filter("doc_id < 100").collect()}
    assert got[out[0]]["base_score"] == pytest.approx(got[out[1]]["base_score"])
    assert got[out[0]]["score"] > got[out[1]]["score"] + 6


def test_language_model_without_training(spark):
    got = lm.score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert tuple(got) == (None, False, 3, 0, 0, 0.0, 0.0)
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(6)
    odd = ["", " ", "  \n\t x", "don't we'll I'M", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "é É ß 東京 🙂‍🔥 ‍ ́a ١٢٣ ½", "a b c", "x\r\n\r\n  y  ", "12345 678", "\x00\x01", "͸￾\U000e0001"]
    odd += ["".join(rng.choices(" abE'é\n1!<|>end　東", k=rng.randint(1, 80))) for _ in range(300)]
    odd += ["a" * 50_000, "abc" * 9_000 + " tail", "é" * 9_000, "!?" * 8_000, " " * 20_000 + "x", "東京" * 6_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "word " * 5_000 + "z" * 9_000]
    for t in odd:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:50]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = bpe.encode_texts(spark.createDataFrame([(1, None), (1, "a b"), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 AS n_tokens"), path, keep=[spark_col("doc_id")], schema="doc_id long", with_ids=True).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(1, 0), (1, 2), (None, 2)]
    assert got[1]["ids_sha256"] == hashlib.sha256(np.array(got[1]["ids"], "<u4").tobytes()).hexdigest()


def test_bpe_of_long_pieces_in_any_script():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(12)
    for alphabet in ("東京語日本", "ابجدهوز", "กขคง", "абвг東é", "a\U0001f525", "١٢٣", "۔!?¿東", "\u3000 \t"):
        for n in (1_000, 5_000, 40_001):
            t = " x " + "".join(rng.choices(alphabet, k=n)) + " 1y"
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, (alphabet, n)
    data = "東".encode() * 3_000
    assert own.piece(data) == own.whole(data) and len(data) > 4 * bpe.LEAF


def test_bpe_of_white_space_and_of_every_long_piece():
    """Texts of white space only, in any script, and pieces just under and over the leaf, all by one rule and as the library has them."""
    b = bpe.load(queries.vocabulary_path())
    texts = ["\u3000" * 600, " " * 5000, "\u3000" * 600 + "\n\t ", "\xa0" * 3000, "\n" * 4097, "\x1c" * 1200, "\x1c!" * 1200, " \t" * 1500 + "a", "\u2028" * 700 + "x", "\u3000", " "]
    texts += [c * n for c in ("x", "é", "字", "🙂", "=") for n in (510, 511, 512, 2047, 2048, 2049, 8192)]
    for text in texts:
        assert b.encode(text) == b.library.encode(text, add_special_tokens=False).ids, (text[:3], len(text))
    joined = []
    b.join, kept = lambda left, right: joined.append(1) or bpe.Bpe.join(b, left, right), b.join
    try:
        for text in ("x" * 3000, "字" * 3000, " " * 3000, "\u3000" * 3000):
            joined.clear()
            assert b.encode(text) == b.library.encode(text, add_special_tokens=False).ids and joined
    finally:
        b.join = kept


def test_bpe_refuses_other_tokenizers(tmp_path):
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        j = json.load(f)
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": j["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [j["added_tokens"][0] | {"lstrip": True}]}, {"model": j["model"] | {"type": "WordPiece"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(j | change))
        with pytest.raises(ValueError, match="not a byte-level BPE"):
            bpe.load.__wrapped__(str(path))


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_the_pattern_classes_agree_on_every_plain_character():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    for c in range(0x2200):
        t = f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)} "
        if own.plain.fullmatch(t):
            assert own.core.encode_ordinary(t) == lib.encode(t, add_special_tokens=False).ids, hex(c)


def held_out(spark, label, mod, rem, base=BASE):
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    score = toxicity.toxicity if label == "toxic" else quality.quality
    rows = score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % mod == rem for r in rows)
    return np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_rows(spark):
    predicted, label = held_out(spark, "quality", 3, 1)
    assert (predicted == label).mean() > 0.95


def test_quality_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(13)
    mask = np.zeros(quality.DIM, bool)
    for k in range(6):
        t = "".join(rng.choice(["aaa", "B", "12", "===", " ", "é", "x y ", "zz zz "]) * rng.randint(1, 40) for _ in range(400))
        whole = quality.features(t, mask)
        for piece in (7, 64, 1000):
            monkeypatch.setattr(quality, "PIECE", piece)
            assert (quality.features(t, mask) == whole).all(), (k, piece)
        monkeypatch.undo()
    assert not len(quality.features(None, mask)) and not len(quality.features("", mask)) and not mask.any()


def plain_dual(x, y, cost, steps=4000):
    """The optimum of the same problem by projected gradient on the dual."""
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(steps):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, cost)
    return (alpha * y) @ x


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = rng.uniform(0.2, 2, 60)
    loss = lambda w, z: w @ w / 2 + (cost * np.maximum(0, 1 - y * (z @ w))).sum()
    z = np.hstack([x, np.ones((60, 1))])
    best = plain_dual(z, y, cost)
    got = svm.fit_dense(x, y, cost, epochs=2000)
    assert loss(got, z) == pytest.approx(loss(best, z), rel=1e-3)
    rows = [np.sort(rng.choice(20, rng.integers(2, 8), replace=False)) for _ in range(60)]
    values = rng.normal(size=20)
    dense = np.zeros((60, 20))
    for k, r in enumerate(rows):
        dense[k, r] = values[r] / np.sqrt((values[r] ** 2).sum())
    z = np.hstack([dense, np.ones((60, 1))])
    w, bias = svm.fit_sparse(rows, values, y, cost, epochs=3000)
    assert loss(np.append(w, bias), z) == pytest.approx(loss(plain_dual(z, y, cost, 20_000), z), rel=1e-3)


def test_language_decoding_is_that_of_a_plain_loop():
    rng = random.Random(14)
    parts = {f"l{k}": ["".join(rng.choices("abcdefghijklmnop", k=2)) for _ in range(6)] for k in range(9)}
    say = lambda p, n: " ".join("".join(rng.choices(p, k=2)) for _ in range(n))
    model = langid.fit([(say(p, 20), lang) for lang, p in parts.items() for _ in range(15)])
    texts = [say(rng.choice(list(parts.values())), rng.randint(1, 30)) for _ in range(40)]
    lang, score, near = model.predict(texts)
    for k, t in enumerate(texts):
        b, sums = b" " + t.lower().encode() + b" ", [0.0] * model.code.shape[1]
        for order in langid.ORDERS:
            for i in range(len(b) - order + 1):
                g = np.frombuffer(b[i : i + order], np.uint8).astype(np.int32)
                row = model.table[langid.STARTS[order] + int(langid._hashes(g, order)[0])]
                for j in range(len(sums)):
                    sums[j] += float(row[j])
        f = [sums[j] / len(b) * model.slope[j] + model.shift[j] for j in range(len(sums))]
        loss = [sum(model.weight[j] * math.log1p(math.exp(-int(model.code[n, j]) * f[j])) for j in range(len(f))) for n in range(len(model.languages))]
        share = [math.exp(-x) for x in loss]
        best = max(range(len(share)), key=lambda n: share[n])
        assert lang[k] == model.languages[best] and score[k] == pytest.approx(share[best] / sum(share), rel=1e-3)
        assert near[k] == (sorted(share)[-1] - sorted(share)[-2] < langid.NEAR * sum(share)) or abs(sorted(share)[-1] - sorted(share)[-2] - langid.NEAR * sum(share)) < 1e-3


def test_samples_pass_over_long_texts_first(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id AS doc_id", "if(id % 10 = 0, 'short ' || id, repeat('long ', 2000)) AS text", "if(id % 20 = 0, 'aa', 'bb') AS lang")
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 20 = 0 AS INT) AS toxic")
    got = common.labelled_sample(docs, labels, "toxic", 5, 0, per_class=5, max_chars=8_000)
    assert [label for _, label in got].count(0) == 5 and [label for _, label in got].count(1) == 5
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    assert langid.learned(docs).languages == ["aa", "bb"]


def test_no_language_is_left_out_however_many(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 40)
    monkeypatch.setattr(langid, "FEWEST", 2)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda sample: seen.extend(sample))
    langid.learned(spark.range(3000).selectExpr("id AS doc_id", "'text ' || id AS text", "'l' || (id % 60) AS lang"))
    assert len({lang for _, lang in seen}) == 60 and len(seen) == 120


def recall_and_precision(predicted, label):
    hit = ((predicted == 1) & (label == 1)).sum()
    return hit / max(1, (label == 1).sum()), hit / max(1, (predicted == 1).sum())


def test_toxicity_recall_and_precision_on_held_out_rows(spark):
    # A tenth of the rows is toxic, so that few labels tell of each insult; with ten times as many both are near 1 (README).
    recall, precision = recall_and_precision(*held_out(spark, "toxic", 5, 0, "/root/testdata/sf0.1"))
    assert recall > 0.8 and precision > 0.7


def plain_kernel(a, b):
    """The sum over equal subsequences of 3 and of 4 characters, both edges among them, of their weights, by the norms."""
    def weights(word):
        x, out = f"\n{word}\n", Counter()
        for p, span in toxicity.SPAN.items():
            for at in itertools.combinations(range(len(x)), p):
                if at[-1] - at[0] < span:
                    out["".join(x[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(x[k] * y[k] for k in x) / toxicity.NORMS[len(a)] / toxicity.NORMS[len(b)]


def test_the_kernel_is_that_of_plain_subsequences(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 24)  # so many that no two of these subsequences share a hash
    monkeypatch.setattr(toxicity, "SIZE", 2 << 24)
    rng = random.Random(16)
    words = ["scoundrel", "scouxndrel", "s.c.o.u.n", "идиот", "идиоты", "домик", "笨蛋傻瓜", "a", "ab", "aaaaaa", "x1d10t"] + ["".join(rng.choices("abcdeж", k=rng.randint(1, 12))) for _ in range(20)]
    got = toxicity.kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    assert got[3, 4] > 5 * got[3, 5]  # letters beyond a to z count
    marks = words[:8]
    values, vectors = np.linalg.eigh(toxicity.kernel(marks, marks))
    root = vectors / np.sqrt(values)
    beta = root @ rng_vector(8)
    table = np.zeros(toxicity.SIZE)
    for b, w in zip(beta, marks, strict=True):
        keys, weights = toxicity._explicit(w)
        table[keys] += b * weights
    # The collapsed table says what the machine over landmark features says.
    assert np.allclose(toxicity.table_scores(words, table), toxicity.kernel(words, marks) @ root @ rng_vector(8), atol=1e-4)


def rng_vector(n):
    return np.random.default_rng(4).normal(size=n)


def test_toxicity_of_other_scripts():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(["но", "ра", "ко", "ни", "та", "ло"]) for _ in range(rng.randint(1, 4)))
    sample = []
    for k in range(400):
        text = [word() for _ in range(40)]
        if k % 2:
            text[rng.randrange(40)] = "идиот"
        sample.append((" ".join(text), k % 2))
    model = toxicity.fit(sample)
    assert (model.scores(["раз идиот кони", "и  д и\nо т", "идиооот"]) >= 0.5).all()
    assert (model.scores(["рано кони тало", "лоток нитка"]) < 0.5).all()


@pytest.mark.parametrize("score", [lambda d, la: quality.quality(d, la), lambda d, la: toxicity.toxicity(d, la), lambda d, la: langid.language_id(d)])
def test_classifiers_on_odd_tables(spark, score):
    rng = random.Random(15)
    rows = [(k, " ".join(rng.choices(["aa", "bb", "cc"] if k % 2 else ["xx", "yy", "zz zz"], k=30)), "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, None, None), (101, "", "en"), (None, "aa bb", "en"), (3, rows[3][1], "en"), (3, "other text", "de"), (102, "aa " * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS score", "1 AS predicted", "2 AS lang_pred", "3 AS held_out", "4 AS __text")
    labels = spark.createDataFrame([(k, k % 2, k % 2, 1) for k in range(60)] + [(None, 1, 1, 1), (5, None, None, 1)], "doc_id long, quality int, toxic int, text int")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)
    assert sum(r["doc_id"] is None for r in got) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert score(docs.limit(0), labels).count() == 0 and score(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    predicted, label = held_out(spark, "toxic", 5, 0)
    assert (predicted == label).mean() > 0.9


def test_toxicity_tolerates_gaps_and_insertions():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed", "ti"]) for _ in range(rng.randint(1, 4)))
    sample = []
    for k in range(600):
        text = [word() for _ in range(60)]
        if k % 2:
            text[rng.randrange(60)] = ["scoundrel", "blockhead"][k // 2 % 2]
        sample.append((" ".join(text), k % 2))
    model = toxicity.fit(sample)
    bad = ["a scoundrel there", "b.l.o.c.k.h.e.a.d", "s c o u n d r e l", "scouxndrel", "block-head!", "SCOUNDREL!!"]
    good = ["there on the inner thing", "", None, "er on an re in"]
    assert (model.scores(bad) >= 0.5).all(), model.scores(bad)
    assert (model.scores(good) < 0.5).all(), model.scores(good)
    long = "there on " * 40_000
    assert model.scores([long + "scoundrel " + long])[0] >= 0.5 > model.scores([long + long])[0]


def test_classifiers_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert {r["score"] for r in quality.quality(docs, labels).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def test_language_of_odd_texts():
    rng = random.Random(9)
    say = lambda parts, n: " ".join("".join(rng.choices(parts, k=3)) for _ in range(n))
    parts = {"aa": ["th", "er", "wh"], "bb": ["sch", "ung", "ei"], "cc": ["eau", "que", "ou"], "dd": ["ción", "os", "ñ"]}
    model = langid.fit([(say(p, 30), lang) for lang, p in parts.items() for _ in range(20)])
    texts = [None, "", "123 !?", say(parts["bb"], 10), say(parts["dd"], 3) * 100_000, say(parts["aa"], 5)]
    lang, score, _ = model.predict(texts)
    assert lang[:3] == ["und"] * 3 and lang[3:] == ["bb", "dd", "aa"] and (score[3:] > 0.5).all()
    alone = [model.predict([t])[1][0] for t in texts]
    assert alone == pytest.approx(score.tolist())  # neighbours in a batch don't matter
    assert langid.fit([("x", "en")]).predict(["word", "1"])[0] == ["en", "und"]
    assert langid.fit([]).predict(["word"])[0] == ["und"]
    for n in (2, 4, 9, 30):
        code = langid.codewords(n).astype(int)
        d = (code.shape[1] - code @ code.T) // 2
        assert (d + np.eye(n, dtype=int) * 99).min() >= 1

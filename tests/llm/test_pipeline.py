"""Each stage of the pipeline on its own input, held against a plain version of its rule."""

import random

import corpus_pipeline
import __spark_entry__
from scriptorium.llm import langid, toxicity
from tests.llm.test_native import plain
from tests.llm.test_text_models import plain_components, plain_fingerprint

BASE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "bpe"]

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, BASE).cache()
    rejected = toxicity.toxicity(docs, labels).filter("predicted = 1")
    assert ids(kept) == sorted(set(ids(docs)) - set(ids(rejected))) and kept.columns == columns
    after = stages["language_id"](spark, kept, BASE).cache()
    out = {r["doc_id"] for r in langid.language_id(kept).filter("lang_pred = 'und' OR score < 0.5").collect()}
    assert ids(after) == sorted(set(ids(kept)) - out) and after.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in after.collect()]
    single = stages["simhash_near_dedup"](spark, after, BASE).cache()
    assert ids(single) == sorted(set(plain_components([(k, plain_fingerprint(t)) for k, t in rows]).values())) and single.columns == columns
    clean = stages["benchmark_decontamination"](spark, single, BASE).cache()
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert ids(clean) == sorted(x[0] for x in plain(rows, items) if not x[5]) and clean.columns == columns
    last = stages["bpe"](spark, clean, BASE)
    assert ids(last) == ids(clean)
    assert ids(corpus_pipeline.run(spark, BASE)) == ids(last)


def test_registered():
    names = list(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def odd(spark, tmp_path):
    """Tables in which each stage has something to do, and all odd cases."""
    rng = random.Random(21)
    say = lambda parts, n: " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))
    en, de = ["the", "and", "ing", "wh"], ["sch", "ung", "ein", "ich"]
    rows = []
    for k in range(120):
        text = say(en if k % 2 else de, 40)
        if k % 3 == 0:
            text += " scoundrel"
        rows.append((k, text, "en" if k % 2 else "de", "s", len(text)))
    passage = say(en, 30)
    rows += [(200, None, None, "s", 0), (201, "", "en", "s", 0), (None, say(en, 40), "en", "s", 1), (202, say(en, 20) + " " + passage + " " + say(en, 5), "en", "s", 1), (203, "1234 !", "en", "s", 6)]
    rows += [(7, rows[7][1], "en", "b", 2), (7, rows[7][1], "en", "a", 2), (301, rows[9 + 2][1], "en", "s", 3), (302, "the and " * 300_000, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "'x' AS __text", "1 AS score", "2 AS fp", "3 AS w", "4 AS ids")
    spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_on_odd_tables(spark, tmp_path):
    docs, stages, at = odd(spark, tmp_path), dict(corpus_pipeline.STAGES), str(tmp_path)
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)
    every = ids(docs)
    kept = {name: stages[name](spark, docs, at) for name in list(stages)[:4]}
    for df in kept.values():
        assert df.columns == docs.columns
    toxic = [k for k in range(120) if k % 3 == 0]
    assert set(every) - set(ids(kept["toxicity"])) == set(toxic) and ids(kept["toxicity"]).count(7) == 3
    assert set(every) - set(ids(kept["language_id"])) == {200, 201, 203} and None in ids(kept["language_id"])
    single = kept["simhash_near_dedup"].collect()
    assert sum(r["doc_id"] == 7 for r in single) == 1 and next(r["source"] for r in single if r["doc_id"] == 7) == "a"
    found = {r["doc_id"] for r in single}
    assert 301 not in found and 11 in found and 200 in found and 201 not in found and None in found
    assert set(every) - set(ids(kept["benchmark_decontamination"])) == {202}
    last = stages["bpe"](spark, docs, at)
    assert ids(last) == every and {r["n_tokens"] for r in last.filter("doc_id IN (200, 201)").collect()} == {0}
    for stage in stages.values():
        assert stage(spark, docs.limit(0), at).count() == 0

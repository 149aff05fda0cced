"""Chat formatting and benchmark decontamination: plain versions on small tables, and the odd cases."""

import hashlib
import random
import re

import pytest

from scriptorium.llm import chat, decontam, queries


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_fingerprints_of_paths_are_those_of_records(spark):
    rows = [(0, '{"messages":[{"role":"user","content":"a"},{"content":"b"}]}'), (1, '{"instruction":"i","input":"x","output":"o"}'), (2, '{"instruction":"i","output":"o"}'), (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}],"id":7}'), (4, '{"prompt":"p","response":null}'), (5, '{"odd":{"deep":[1.5,2]}}'), (6, "not json"), (7, None), (8, '{"messages":[]}')]
    df = spark.createDataFrame(rows, "id long, record string")
    got = {r["id"]: r for r in chat.canonical_turns(df, "id", "record").collect()}
    assert [got[k]["layout"] for k in range(9)] == ["messages", "instruction", "instruction", "from_value", "prompt_response", None, None, None, "messages"]
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "a"), ("", "b")]
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "i\n\nx"), ("assistant", "o")]
    assert [tuple(t) for t in got[3]["turns"]] == [("user", "q"), ("assistant", "r")]
    assert [tuple(t) for t in got[4]["turns"]] == [("user", "p"), ("assistant", "")]
    assert got[8]["turns"] == [] and got[5]["turns"] is None
    assert got[1]["fingerprint"] == chat.fingerprint_of(("output", "instruction", "input"))
    assert {r["paths"] for r in chat.unmapped_layouts(df, "record").collect()} == {"OBJECT<odd: OBJECT<deep: ARRAY<*>>>", None}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "\\", "\n", "[", "<", "é", "ok", " ", "\\[INST]", "$1", "\u0000"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a[ROLE]\n\\"]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])) for c in range(40) for t in (1, 2, 2, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS turns")
    got = {r["conv_id"]: r for r in chat.digest_chat(chat.format_chat(chat.pack_messages(df, "conv_id", "turn", "role", "text"), "conv_id", "record"), "conv_id").collect()}
    for c in range(40):
        own = sorted(((t is not None, t or 0, role or "", text or "") for cc, t, role, text in rows if cc == c))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), c
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (4, len(loss), sha(loss))


def test_chat_with_a_text_that_the_parser_refuses(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS conv_id, 1L AS turn, 'human' AS role, repeat('q', 20000001) AS text UNION ALL SELECT 1L, 2L, 'assistant', 'a' UNION ALL SELECT 2L, 1L, 'human', 'b'")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_sha256"]) == (2, sha("a"))
    assert got[1]["turns_sha256"] == sha("user\n" + "q" * 20000001 + "\nassistant\na\n")
    assert got[2]["turns_sha256"] == sha("user\nb\n")
    alone = chat.pack_messages(rows, "conv_id", "turn", "role", "text").drop("messages")
    with pytest.raises(Exception, match="too long for the parser"):
        chat.canonical_turns(alone, "conv_id", "record").collect()


def test_chat_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_chat(chat.format_chat(chat.pack_messages(df, "conv_id", "turn", "role", "text"), "conv_id", "record"), "conv_id").count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            n = min(10, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    if item_id is not None:
                        ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed, alphabet):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 11, 25, 40]))) for k in range(12)] + [(99, ""), (98, None), (None, say(12))]
    docs = []
    for k in range(60):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 5))
            parts += [", ".join(x.upper() for x in v[a : a + rng.randint(1, 30)]), say(rng.randint(0, 12))]
        docs.append((k, "\n".join(parts)))
    return docs + [(1000, None), (1001, ""), (None, docs[3][1]), (3, docs[3][1]), (3, "other")], items


def test_decontamination_against_plain_search(spark):
    few, many = ["É", "é", "a", "b"], [f"w{k}" for k in range(300)] + ["é", "Ü"]
    for seed, alphabet in ((1, few), (2, many)):
        docs, items = corpus(seed, alphabet)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS w", "8 AS id")
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 AS h")
        want = plain(docs, items)
        got = sorted((tuple(r) for r in decontam.decontaminate(d, b).collect()), key=repr)
        assert got == want
        clean = sorted((r["doc_id"] for r in decontam.uncontaminated(d, b).collect()), key=repr)
        assert clean == sorted((x[0] for x in want if not x[5]), key=repr)
        if seed == 2:  # the way for hashes over the broadcast bound
            old, decontam.BROADCAST = decontam.BROADCAST, 3
            try:
                assert sorted((tuple(r) for r in decontam.decontaminate(d, b).collect()), key=repr) == want
            finally:
                decontam.BROADCAST = old


def test_decontamination_without_items_or_documents(spark):
    docs, items = [(1, "a b c"), (2, None)], spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontam.decontaminate(d, items).collect()) == [(1, 3, 0, 0), (2, 0, 0, 0)]
    assert decontam.decontaminate(d.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert decontam.uncontaminated(d, items).count() == 2


def test_decontamination_of_a_template_that_many_items_share(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    template = say(14)
    items = [(k, f"{say(rng.randint(0, 8))} {template} {say(rng.randint(0, 8))}") for k in range(40)]
    docs = [(k, f"{say(10)} {template if k % 2 else say(14)} {say(5)} {template}") for k in range(10)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontam.decontaminate(d, b).collect()), key=repr) == plain(docs, items)
    windows = decontam.item_windows(decontam._sized(b))
    assert windows.filter("array_contains(split(window, ' '), 'w0')").count() > 0
    assert windows.distinct().count() < windows.count()


def test_documents_are_read_once_whatever_the_items(spark, tmp_path):
    docs = [(k, f"w{k} " * 12) for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    items = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k))) for k in range(1, 13)], "item_id long, text string")
    plan = decontam.matches(spark.read.parquet(f"{tmp_path}/d"), items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def turns_of(spark, *records):
    import json

    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "conv_id long, record string")
    return {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]] if r["turns"] is not None else None) for r in chat.canonical_turns(rows, "conv_id", "record").collect()}


def test_no_text_of_a_layout_is_lost(spark):
    message = lambda role, content, **more: {"role": role, "content": content, **more}
    got = turns_of(
        spark,
        {"messages": ["hello", "hi"]},
        {"messages": []},
        {"messages": [message("user", "a", name="Bo"), message("assistant", "b", name="x")]},
        {"messages": [message("user", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]), message("model", [{"type": "text", "text": "c"}])], "id": 7},
        {"messages": [message("user", [{"text": "a"}])]},
        {"messages": [message("user", "a"), message("assistant", [{"type": "text", "text": "b"}])]},
        {"messages": ["a", {"role": "user", "content": "b"}]},
        {"messages": [message("user", [{"type": "image", "url": "u"}])]},
    )
    assert got[0] == ("message_texts", [("user", "hello"), ("assistant", "hi")]) and got[1] == ("messages", [])
    assert got[2] == ("messages", [("user", "a"), ("assistant", "b")]) and got[3] == ("message_parts", [("user", "ab"), ("assistant", "c")]) and got[4] == ("message_parts", [("user", "a")])
    # Of several shapes in one place, or of shapes that nothing declares: told as unmapped, not as empty turns.
    assert all(got[k] == (None, None) for k in (5, 6, 7))
    import json

    rows = spark.createDataFrame([(json.dumps({"messages": ["a", {"role": "user", "content": "b"}]}),)], "record string")
    assert chat.unmapped_layouts(rows, "record").first()["n"] == 1

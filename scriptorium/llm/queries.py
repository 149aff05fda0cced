"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, chat, clustering, common, decontam, langid, lm, media, quality, search, simhash, substrings, toxicity, warc


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.pack_messages(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return chat.digest_chat(chat.format_chat(records.unionByName(more, allowMissingColumns=True), "conv_id", "record", packed_col="messages"), "conv_id").drop("layout")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "media")
    media.write_media(_table(spark, sf_dir, "documents"), "doc_id", "text", path)
    stored = media.read_media(spark, path)
    return stored.select(F.col("name").cast("long").alias("doc_id"), "n_bytes", *media.payload_columns(), "media_bytes", "media_sha256", "feature", "error")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary_path(), keep=[F.col("doc_id")], schema="doc_id long")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path, payloads=False)
    page = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long")).otherwise(warc.page_of("record_id"))  # no record is lost in silence
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_media_columns, op3_toxicity, op4_language_id, op5_simhash_near_dedup, op6_lm_scoring, op7_benchmark_decontamination, op8_bpe, op9_quality_classifier, op10_warc, op11_centroid_clustering, op12_ranked_search, op13_suffix_dedup)}

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(\[|<)(/?INST\]|ROLE\]|/?s>)', '\1\\\2', 'g')"
_TURN = f"CASE WHEN role = 'assistant' THEN '<s>' || {_ESCAPED.format('text')} || '</s>' ELSE '[INST]' || {_ESCAPED.format('role')} || '[ROLE]' || {_ESCAPED.format('text')} || '[/INST]' END"



def _rounds(k: int, rounds: int) -> str:
    """The rounds of clustering as steps of a WITH: all distances of all vectors, the least by (distance, number)."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
    out = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))"]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min(d * 1000 + k) AS m FROM (SELECT v.r, v.vec_id, v.e, c.k, {square}::HUGEINT AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            out.append(f"s{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m % 1000 AS k, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY k, i)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(b.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS e FROM s{n} GROUP BY k) b ON c.k = b.k)")
    return ",\n".join(out)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op11_centroid_clustering": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), {_rounds(40, 5)},
f AS (SELECT vec_id, (m % 1000)::INTEGER AS cluster, (m // 1000)::BIGINT AS distance FROM a5)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM f JOIN c5 c ON f.cluster = c.k""",
    "op12_ranked_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*)::BIGINT AS big_n, coalesce(sum(len(w)), 1)::BIGINT AS big_l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS MATERIALIZED (SELECT item, t, count(*)::BIGINT AS qtf FROM (SELECT item, unnest(w) AS t FROM (SELECT row_number() OVER () AS item, {_TERMS} AS w FROM benchmark)) GROUP BY item, t),
b AS (SELECT row_number() OVER () AS item, item_id FROM benchmark),
k AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g WHERE t IN (SELECT t FROM q) GROUP BY t, big_n),
s AS (
  SELECT q.item, d.r, any_value(d.doc_id) AS doc_id, sum(q.qtf * k.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * len(d.w) * g.big_n) // g.big_l))))::BIGINT AS score
  FROM q JOIN k ON q.t = k.t JOIN p ON q.t = p.t JOIN d ON p.r = d.r, g GROUP BY q.item, d.r
), o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT b.item_id, o.rank::INTEGER AS rank, o.doc_id, o.score FROM o JOIN b ON o.item = b.item WHERE o.rank <= 10""",
    "op1_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length({_TURN})) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM s""",
    "op7_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM (SELECT item_id, w, least(len(w), 10) AS l FROM i WHERE len(w) > 0))
), dw AS (
  SELECT r, l, s, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
), m AS (
  SELECT dw.r, dw.s, dw.l, iw.item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.g = iw.g
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM m) GROUP BY r
), k AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN k ON d.r = k.r""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
h AS (SELECT p.page_id, g.first, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS hex FROM p JOIN g ON p.html = g.html)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, (k // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM h""",
}

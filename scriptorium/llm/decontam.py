"""Benchmark decontamination by winnowing. Native throughout: only DataFrame functions.

Words are runs of digits, a-z and characters beyond ASCII, A-Z lower-cased. A window is `WINDOW` consecutive words of a benchmark
item (an item with fewer words is one window of its own length). For windows of L words, K-gram hashes with K = ceil(L / 2)
are taken, and of every L - K + 1 consecutive ones the least is kept, on both sides; so any shared span of L words or more has a kept
hash in common at the same place. Documents' and items' kept hashes are joined; each hit is extended on its diagonal to the windows
around it and compared word by word, so that what counts is exact. Windows that begin at a hit's place or before it are the only ones
that contain it, so a hit takes L + L - K words along and never a whole document. Each distinct window of an item stands under its own kept
hash once, however many items have it.

Items' hashes are broadcast only if their words have at most BROADCAST bytes, with what a row and a string take; beyond that both sides are
shuffled by hash. What many items share is joined once: hits are of distinct windows, and the items of a window come in when a
document's distinct windows are known.

Defined results: null and empty texts have no words; an item without words matches nothing; a null item_id is never listed; repeated
rows stay, each with the same result; an empty benchmark leaves all documents clean; other columns are ignored. A document's
words are one row's array, so a text must fit a task's memory several times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 10
PLACE = 16  # over WINDOW: a place and a length are one number
BROADCAST = 32 << 20
ROW, STRING = 200, 24  # bytes that a row and a string take in a broadcast besides their content, about
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def gram(length):
    """K for windows of so many words, a number or a column."""
    return F.floor((length + 1) / 2).cast("int") if isinstance(length, Column) else (length + 1) // 2


def packed_hashes(w: Column, length) -> Column:
    """The hashes of all K-grams of an array of words: numbers with the hash above, and in the low 32 bits the place (from 0) and the length."""
    k = gram(length)
    high = F.lit(-(1 << 32)).cast("long")
    every = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)).bitwiseAND(high).bitwiseOR((i * PLACE + length).cast("long")))
    return F.when(F.size(w) >= length, every).otherwise(F.array().cast("array<bigint>"))


def _winnowed(df: DataFrame, length: int, name: str) -> DataFrame:
    """df with the kept hashes of its column w as an array column: the least of every so many consecutive ones."""
    wide = length - gram(length) + 1
    if wide == 1:
        return df.withColumn(name, packed_hashes(F.col("w"), length))
    none = F.array().cast("array<bigint>")
    least = F.when(F.size("__packed") >= wide, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__packed") - (wide - 1)), lambda i: F.array_min(F.slice("__packed", i, wide))))).otherwise(none)
    return df.withColumn("__packed", packed_hashes(F.col("w"), length)).withColumn(name, least).drop("__packed")


def _hash_and_place(packed: str) -> list[Column]:
    return [F.shiftright(packed, 32).cast("int").alias("h"), F.shiftright(F.col(packed).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 4).cast("int").alias("p")]


def windows_at(w: str, p: str, length: Column) -> Column:
    """The words from the first window that holds the K-gram at p to the last one's end, and how many come before p."""
    before = F.least(F.col(p), length - gram(length))
    return F.struct(before.alias("before"), F.slice(F.col(w), F.col(p) - before + 1, before + length).alias("around"))


def item_windows(items: DataFrame) -> DataFrame:
    """(length, h, before, words, window) of items (w, length): a row for each window, with the kept hash in it; items of all lengths in one pass.

    A window's least hash is kept on both sides, and stands at the same place of equal windows: the leftmost where it is repeated.
    """
    length = F.col("length")
    least = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.struct(i.alias("start"), F.array_min(F.slice("packed", i + 1, length - gram(length) + 1)).alias("k"), F.slice("w", i + 1, length).alias("words")))
    rows = items.withColumn("packed", packed_hashes(F.col("w"), length)).select("length", F.inline(least))
    h, p = _hash_and_place("k")
    return rows.select("length", h, (p - F.col("start")).alias("before"), "words", F.array_join("words", " ").alias("window"))


def owners(items: DataFrame) -> DataFrame:
    """(own, item_id): the windows of items (item_id, w, length), each with the items that have it."""
    every = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda i: F.array_join(F.slice("w", i + 1, F.col("length")), " "))
    return items.filter("item_id IS NOT NULL").select(F.explode(every).alias("own"), F.col("item_id").cast("string").alias("item_id")).distinct()


def _sized(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, w and the length of their windows."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return items.withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, n_words, row, hits): a row for each document with row 1, and rows of its hits: structs of start, length and window.

    Rows that no item meets end in the join, in one generated loop with the explosion, so a document's words are never copied along
    with its hashes; a filter on `hits`, which no generated code evaluates, would move in between and must come after an outer explosion.
    """
    items = _sized(benchmark)
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most WINDOW numbers
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hit_type = "array<struct<start:int,length:int,window:string>>"
    clean = base.select("id", "text_hash", F.size("w").alias("n_words"), F.lit(1).alias("row"), F.array().cast(hit_type).alias("hits"))
    if not lengths:
        return clean
    own = item_windows(items).distinct()
    taken = F.aggregate("words", F.lit(ROW).cast("long"), lambda total, w: total + 2 * F.octet_length(w) + STRING)
    small = (own.agg(F.sum(taken)).first()[0] or 0) <= BROADCAST
    kept = base
    for length in lengths:
        kept = _winnowed(kept, length, f"kept{length}")
    # Kept hashes of all lengths are one list, so documents are read, split and exploded once. -1 stands for the row itself, so that it lasts without hits.
    every = [F.col(f"kept{length}") for length in lengths]
    marked = F.concat(*([F.array(F.lit(-1).cast("long"))] if small else []), *every) if small or len(every) > 1 else every[0]
    listed = kept.select("id", "text_hash", "w", F.explode(marked).alias("k"))
    h, p = _hash_and_place("k")
    listed = listed.select("id", "text_hash", "w", F.when(F.col("k") != -1, h).alias("h"), F.when(F.col("k") == -1, -1).otherwise(p).alias("p"), F.col("k").bitwiseAND(F.lit(PLACE - 1).cast("long")).cast("int").alias("of"))
    near = windows_at("w", "p", F.col("of"))
    if small:
        joined = listed.join(F.broadcast(own), "h", "left").filter(F.col("words").isNotNull() | (F.col("p") == -1))
        joined = joined.select("id", "text_hash", F.size("w").alias("n_words"), "length", "of", "p", "before", "words", "window", F.when(F.col("p") >= 0, near).alias("near"))
    else:
        joined = listed.select("id", "text_hash", F.size("w").alias("n_words"), "h", "of", "p", near.alias("near")).join(own, "h")
    # The hit is extended to the window that has it at the same place.
    whole = F.slice("near.around", F.greatest(F.lit(0), F.col("near.before") - F.col("before")) + 1, F.coalesce("length", F.lit(0)))
    equal = (F.col("p") >= 0) & (F.col("of") == F.col("length")) & (F.col("before") <= F.col("near.before")) & (whole == F.col("words"))
    hit = F.struct((F.col("p") - F.col("before")).cast("int").alias("start"), F.col("length").cast("int").alias("length"), F.col("window").alias("window"))
    hits = F.when(equal, F.array(hit)).otherwise(F.array()).cast(hit_type)
    rows = joined.select("id", "text_hash", "n_words", F.when(F.col("p") == -1, 1).otherwise(0).alias("row"), hits.alias("hits"))
    return rows if small else rows.unionByName(clean)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = matches(docs, benchmark)
    key = ["id", "text_hash", "n_words"]
    # A document has bounded places; what its repeated rows and hits say is the same and is merged.
    each = rows.select(*key, "row", F.explode_outer("hits").alias("hit")).select(*key, "row", F.col("hit.start").alias("start"), F.col("hit.length").alias("length"), F.col("hit.window").alias("window"))
    spots = each.groupBy(*key, "start", "length", "window").agg(F.sum("row").alias("copies"))
    by_place = Window.partitionBy(*key).orderBy(F.col("start").asc_nulls_first(), "length")
    end = F.col("start") + F.col("length")
    reached = F.max(end).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    done = spots.withColumn("fresh", F.when(F.col("start").isNotNull(), fresh).otherwise(0)).groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.sum("fresh").alias("n_hit"), F.collect_set("window").alias("windows")
    )
    # Only then the items that have a document's distinct windows.
    own = owners(_sized(benchmark))
    taken = ROW + 2 * F.octet_length("own") + F.octet_length("item_id")
    if (own.agg(F.sum(taken)).first()[0] or 0) <= BROADCAST:
        own = F.broadcast(own)  # a window that very many documents have is no key of a shuffle then
    # Documents without windows have a key of their own each, so they spread over the tasks.
    each = done.select(*key, "copies", "n_hit", F.explode_outer("windows").alias("window")).withColumn("window", F.coalesce("window", F.concat(F.lit("\n"), F.col("text_hash").cast("string"))))
    named = each.join(own, F.col("window") == F.col("own"), "left").groupBy(*key).agg(F.max("copies").alias("copies"), F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    out = named.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with all their columns."""
    bad = matches(docs, benchmark).select("id", "text_hash", F.explode_outer("hits").alias("hit")).filter("hit IS NOT NULL").select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__null"), F.col("text_hash").alias("__hash")).distinct()
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__hash": F.xxhash64("text")})
    return marked.join(bad, ["__id", "__null", "__hash"], "left_anti").drop("__id", "__null", "__hash")

"""Ranked lexical search over a two-level quantised index, exact.

The index has a row for each block of whole documents. Its first level says, for each term of the block and each document that holds it, the term's
impact in one byte, rounded upward: impact <= byte * STEP, and impact > (byte - 1) * STEP. Its second level keeps what is exact: occurrences and
lengths. A search goes over the first level once for lower bounds (each task hands on the k best of each query, and the kth best of those together is
a bound that k documents reach), and once for upper bounds: every document whose upper bound reaches the kth lower bound is scored anew
in integers from the second level of its own block, and each task hands on its k best. Nothing is dropped that could be among the k best.

What goes to all tasks are the terms of a group of queries, at most QUERY_BYTES of text; more queries are dealt into more groups, each searched
by itself. Document frequencies of the queries' terms are counted over the whole index.

Defined results: a null text has no terms. Documents without an id are ranked like others, after those with one where scores are equal; repeated
rows take a rank each. Each row of the queries is a query of its own, also where its id is null or met again; a query without terms, or
whose terms no document holds, has no rows. Terms with weight 0 give nothing, and no document with score 0 is returned. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import removed
from scriptorium.llm.lm import stored
from scriptorium.session import ship

TOP = 10
STEP = -(-1_000_000 // 255)  # of an impact, which is at most 1,000,000
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20  # a block ends beyond it; a document is never cut
QUERY_BYTES = 1 << 20  # of the text of queries searched together
CELLS = 1 << 22  # of the table of bounds that a task has in memory at a time
_FORM = "ids array<bigint>, terms binary, offsets binary, docs binary, counts binary, lengths binary"
#: Bytes of UTF-8 to bytes in which terms are runs between blanks: only A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split() if text else []


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The impact of `tf` occurrences in documents of n terms; `documents` have `total` terms."""
    m = 25 + (75 * n * documents) // max(total, 1)
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Numbers(dict):
    """Terms of a block, numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = len(self)
        return self[term]


def _block(ids: list, sizes: list, keys: list[np.ndarray], counts: list[np.ndarray], numbers: Numbers) -> dict:
    """Postings by term, and within a term by document."""
    docs = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    key, count = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(key, minlength=len(numbers))))
    return {"ids": ids, "terms": b" ".join(numbers), "offsets": offsets.astype("<i4").tobytes(), "docs": docs[order].astype("<u2").tobytes(), "counts": count[order].astype("<u4").tobytes(), "lengths": np.array(sizes, "<i8").tobytes()}


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of documents: exact postings by term, and the documents' lengths."""
    ship(docs.sparkSession)
    names = ["ids", "terms", "offsets", "docs", "counts", "lengths"]
    schema = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys, counts, numbers, have = [], [], [], [], Numbers(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                own = terms(text.as_py())
                key, count = np.unique(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)), return_counts=True)
                ids.append(doc)
                sizes.append(len(own))
                keys.append(key)
                counts.append(count)
                have += len(key)
                if have >= BLOCK_POSTINGS or len(ids) == BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([_block(ids, sizes, keys, counts, numbers)], schema)
                    ids, sizes, keys, counts, numbers, have = [], [], [], [], Numbers(), 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, sizes, keys, counts, numbers)], schema)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, _FORM)


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    for k in range(b.num_rows):
        yield {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}


class Index:
    """Both levels over all documents, in the shared folder, with their number (of those with terms) and that of their terms."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        exact, path = stored(postings(docs, id_col, text_col), "postings")

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [np.frombuffer(x.as_py(), "<i8") for x in b.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], names=["documents", "total"])

        said = exact.select("lengths").mapInArrow(sizes, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
        self.documents, self.total = documents, total = int(said[0] or 0), int(said[1] or 0)

        def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for r in _rows(b):
                    n = np.frombuffer(r["lengths"], "<i8")[np.frombuffer(r["docs"], "<u2")]
                    byte = -(-impact(np.frombuffer(r["counts"], "<u4").astype(np.int64), n, documents, total) // STEP)
                    made.append(byte.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "impacts"])

        self.rows, self.path = stored(exact.mapInArrow(quantise, f"{_FORM}, impacts binary"), "index")
        removed(docs.sparkSession, path)

    def remove(self) -> None:
        removed(self.rows.sparkSession, self.path)

    def frequencies(self, vocabulary: dict[bytes, int]) -> dict[bytes, int]:
        """In how many documents each term of a vocabulary is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(vocabulary), np.int64)
            for b in batches:
                for names, offsets in zip(b.column(0), b.column(1), strict=True):
                    at = np.frombuffer(offsets.as_py(), "<i4")
                    for k, t in enumerate(names.as_py().split()):
                        if t in vocabulary:
                            df[vocabulary[t]] += at[k + 1] - at[k]
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

        # At most a row for each term of the vocabulary comes to the driver.
        rows = self.rows.select("terms", "offsets").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        back = list(vocabulary)
        return {back[r["term"]]: int(r["df"]) for r in rows}


class Queries:
    """Queries searched together: for each term, which of them hold it, and how much an impact counts there."""

    def __init__(self, rows: list[tuple[int, bytes | None]], index: Index):
        held: dict[bytes, dict[int, int]] = defaultdict(dict)
        for k, (_, text) in enumerate(rows):
            for t, n in Counter(terms(text)).items():
                held[t][k] = n
        df = index.frequencies({t: i for i, t in enumerate(held)}) if held else {}
        self.numbers = [number for number, _ in rows]
        self.by_term: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for t, own in held.items():
            w = weight(index.documents, df[t]) if t in df else 0
            if w:
                self.by_term[t] = (np.array(list(own), np.int64), w * np.array(list(own.values()), np.int64))
        self.documents, self.total = index.documents, index.total

    def bounds(self, r: dict, lower: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, table): bounds of all documents of a block for the queries from first to before last."""
        at, docs, impacts = np.frombuffer(r["offsets"], "<i4"), np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["impacts"], np.uint8).astype(np.int64)
        level = np.where(impacts > 0, (impacts - 1) * STEP + 1, 0) if lower else impacts * STEP
        met = [(k, *self.by_term[t]) for k, t in enumerate(r["terms"].split()) if t in self.by_term]
        some = max(1, CELLS // max(1, len(r["ids"])))
        for first in range(0, len(self.numbers), some):
            last = min(first + some, len(self.numbers))
            out = np.zeros((last - first, len(r["ids"])), np.int64)
            for k, who, worth in met:
                a, b = np.searchsorted(who, (first, last))
                if a < b:
                    own = slice(at[k], at[k + 1])
                    # A document is once in a term's list, so none is added to twice at a time.
                    out[np.ix_(who[a:b] - first, docs[own])] += worth[a:b, None] * level[own]
            yield first, last, out

    def exact(self, r: dict, query: int, wanted: np.ndarray, places: dict[bytes, int]) -> np.ndarray:
        """The scores of some documents of a block for a query."""
        at, docs, counts, lengths = np.frombuffer(r["offsets"], "<i4"), np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["lengths"], "<i8")
        score = np.zeros(len(wanted), np.int64)
        for t, worth in self.terms_of(query):
            k = places.get(t)
            if k is None:
                continue
            own = docs[at[k] : at[k + 1]]
            where = np.searchsorted(own, wanted)
            hit = np.flatnonzero((where < len(own)) & (own[np.minimum(where, len(own) - 1)] == wanted))
            score[hit] += worth * impact(counts[at[k] : at[k + 1]][where[hit]].astype(np.int64), lengths[wanted[hit]], self.documents, self.total)
        return score

    def terms_of(self, query: int) -> list[tuple[bytes, int]]:
        if not hasattr(self, "_own"):
            self._own = defaultdict(list)
            for t, (who, worth) in self.by_term.items():
                for k, x in zip(who.tolist(), worth.tolist(), strict=True):
                    self._own[k].append((t, x))
        return self._own[query]


def _least(index: Index, queries: Queries, top: int) -> np.ndarray:
    """For each query, the kth best lower bound of all documents; 1 where fewer have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries.numbers), top), np.int64)
        for b in batches:
            for r in _rows(b):
                for first, last, table in queries.bounds(r, True):
                    every = np.concatenate([best[first:last], table], axis=1)
                    best[first:last] = np.partition(every, every.shape[1] - top, axis=1)[:, -top:]
        q, k = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, k])], names=["query", "bound"])

    told = index.rows.select("ids", "terms", "offsets", "docs", "impacts").mapInArrow(run, "query long, bound long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc()))
    least = np.ones(len(queries.numbers), np.int64)
    for r in told.withColumn("nth", nth).filter(F.col("nth") == top).select("query", "bound").collect():  # a row for each query
        least[r["query"]] = r["bound"]
    return least


def _found(index: Index, queries: Queries, top: int) -> DataFrame:
    """(query, doc_id, score): the best of each block, scored exactly."""
    least = _least(index, queries, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                places = {t: k for k, t in enumerate(r["terms"].split()) if t in queries.by_term}
                number, ids, scores = [], [], []
                # No id comes after all ids.
                order = np.array([(1 << 63) - 1 if i is None else i for i in r["ids"]], np.int64)
                missing = np.array([i is None for i in r["ids"]], bool)
                for first, _, table in queries.bounds(r, False):
                    reach = table >= least[first : first + len(table), None]
                    for q in np.flatnonzero(reach.any(1)):
                        wanted = np.flatnonzero(reach[q])
                        score = queries.exact(r, first + q, wanted, places)
                        some = np.lexsort((order[wanted], missing[wanted], -score))[:top]
                        some = some[score[some] > 0]
                        number += [queries.numbers[first + q]] * len(some)
                        ids += [r["ids"][k] for k in wanted[some]]
                        scores += score[some].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return index.rows.mapInArrow(run, "query long, doc_id long, score long")


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", *, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the `top` best documents of each row of queries."""
    spark = queries.sparkSession
    size = F.octet_length(F.coalesce("text", F.lit("")))
    # Numbers are told once and stay with the rows, which are written.
    own, _ = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")), "queries")
    total = own.agg(F.sum(size)).first()[0] or 0
    groups = max(1, -(-total // QUERY_BYTES))
    best = None
    for g in range(groups):
        rows = [(r["query"], bytes(r["t"]) if r["t"] is not None else None) for r in own.filter(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).select("query", F.col("text").cast("binary").alias("t")).orderBy("query").collect()]
        if not rows:
            continue
        found, _ = stored(_found(index, Queries(rows, index), top), "found")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(own.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, *, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each query, by an index that is built for it and removed after."""
    index = Index(docs)
    found, _ = stored(search(index, queries, top=top), "ranked")
    index.remove()
    return found

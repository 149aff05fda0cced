"""Language-model scoring: smoothed n-grams as a weighted backoff automaton kept in tables.

Tokens of a text are its words (A-Z lower-cased, split at ASCII white space) and one end. Each task encodes the documents of its part in
blocks of some BLOCK_TOKENS tokens, and a block asks for what the whole corpus says of its own words and n-grams: it sends each of them
once, by a hash, with its own count. Requests are dealt by ranges of the hash, summed by key, and every asking block gets the
sums back. Requests and answers of a block and a range are one row of packed arrays, so a very frequent n-gram is one number for each
block wherever it goes, and no table of words or n-grams is ever held whole. Words are told apart by 96 bits, so their counts are exact
(among 10 thousand million words, two are the same with a chance of 1e-9); n-grams by 64 bits.

The model interpolates absolute discounting: words that occur LEAST times or more in the training documents make n-grams up to ORDER, and
those that occur LEAST times or more are kept, however large the corpus is (`short` and `kept` can ask for shares of all tokens besides).
A state is a history; it has an arc for each kept continuation, whose weight includes the lower orders, and a failure arc to the
history without its first word, whose weight is the mass that was discounted or not kept. The root has every word by its own count, and
one class for words not seen, which gets what discounting took from the seen. A text is read from left to right: the state after
a word is the longest kept history there (a word outside the model leads back to the root), a word takes the state's arc, or failure arcs
down to a state that has one, and the logarithms are summed.

Rounds: words; then for each order the n-grams whose parts are kept; and for each history the mass that its kept continuations
take, which the block that is first to ask for an n-gram adds for it. The model grows with the corpus and is never collected or broadcast.
Defined results: a null or empty text is its end alone; without training documents every count is 0 and the model gives each token
probability 1; a null doc_id is learned from not at all and held_out is false; repeated rows count as often as they occur; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import held_out, learnable, removed, scratch
from scriptorium.session import ship

ORDER = 3
LEAST = 2  # occurrences of a word or an n-gram of the model
DISCOUNT = 0.75
BLOCK_TOKENS = 1_200_000
RANGE_BYTES = 6_000_000  # of text for a range of hashes: at most about a million n-grams
DOC_TOKENS = 200_000  # of documents in a row, if it has more than one
END = b"\n"  # no word holds white space
START_KEY = np.uint64(xxhash.xxh3_64_intdigest(b" "))
STRETCH = 512  # words that are read in one go
PART_BLOCKS = 1 << 11  # blocks of a part, at most

#: A row has some documents of a block (ids are places in its words), or a request: `size` keys from number `lo` on, with a value each.
REQUEST = "block long, what string, range long, lo int, size int, keys binary, more binary, value binary"
ENCODED = f"{REQUEST}, at int, doc_ids array<long>, held_out array<boolean>, learn array<boolean>, sizes array<int>, ids binary"
#: An answer: sums of the requests `at`, whether this block is the first to ask (bits), and totals of a range.
ANSWER = "block long, what string, size int, at binary, value binary, own binary, totals array<long>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def packed(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size).T).view(dtype).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _requests(block: int, what: str, keys: np.ndarray, value: np.ndarray, ranges: int, more: np.ndarray | None = None) -> list[dict]:
    """Rows of REQUEST, one for each range that the ascending keys have."""
    if not len(keys):
        return []
    of = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]
    return [
        {"block": block, "what": what, "range": int(of[a]), "lo": a, "size": b - a, "keys": packed(_steps(keys[a:b])), "more": None if more is None else packed(more[a:b]), "value": packed(value[a:b].astype(np.float64))}
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]


def encoded(docs: DataFrame, ranges: int, *, mod: int, rem: int, text_col: str = "text") -> DataFrame:
    """Blocks: rows of documents, and requests for the counts of the block's words."""
    schema = _arrow(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = 0, 0, 0
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        rows: list[tuple] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if block >= PART_BLOCKS or part >= 1 << 40:
                raise ValueError("too many blocks or parts to number; repartition the documents")
            number = part * PART_BLOCKS + block
            digests = [xxhash.xxh3_128_digest(w) for w in vocabulary]
            keys = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            counts = np.zeros(len(order), np.int64)
            for _, _, learn, ids in rows:
                if learn:
                    own = np.bincount(ids)
                    counts[: len(own)] += own
            out, few, many = [], [], 0
            for k, row in enumerate(rows):
                few.append(row)
                many += len(row[3])
                if many >= DOC_TOKENS or k == len(rows) - 1:
                    ids, outside, learn, words = zip(*few, strict=True)
                    out.append({"block": number, "at": k, "doc_ids": ids, "held_out": outside, "learn": learn, "sizes": [len(x) for x in words], "ids": packed(place[np.concatenate(words)])})
                    few, many = [], 0
            out += _requests(number, "count1", keys[order, 0], counts[order], ranges, (keys[order, 1] >> np.uint64(32)).astype(np.uint32))
            yield pa.RecordBatch.from_pylist(out, schema)

        for b in batches:
            part = b.column(4)[0].as_py() if b.num_rows else part
            for doc_id, out, learn, text in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                ids = np.fromiter(map(vocabulary.__getitem__, tokens(text or b"")), np.int32)
                rows.append((doc_id, out, learn, ids))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from finish()
                    held, block = 0, block + 1
                    vocabulary.clear()
                    rows.clear()
        if rows:
            yield from finish()

    chosen = docs.select(F.col("doc_id"), held_out("doc_id", mod, rem), learnable("doc_id", mod, rem), F.col(text_col).cast("string").cast("binary"), F.spark_partition_id())
    return chosen.mapInArrow(run, ENCODED)


def summed(requests: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rows of ANSWER: values summed by key over all blocks, for keys that have `least` of their kind or more.

    A group is a range of hashes: some RANGE_BYTES of text whatever the size of the corpus, and of a key a number for each block.
    """
    schema = _arrow(ANSWER)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        what, blocks, sizes = rows.column("what")[0].as_py(), rows.column("block").to_pylist(), rows.column("size").to_pylist()
        lo, ends = rows.column("lo").to_pylist(), np.cumsum([0, *sizes])
        column = lambda name, kind: [unpacked(d, n, kind) for d, n in zip(rows.column(name).to_pylist(), sizes, strict=True)]
        keys, value = np.concatenate([np.cumsum(k, dtype=np.uint64) for k in column("keys", np.uint64)]), np.concatenate(column("value", np.float64))
        if rows.column("more").null_count:
            order = np.argsort(keys, kind="stable")
            new = keys[order[1:]] != keys[order[:-1]]
        else:
            more = np.concatenate(column("more", np.uint32))
            order = np.lexsort((more, keys))
            new = (keys[order[1:]] != keys[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
        first = np.concatenate([[True], new])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        sums = np.bincount(number, value)
        own = np.zeros(len(order), bool)
        own[order[first]] = True  # both sorts are stable, so this is the least block
        totals = [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]
        out = []
        for k, block in enumerate(blocks):
            s = sums[number[ends[k] : ends[k + 1]]]
            at = np.flatnonzero(s >= least[what])
            if len(at) or k == 0:
                out.append({"block": block, "what": what, "size": len(at), "at": packed(_steps((at + lo[k]).astype(np.uint32))), "value": packed(s[at]), "own": np.packbits(own[ends[k] : ends[k + 1]][at]).tobytes(), "totals": totals if k == 0 else None})
        return pa.Table.from_pylist(out, schema)

    return requests.groupBy("what", "range").applyInArrow(run, ANSWER)


@dataclass
class Unigrams:
    """Totals of the training tokens, training texts and the discount of the root."""

    total: int
    distinct: int
    discount: float
    texts: int

    def root(self, c: np.ndarray) -> np.ndarray:
        """The root's probability of tokens with these counts."""
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.discount) / self.total, self.discount * self.distinct / self.total)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


@dataclass
class Level:
    """The n-grams of one order in a block: the number of that which ends at each place (or -1), and of each its key, history and sums."""

    numbers: np.ndarray
    keys: np.ndarray
    history: np.ndarray  # number in the level below
    count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    taken: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of a history's occurrences, by its kept continuations


class Block:
    """A block's tokens, a start before each document, and its levels up to what the answers know."""

    def __init__(self, rows: pa.Table, answers: pa.Table, model: Unigrams, short: float, known: int) -> None:
        self.model, self.block = model, rows.column("block")[0].as_py()
        texts, words = rows.filter(rows.column("ids").is_valid()).sort_by("at"), rows.filter(rows.column("keys").is_valid()).sort_by("lo")
        names = ("doc_ids", "held_out", "learn", "sizes")
        self.doc_ids, outside, learn, sizes = (pa.chunked_array([c for x in texts.column(n).chunks if len(c := x.flatten())] or [pa.array([], texts.schema.field(n).type.value_type)]) for n in names)
        self.outside, self.sizes = outside, sizes.to_numpy()
        flat = [unpacked(d, sum(n), np.int32) for d, n in zip(texts.column("ids").to_pylist(), texts.column("sizes").to_pylist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1] + np.arange(len(self.sizes))
        keys = [np.cumsum(unpacked(d, n, np.uint64), dtype=np.uint64) for d, n in zip(words.column("keys").to_pylist(), words.column("size").to_pylist(), strict=True)]
        size = sum(map(len, keys))
        ids = np.insert(np.concatenate(flat), self.starts - np.arange(len(self.starts)), size)
        self.learn = np.repeat(learn.to_numpy(zero_copy_only=False).astype(bool), self.sizes + 1)
        self.follows = np.ones(len(ids), bool)
        self.follows[self.starts] = False
        self.levels = [Level(ids, np.concatenate([*keys, [START_KEY]]), np.zeros(0, np.int64))]
        for order in range(1, known + 1):
            level = self.levels[0] if order == 1 else self.next_level()
            level.count, level.own = self._answer(answers, f"count{order}", len(level.keys))
            level.kept = level.count > 0
            if order == 1:
                level.count[-1] = model.texts
                level.kept = level.count >= short
                level.kept[-1] = model.texts > 0
            asked = self._asked(level)
            level.taken = np.zeros(len(level.keys))
            level.taken[asked] = self._answer(answers, f"after{order}", len(asked))[0]

    @staticmethod
    def _asked(level: Level) -> np.ndarray:
        """The kept n-grams of a level by key (the start stands after the words)."""
        kept = np.flatnonzero(level.kept)
        return kept[np.argsort(level.keys[kept], kind="stable")]

    @staticmethod
    def _answer(answers: pa.Table, what: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums of so many requests, and which this block was the first to make; 0 where there is no answer."""
        sums, first = np.zeros(size), np.zeros(size, bool)
        rows = answers.filter(pa.compute.equal(answers.column("what"), what))
        for n, at, value, own in zip(*(rows.column(c).to_pylist() for c in ("size", "at", "value", "own")), strict=True):
            if n:
                places = np.cumsum(unpacked(at, n, np.uint32), dtype=np.int64)
                sums[places] = unpacked(value, n, np.float64)
                first[places] = np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool)
        return sums, first

    def next_level(self) -> Level:
        """The n-grams one word longer than the last level's, of which both parts are kept; added to the levels."""
        last, words = self.levels[-1], self.levels[0]
        kept = (last.numbers >= 0) & np.append(last.kept, False)[last.numbers]
        at = np.flatnonzero(kept[:-1] & kept[1:] & self.follows[1:]) + 1
        before = last.numbers[at - 1]
        keys = last.keys[before] * np.uint64(0x9E3779B97F4A7C15) + words.keys[words.numbers[at]] + np.uint64(len(self.levels))
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        numbers = np.full(len(last.numbers), -1, np.int64)
        numbers[at] = back
        self.levels.append(Level(numbers, own, before[first]))
        return self.levels[-1]

    def counts(self, ranges: int) -> list[dict]:
        """Requests for the counts of the n-grams one word longer than what is known."""
        level = self.next_level()
        numbers = level.numbers[self.learn & (level.numbers >= 0)]
        out = _requests(self.block, f"count{len(self.levels)}", level.keys, np.bincount(numbers, minlength=len(level.keys)), ranges)
        self.levels.pop()
        return out

    def afters(self, order: int, ranges: int) -> list[dict]:
        """Requests for what kept continuations take of the kept histories of this order; this block adds what it is the first to know."""
        level, longer = self.levels[order - 1], self.levels[order]
        own = longer.own & longer.kept
        taken = np.bincount(longer.history[own], longer.count[own] - DISCOUNT, len(level.keys))
        asked = self._asked(level)
        return _requests(self.block, f"after{order}", level.keys[asked], taken[asked], ranges)

    def scores(self) -> pa.Table:
        """The documents with their sums, all levels known."""
        ids, count = self.levels[0].numbers, self.levels[0].count
        p = Automaton(self.levels, self.model).read(ids, self.starts, self.sizes)
        add = lambda x: np.add.reduceat(np.where(self.follows, x, 0), self.starts)
        total = pa.array(np.full(len(self.sizes), self.model.total, np.int64))
        return pa.table({"doc_id": self.doc_ids, "held_out": self.outside, "n_tokens": pa.array(self.sizes.astype(np.int64)), "n_known": pa.array(add((count > 0)[ids].astype(np.int64))), "train_tokens": total, "base_score": pa.array(add(self.model.base(count)[ids])), "score": pa.array(add(p))})


class Automaton:
    """The part of the model that a block's texts can meet: states with arcs by word, and failure arcs.

    State 0 is the root, which has an arc for every word; the others are kept histories, of all orders below ORDER. An arc's weight is the
    whole probability of its word there, lower orders included; a failure arc's is what is left for the words that have no arc.
    """

    def __init__(self, levels: list[Level], model: Unigrams) -> None:
        words = levels[0]
        self.width = len(words.keys)
        self.root, self.first = model.root(words.count), np.where(words.kept, np.arange(self.width) + 1, 0)
        base = np.concatenate([[1], 1 + np.cumsum([len(x.keys) for x in levels[: ORDER - 1]])])
        self.fail, self.left = np.zeros(base[-1], np.int64), np.ones(base[-1])
        arcs, weights, to = [], [], []
        weight = self.root  # of the n-grams of the order below
        for k, history in enumerate(levels[: ORDER - 1]):
            level = levels[k + 1]
            begun = np.maximum(history.count, 1)
            left = 1 - history.taken / begun
            self.left[base[k] : base[k + 1]] = left
            place = np.zeros(len(level.keys), np.int64)
            at = np.flatnonzero(level.numbers >= 0)
            place[level.numbers[at]] = at
            word, shorter = words.numbers[place], history.numbers[place]  # the last word, and all without the first
            weight = (level.count - DISCOUNT) / begun[level.history] + left[level.history] * weight[shorter]
            some = np.flatnonzero(level.kept)
            arcs.append((base[k] + level.history[some]) * self.width + word[some])
            weights.append(weight[some])
            to.append((base[k + 1] + some) if k + 2 < ORDER else base[k] + shorter[some])
            if k + 2 < ORDER:
                self.fail[base[k + 1] : base[k + 2]] = base[k] + shorter
        arcs, weights, to = (np.concatenate([*x, np.zeros(0, y)]) for x, y in ((arcs, np.int64), (weights, np.float64), (to, np.int64)))
        order = np.argsort(arcs)
        self.arcs, self.weights, self.to = np.append(arcs[order], np.iinfo(np.int64).max), np.append(weights[order], 0.0), np.append(to[order], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and the logarithms of its probabilities: an arc of the state, or failure arcs down to a state that has one."""
        p, after = np.ones(len(state)), np.empty(len(state), np.int64)
        at = np.arange(len(state))
        while len(at):
            here = state[at]
            key = here * self.width + word[at]
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            p[at[hit]] *= self.weights[arc[hit]]
            after[at[hit]] = self.to[arc[hit]]
            root = ~hit & (here == 0)
            p[at[root]] *= self.root[word[at[root]]]
            after[at[root]] = self.first[word[at[root]]]
            down = at[~hit & ~root]
            p[down] *= self.left[state[down]]
            state[down] = self.fail[state[down]]
            at = down
        return after, np.log10(p)

    def read(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability: documents are read from left to right, all at once, each with its state.

        Before each document stands a start. Long ones are read in stretches: a state is told by the ORDER - 1 words before it, which a stretch reads first.
        """
        pieces = np.maximum(-(-sizes // STRETCH), 1)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[doc] + 1 + nth * STRETCH
        end = np.minimum(begin + STRETCH, starts[doc] + 1 + sizes[doc])
        at = np.maximum(starts[doc], begin - (ORDER - 1))
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those under way are a prefix
        at, begin, end = at[order], begin[order], end[order]
        state, out, live = np.zeros(len(at), np.int64), np.zeros(len(ids)), len(at)
        while live:
            state[:live], p = self.step(state[:live].copy(), ids[at[:live]])
            told = at[:live] >= begin[:live]
            out[at[:live][told]] = p[told]
            at[:live] += 1
            live = int(np.count_nonzero(at[:live] < end[:live]))
        return out


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df through a table in the shared folder, and its path; the shuffle files that made it go at once."""
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = scratch(df.sparkSession, name)
    before = conf.get(cleanup, None)
    try:
        conf.set(cleanup, "true")
    except AnalysisException:
        pass  # not a setting of this Spark: they go with the plan
    try:
        df.write.option("compression", "lz4").parquet(path)
    finally:
        if before is None:
            conf.unset(cleanup)
        else:
            conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def score_texts(docs: DataFrame, *, mod: int = 7, rem: int = 2, short: float = 0.0, kept: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model has words and n-grams that occur LEAST times, and also a share `short` or `kept` of all tokens.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    # At least some for each task of a shuffle, so that all have work.
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    own, path = stored(encoded(docs, ranges, mod=mod, rem=rem), "encoded")
    answers, used = stored(summed(own.filter("keys IS NOT NULL").select(*(c.split()[0] for c in REQUEST.split(", "))), {"count1": 0.0}), "answers")
    paths = [path, used]
    t = answers.filter("totals IS NOT NULL").agg(*(F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(4))).first()
    total, distinct, n1, n2 = (x or 0 for x in t)
    model = Unigrams(total, distinct, min(0.9, n1 / (n1 + 2 * n2)) if n1 else 0.0, own.agg(F.sum(F.size(F.filter("learn", lambda x: x)))).first()[0] or 0)
    if total and not n1:
        model.discount = 1 / (2 * distinct)  # something is left for words not seen
    listed, least = max(LEAST, short * total), max(LEAST, kept * total)

    def known(out: str, order: int, step) -> DataFrame:
        """What `step` makes of each block with all answers up to an order."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return step(Block(left, right, model, listed, order))

        blocks = own.select("block", "lo", "size", "keys", "at", "doc_ids", "held_out", "learn", "sizes", "ids")
        return blocks.groupBy("block").cogroup(answers.drop("totals").groupBy("block")).applyInArrow(run, out)

    schema = _arrow(REQUEST)
    for order in range(2, ORDER + 2):

        def ask(b: Block, order: int = order) -> pa.Table:
            rows = b.counts(ranges) if order <= ORDER else []
            return pa.Table.from_pylist(rows + (b.afters(order - 2, ranges) if order > 2 else []), schema)

        more, used = stored(summed(known(REQUEST, order - 1, ask), {f"count{order}": least, f"after{order - 2}": 1e-9}), "answers")
        answers = answers.unionByName(more)
        paths.append(used)
    scored, out = stored(known(SCORED, ORDER, Block.scores), "scored")
    removed(spark, *paths)
    return scored

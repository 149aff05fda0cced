"""Centroid clustering of integer vectors, exact, by filtering centroids through kd-trees.

Vectors are laid down once in kd-trees of at most TREE vectors, each built in the task that reads them; a node holds the count, the integer sums and the
box of its vectors. In a round every tree is gone through from its root with the centroids that may be nearest to some vector below: a centroid goes
when another one is strictly nearer at all points of the node's box, a node left with one centroid is assigned whole by its count and sums, and a
leaf left with several is resolved vector by vector. All is integer arithmetic (products of doubles only where they are exact), so ties go to the
smaller number as if every distance had been computed. A task hands on a count and sums for each centroid; the driver gets those of all
centroids (`k` times 65 numbers), never a vector.

Defined results: a vector that is null, has another length, or has a null or non-finite component is left out. Vectors without an id are assigned like
others, but none is a starting centroid. Of vectors with equal ids, the lesser by components starts first. With fewer vectors than centroids each is one;
without vectors there are no rows. A scaled component beyond LIMIT is an error, as its squared distances might not fit in a long.
Rows may be repeated; further columns, by any name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import removed
from scriptorium.llm.lm import stored
from scriptorium.session import ship

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
TREE = 4096  # vectors of a tree: bounds a worker's memory, not what is read
LEAF = 32
LIMIT = 1 << 26
_FORM = "ids array<bigint>, wide int, points binary, starts binary, stops binary, rights binary, lows binary, highs binary, sums binary"


def vectors(table: DataFrame, id_col: str, vector_col: str, *, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that are whole, each component x as the integer floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    far = F.raise_error(F.format_string("a component of vector %s is too large", F.col(id_col).cast("string"))).cast("bigint")
    scaled = F.transform(v, lambda x: F.when(F.abs(x * scale) > LIMIT, far).otherwise(F.floor(x * scale)))
    return table.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("v"))


def starts(kept: DataFrame, k: int = CENTROIDS, salt: str = "2:") -> np.ndarray:
    """The first centroids: the k vectors whose ids' digests are smallest; k rows come to the driver."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = kept.filter("id IS NOT NULL").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Tree:
    """A kd-tree in preorder: the left child follows its parent; `rights` has the right one, 0 for a leaf. Points are in the order of leaves."""

    def __init__(self, points: np.ndarray, starts, stops, rights, lows, highs, sums):
        self.points, self.starts, self.stops, self.rights, self.lows, self.highs, self.sums = points, starts, stops, rights, lows, highs, sums

    @classmethod
    def build(cls, x: np.ndarray) -> tuple["Tree", np.ndarray]:
        """The tree of the rows of x, and their order in it."""
        order = np.arange(len(x))
        spans, rights, lows, highs, sums = [], [], [], [], []
        todo = [(0, len(x), -1)]  # a span, and the node whose right child it is
        while todo:
            a, b, parent = todo.pop()
            node = len(spans)
            if parent >= 0:
                rights[parent] = node
            own = x[order[a:b]]
            low, high = own.min(0), own.max(0)
            spans.append((a, b))
            rights.append(0)
            lows.append(low)
            highs.append(high)
            sums.append(own.sum(0))
            wide = int((high - low).argmax())
            if b - a <= LEAF or low[wide] == high[wide]:
                continue  # equal vectors are one leaf, however many
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], half)]
            todo += [(a + half, b, node), (a, a + half, -1)]
        s = np.array(spans, np.int64)
        return cls(x[order], s[:, 0], s[:, 1], np.array(rights, np.int64), np.array(lows), np.array(highs), np.array(sums)), order

    def assign(self, c: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(node, start, stop, what): what is the number of the only centroid left, or one for each vector of a leaf."""
        small = max(int(np.abs(self.lows).max(initial=0)), int(np.abs(self.highs).max(initial=0)), int(np.abs(c).max(initial=0))) < 1 << 22
        norms = (c * c).sum(1)
        twice = 2 * c
        todo = [(0, np.arange(len(c)))]
        while todo:
            node, left = todo.pop()
            low, high = self.lows[node], self.highs[node]
            if len(left) > 1:
                own = c[left]
                best = own[((twice[left] - (low + high)) ** 2).sum(1).argmin()]
                apart = own - best
                # The point of the box where a centroid does best against `best`: where it loses even there, it goes.
                left = left[(apart * (own + best - 2 * np.where(apart > 0, high, low))).sum(1) <= 0]
            a, b = int(self.starts[node]), int(self.stops[node])
            if len(left) == 1:
                yield node, a, b, left
            elif self.rights[node]:
                todo += [(node + 1, left), (int(self.rights[node]), left)]
            else:
                x = self.points[a:b].astype(np.int64)
                if small:  # all sums are below 2**53: doubles are exact
                    d = norms[left] - 2 * (x.astype(np.float64) @ c[left].T.astype(np.float64))
                else:
                    d = norms[left] - 2 * (x @ c[left].T)
                yield node, a, b, left[d.argmin(1)]

    def totals(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each centroid, the number and the sums of its vectors."""
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for node, a, b, what in self.assign(c):
            if len(what) == 1 and b - a > 1:
                n[what[0]] += b - a
                total[what[0]] += self.sums[node]
            else:
                n += np.bincount(what, minlength=len(c))
                np.add.at(total, what, self.points[a:b].astype(np.int64))
        return n, total

    def labels(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.points), np.int64)
        for _, a, b, what in self.assign(c):
            out[a:b] = what
        return out


def _row(ids: list, x: np.ndarray) -> dict:
    tree, order = Tree.build(x)
    wide = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
    put = lambda a, t: np.ascontiguousarray(a, t).tobytes()
    small = f"<i{wide}"
    return {"ids": [ids[i] for i in order], "wide": wide, "points": put(tree.points, small), "starts": put(tree.starts, "<i4"), "stops": put(tree.stops, "<i4"), "rights": put(tree.rights, "<i4"), "lows": put(tree.lows, small), "highs": put(tree.highs, small), "sums": put(tree.sums, "<i8")}


def _tree(r: dict, dimensions: int) -> Tree:
    get = lambda c, t: np.frombuffer(r[c], t).astype(np.int64)
    flat = lambda c, t: get(c, t).reshape(-1, dimensions)
    small = f"<i{r['wide']}"
    return Tree(flat("points", small), get("starts", "<i4"), get("stops", "<i4"), get("rights", "<i4"), flat("lows", small), flat("highs", small), flat("sums", "<i8"))


def planted(kept: DataFrame, dimensions: int = DIMENSIONS, tree: int = TREE) -> DataFrame:
    """A row for each kd-tree over vectors() of a task."""
    ship(kept.sparkSession)
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("wide", pa.int32()), *((c, pa.binary()) for c in ("points", "starts", "stops", "rights", "lows", "highs", "sums"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            for at in range(0, len(x), tree):
                ids += b.column(0)[at : at + tree].to_pylist()
                parts.append(x[at : at + tree])
                have += len(parts[-1])
                while have >= tree:
                    every = np.concatenate(parts)
                    yield pa.RecordBatch.from_pylist([_row(ids[:tree], every[:tree])], schema)
                    ids, parts, have = ids[tree:], [every[tree:]], have - tree
        if have:
            yield pa.RecordBatch.from_pylist([_row(ids, np.concatenate(parts))], schema)

    return kept.select("id", "v").mapInArrow(run, _FORM)


def summed(trees: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and the sums of each centroid's vectors over all trees."""
    dimensions = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                more, sums = _tree({name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}, dimensions).totals(c)
                n += more
                total += sums
        # Component -1 is the count.
        flat = np.concatenate([n[:, None], total], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(c)), dimensions + 1)), pa.array(np.tile(np.arange(-1, dimensions), len(c))), pa.array(flat.ravel())], names=["cluster", "component", "total"])

    told = trees.drop("ids").mapInArrow(run, "cluster long, component long, total long")
    n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    for r in told.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():
        if r["component"] < 0:
            n[r["cluster"]] = r["total"]
        else:
            total[r["cluster"], r["component"]] = r["total"]
    return n, total


def assigned(trees: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dimensions = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}
                tree = _tree(r, dimensions)
                labels = tree.labels(c)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(labels.astype(np.int32)), pa.array(((tree.points - c[labels]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, tree: int = TREE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector after `rounds` rounds of k centroids."""
    spark = table.sparkSession
    kept = vectors(table, id_col, vector_col, dimensions=dimensions)
    c = starts(kept, k)
    trees, path = stored(planted(kept, dimensions, tree), "trees")
    if not len(c):
        c = np.zeros((1, dimensions), np.int64)  # only vectors without an id, if any: all are of one cluster about zero
    for _ in range(rounds):
        n, total = summed(trees, c)
        c = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], c)
    found, _ = stored(assigned(trees, c), "assigned")
    removed(spark, path)
    shas = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    own: dict[int, int] = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row for each centroid.
    told = spark.createDataFrame([(i, own.get(i, 0), sum(own.values()), sha) for i, sha in shas], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

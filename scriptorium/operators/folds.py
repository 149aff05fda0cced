"""Folds over a document's tree, in its own row: visits of leaves and groups, values from the leaves up, the text that a tree writes.

Nodes are an array in document order, so reading it backward meets all children of a group before the group. Values that wait for their group are
kept one for each depth (children are folded in as they come), so a step touches as many as the tree is deep. An accumulator is copied at every
step, so what has been made is kept in parts of parts of SLICES nodes, and no step copies all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("brace", "option", "environment", "math")
#: How many nodes a slice has, and a slice of slices.
SLICES = (4096, 64)

Of = Callable[[Column], Column]


def is_group(n: Column) -> Column:
    """Whether a node holds others; the root is one as well."""
    return n["kind"].isin(*GROUPS, "root") | n["parent_id"].isNull()


def fold(parsed: DataFrame, *, type: str, empty: Column, leaf: Of, join: Callable[[Column, Column], Column], group: Callable[[Column, Column], Column], nodes: str = "nodes") -> Column:
    """Values of all nodes from the leaves up, as a Column array<struct<node_id, value>> in document order.

    leaf(n) is the value of a node that holds none; children's values are folded from the last to the first by join(value, rest), which begins with
    `empty`; group(n, inner) is a group's value, given what its children came to. `type` is the SQL type of values.
    """
    one = f"struct<node_id:int,value:{type}>"
    depth = F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0))
    once = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  # evaluates `value` one time
    state = lambda waiting: F.struct(waiting.alias("open"), F.array().cast(f"array<{one}>").alias("made"))

    def step(acc: Column, n: Column) -> Column:
        at = n["depth"]
        value = F.when(is_group(n), group(n, F.get(acc["open"], at + 1))).otherwise(leaf(n)).cast(type)

        def put(v: Column) -> Column:
            waiting = F.transform(acc["open"], lambda own, k: F.when(k == at, join(v, own)).when(k == at + 1, empty).otherwise(own).cast(type))
            return F.struct(waiting.alias("open"), F.concat(F.array(F.struct(n["node_id"].cast("int").alias("node_id"), v.alias("value"))), acc["made"]).alias("made"))

        return once(value, put)

    def over(part: Column, waiting: Column, sizes: tuple[int, ...]) -> Column:
        """What a part of the array, last node first, makes of the values that wait."""
        if not sizes:
            return F.aggregate(part, state(waiting), step)
        slices = F.when(F.size(part) > 0, F.sequence(F.lit(0), F.floor((F.size(part) - 1) / sizes[0]).cast("int"))).otherwise(F.array().cast("array<int>"))
        more = lambda acc, k: once(over(F.slice(part, k * sizes[0] + 1, F.lit(sizes[0])), acc["open"], sizes[1:]), lambda r: F.struct(r["open"].alias("open"), F.concat(r["made"], acc["made"]).alias("made")))
        return F.aggregate(slices, state(waiting), more)

    return over(F.reverse(nodes), F.array_repeat(empty.cast(type), depth + 2), SLICES)["made"]


def folded(parsed: DataFrame, **how) -> DataFrame:
    """(doc_id, node_id, value): fold() as rows."""
    return parsed.select("doc_id", F.inline(fold(parsed, **how)))


def map_contents(parsed: DataFrame, visit: Callable[[Column, Column, Column], Column], name: str = "found") -> DataFrame:
    """(doc_id, node_id, found): what visit(node, index, parent) says of every node that is no group, in order; a null says nothing.

    `index` is the node's place among its siblings, `parent` the group that holds it, as structs of the node table.
    """
    every = F.filter("nodes", lambda n: ~is_group(n))
    said = F.transform(every, lambda n: F.struct(n["node_id"].alias("node_id"), visit(n, n["sib"], F.try_element_at("nodes", n["parent_id"] + 1)).alias(name)))
    return parsed.select("doc_id", F.inline(F.filter(said, lambda x: x[name].isNotNull())))


def map_groups(parsed: DataFrame, visit: Of, name: str = "found") -> DataFrame:
    """(doc_id, node_id, found): what visit(node) says of every group and of verbatim, in order; a null says nothing."""
    every = F.filter("nodes", lambda n: n["kind"].isin(*GROUPS, "verbatim"))
    said = F.transform(every, lambda n: F.struct(n["node_id"].alias("node_id"), visit(n).alias(name)))
    return parsed.select("doc_id", F.inline(F.filter(said, lambda x: x[name].isNotNull())))


def content_hashes(parsed: DataFrame) -> DataFrame:
    """(doc_id, node_id, content_hash): equal hashes are equal trees, whatever their places."""
    own = lambda n: F.concat_ws("|", n["kind"], n["name"], n["content"], F.coalesce(n["delimiter"], F.lit("")))
    how = {"type": "string", "empty": F.lit(""), "leaf": lambda n: F.sha2(own(n), 256), "join": lambda value, rest: F.sha2(F.concat(value, rest), 256), "group": lambda n, inner: F.sha2(F.concat(own(n), F.lit("{"), inner), 256)}
    return folded(parsed, **how).withColumnRenamed("value", "content_hash")

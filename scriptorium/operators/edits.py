"""Edits: spans of new text applied together, refused where they overlap; quick fixes from diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.tables import sorted_side

from scriptorium.operators.intervals import last_before


EDITS = "array<struct<start:int,stop:int,seq:int,text:string>>"


def applied(text: Column, edits: Column, bad: Column) -> Column:
    """A text with its edits in order (start, stop, seq, text); `bad` is what there is where they overlap or are misplaced."""
    size = F.length(F.coalesce(text, F.lit("")))
    stops = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["stop"].cast("int")))
    wrong = F.exists(F.zip_with(edits, F.slice(stops, 1, F.size(edits)), lambda e, before: (e["start"] < before) | (e["stop"] < e["start"]) | (e["stop"] > size)), lambda x: x)
    parts = F.zip_with(edits, F.slice(stops, 1, F.size(edits)), lambda e, before: F.concat(F.substr(text, before + 1, e["start"].cast("int") - before), e["text"]))
    return F.when(wrong, bad).otherwise(F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(stops, -1) + 1)))


def rewrite(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text): documents with edits (doc_id, seq, start, stop, text) applied; the rest stays as it is, byte for byte.

    Edits are taken by start and stop, insertions at one place by seq. Overlapping edits, or some outside the text, raise. An
    edit of no document is an error, too. A document's edits meet in one row, as its text does.
    """
    listed = edits.groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "seq", F.coalesce("text", F.lit("")).alias("text")))).alias("edits"))
    joined = docs.join(sorted_side(listed), F.col("doc_id") == F.col("d"), "full")
    bad = F.raise_error(F.concat(F.lit("overlapping or misplaced edits in document "), F.col("doc_id").cast("string"))).cast("string")
    new = F.when(F.col("edits").isNull(), F.col("text")).when(F.col("doc_id").isNull(), F.raise_error(F.lit("an edit of no document"))).otherwise(applied(F.col("text"), F.col("edits"), bad))
    return joined.select(F.coalesce("doc_id", "d").alias("doc_id"), new.alias("text"))


def _edits(nodes: DataFrame, start: str, stop: str, text) -> DataFrame:
    """Edits of one part of nodes; a null text, or a part that a node doesn't have, edits nothing."""
    rows = nodes.select("doc_id", F.col("node_id").alias("seq"), F.col(start).alias("start"), F.col(stop).alias("stop"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    return rows.filter("text IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")


def of(nodes: DataFrame, text: Column | str) -> DataFrame:
    """Edits that replace whole nodes, delimiters included."""
    return _edits(nodes, "start", "stop", text)


def before(nodes: DataFrame, text: Column | str) -> DataFrame:
    return _edits(nodes, "start", "start", text)


def after(nodes: DataFrame, text: Column | str) -> DataFrame:
    return _edits(nodes, "stop", "stop", text)


def inside(nodes: DataFrame, text: Column | str) -> DataFrame:
    """Edits that replace what is in groups; nodes without an inside are left alone."""
    return _edits(nodes, "inner_start", "inner_stop", text)


def opening(nodes: DataFrame, text: Column | str) -> DataFrame:
    """Edits that replace opening delimiters: `\\begin{itemize}`, `{`, `$`."""
    return _edits(nodes, "start", "inner_start", text)


def closing(nodes: DataFrame, text: Column | str) -> DataFrame:
    return _edits(nodes, "inner_stop", "stop", text)


def _shifted(first: DataFrame) -> DataFrame:
    """Edits with `at` and `until`, where what they write stands in the edited text, and `delta`, by how much they lengthen it."""
    delta = F.length("text") - (F.col("stop") - F.col("start"))
    order = Window.partitionBy("doc_id").orderBy("start", "stop", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("delta", delta)
    return rows.withColumn("at", F.col("start") + F.coalesce(F.sum("delta").over(order), F.lit(0))).withColumn("until", F.col("at") + F.length("text"))


def carried(places: DataFrame, first: DataFrame) -> DataFrame:
    """places (doc_id, at, ...) of texts with `moved`, where each stands once the edits are made; a place within what is replaced stands at its end."""
    own = _shifted(first).select("doc_id", "start", "stop", "at", "until")
    met = last_before(places, own.withColumnRenamed("at", "__at"), at="at", marked="start", mark="e")
    e = F.col("e")
    return met.withColumn("moved", F.when(e.isNull(), F.col("at")).when(F.col("at") < e["stop"], e["until"]).otherwise(F.col("at") - e["stop"] + e["until"]).cast("int")).drop("e")


def composed(docs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Edits of docs that do at once what `first` does to them and then `second` to the result.

    Both are laid on the text between: what the first wrote and what the second replaces. Where these touch they are one edit, whose text is
    that stretch with the second's changes; how far each stands from its place in docs is a running sum of what the first wrote before.
    """
    between = rewrite(docs, first)
    one = _shifted(first).select("doc_id", "at", "until", "delta", F.lit(None).cast("struct<start:int,stop:int,seq:int,text:string>").alias("edit"))
    again = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("seq").cast("int").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    two = second.select("doc_id", F.col("start").alias("at"), F.col("stop").alias("until"), F.lit(0).alias("delta"), again.alias("edit"))
    order = Window.partitionBy("doc_id").orderBy("at", "until")
    new = F.coalesce(F.col("at") > F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = one.unionByName(two).withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("doc_id", "island").agg(F.min("at").alias("at"), F.max("until").alias("until"), F.sum("delta").alias("delta"), F.sort_array(F.collect_list("edit")).alias("edits"))
    earlier = F.coalesce(F.sum("delta").over(Window.partitionBy("doc_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = islands.withColumn("from", F.col("at") - earlier)
    stretch = F.substr("text", F.col("at") + 1, F.col("until") - F.col("at"))
    moved = F.transform("edits", lambda e: F.struct((e["start"] - F.col("at")).cast("int").alias("start"), (e["stop"] - F.col("at")).cast("int").alias("stop"), e["seq"].alias("seq"), e["text"].alias("text")))
    bad = F.raise_error(F.concat(F.lit("overlapping or misplaced edits in document "), F.col("doc_id").cast("string"))).cast("string")
    met = placed.join(sorted_side(between), "doc_id").withColumn("moved", moved)
    return met.select("doc_id", F.col("island").cast("int").alias("seq"), F.col("from").cast("int").alias("start"), (F.col("from") + F.col("until") - F.col("at") - F.col("delta")).cast("int").alias("stop"), applied(stretch, F.col("moved"), bad).alias("text"))


def corrected(nodes: DataFrame, fix) -> DataFrame:
    """Edits that replace nodes by what `fix`, a Column, gives; null leaves a node alone."""
    return nodes.withColumn("__text", fix).filter(F.col("__text").isNotNull()).select("doc_id", F.col("node_id").alias("seq"), "start", "stop", F.col("__text").alias("text"))


def quick_fixes(structure: DataFrame) -> DataFrame:
    """The edits that diagnostics propose."""
    return structure.filter("fix IS NOT NULL").select("doc_id", F.col("start").alias("seq"), F.col("fix_at").alias("start"), F.col("fix_at").alias("stop"), F.col("fix").alias("text"))


def code_actions(structure: DataFrame, start: int, stop: int) -> DataFrame:
    """Fixes of diagnostics that overlap a span."""
    return structure.filter((F.col("start") <= stop) & (F.col("stop") >= start) & F.col("fix").isNotNull())

"""Live buffers: the newest text of each is checked whole, at once where it was opened or saved, else when it rests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators import diagnostics
from scriptorium.operators.related import PLACE, lines_of_related
from scriptorium.session import ship
from scriptorium.sources.documents import lines as lines_of
from scriptorium.tables import sorted_side

DEBOUNCE = "300 milliseconds"


def newest(events: DataFrame) -> DataFrame:
    """(uri, version, kind, text): the last event of each buffer; those it supersedes are dropped."""
    return events.groupBy("uri").agg(F.max_by(F.struct("version", "kind", "text"), "version").alias("e")).select("uri", "e.*")


DUE = "uri string, version long, kind string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Resting(StatefulProcessor):
    """The newest event of a buffer, and whether it still waits for the buffer to rest."""

    def __init__(self, debounce_ms: int) -> None:
        self.debounce_ms = debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version long, kind string, text string, waits boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.newest.get() if self.newest.exists() else None
        last = max(rows, key=lambda r: r["version"])
        if now is not None and last["version"] <= now[0]:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waits = last["kind"] == "change"
        if last["kind"] == "close":
            self.newest.clear()
        else:
            self.newest.update((last["version"], last["kind"], last["text"], waits))
        if waits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.debounce_ms)
        else:
            yield Row(uri=key[0], version=last["version"], kind=last["kind"], text=last["text"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.newest.get() if self.newest.exists() else None
        if now is not None and now[3]:
            self.newest.update((now[0], now[1], now[2], False))
            yield Row(uri=key[0], version=now[0], kind=now[1], text=now[2])

    def close(self) -> None:
        pass


def _ticking(stream: DataFrame) -> DataFrame:
    """No rows, of the stream's columns, from a source that always has new offsets.

    After a restart from a finished batch Spark runs none, and so looks at no timer, before a source has something new.
    """
    clock = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.filter("value < 0").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema))


def due(stream: DataFrame, *, debounce_ms: int = 300) -> DataFrame:
    """(uri, version, kind, text) of buffers whose time has come: opened, saved and closed ones at once, changed ones when they rest.

    State holds the newest event of each buffer, so an older version that comes late, in whatever batch, is dropped; a timer of processing
    time is set by each change and tells when none came for the debounce time, also after a restart from the checkpoint. A closed buffer's state goes.
    An urgent event in a batch with a later change waits with it.
    """
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # arbitrary state with timers needs it
    return stream.unionByName(_ticking(stream)).groupBy("uri").transformWithState(statefulProcessor=Resting(debounce_ms), outputStructType=DUE, outputMode="Update", timeMode="ProcessingTime")


def projected(found: DataFrame, docs: DataFrame, encoding: str = "utf-16") -> DataFrame:
    """(doc_id, severity, code, message, line, character, end_line, end_character, fix, related): diagnostics as an editor takes them.

    Severities are 1 to 3, lines from 0, columns in the editor's own units; related places are a list of line, character and message.
    """
    rank = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    lines = lines_of(docs)
    joined = diagnostics.with_ends(found, docs).join(sorted_side(lines.select("doc_id", "line", F.col("text").alias("__line"))), ["doc_id", "line"], "left").join(sorted_side(lines.select("doc_id", F.col("line").alias("end_line"), F.col("text").alias("__end"))), ["doc_id", "end_line"], "left")
    fix = F.col("fix") if "fix" in found.columns else F.lit(None).cast("string")
    at = lambda text, col: units(F.coalesce(text, F.lit("")), col, encoding)
    related = F.array().cast("array<struct<line:int,character:int,message:string>>")
    if "related" in found.columns:
        joined = joined.join(sorted_side(lines_of_related(found, lines)), "doc_id", "left")
        related = F.transform("related", lambda r: F.struct((r["line"] - 1).alias("line"), at(F.try_element_at("__lines", r["line"]), r["col"]).alias("character"), r["message"].alias("message")))
    return joined.select("doc_id", rank.alias("severity"), "code", "message", (F.col("line") - 1).alias("line"), at(F.col("__line"), F.col("col")).alias("character"), (F.col("end_line") - 1).alias("end_line"), at(F.col("__end"), F.col("end_col")).alias("end_character"), fix.alias("fix"), related.alias("related"))


def checked(events: DataFrame) -> DataFrame:
    """(uri, diagnostics): of the newest text of each buffer; a closed one has none."""
    last = newest(events).withColumn("doc_id", F.xxhash64("uri"))
    found = diagnostics.check(last.filter("kind <> 'close'").select("doc_id", "text"))
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "code", "severity", "message", "line", "col", "related"))).alias("found"))
    empty = F.array().cast(f"array<struct<start:int,stop:int,code:string,severity:string,message:string,line:int,col:int,related:{PLACE}>>")
    return last.join(sorted_side(listed), "doc_id", "left").select("uri", "version", F.coalesce("found", empty).alias("diagnostics"))


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, debounce: str = DEBOUNCE) -> StreamingQuery:
    """Starts checking a stream of (uri, version, kind, text) events; `sink` gets each micro-batch's checked buffers. The trigger's interval debounces."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(checked(batch), n)).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()


def publish_settled(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, debounce_ms: int = 300, trigger: str = "100 milliseconds") -> StreamingQuery:
    """The same by due(): each buffer has a time of its own. Batches run on for the timers, also without new events.

    A batch that was told before a stop and runs again after it isn't told again: the last one told is marked in the checkpoint.
    """
    spark = stream.sparkSession
    marked = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "told")
    fs = marked.getFileSystem(spark._jsc.hadoopConfiguration())

    def told(batch: DataFrame, n: int) -> None:
        mark = spark._jvm.org.apache.hadoop.fs.Path(marked, str(n))
        batch.persist()
        try:
            if fs.exists(mark):
                batch.count()  # its state is still to be kept
            elif not batch.isEmpty():
                before = [x.getPath() for x in fs.listStatus(marked)] if fs.exists(marked) else []
                sink(checked(batch), n)
                fs.create(mark).close()
                for old in before:
                    fs.delete(old, False)
        finally:
            batch.unpersist()

    return due(stream, debounce_ms=debounce_ms).writeStream.outputMode("update").foreachBatch(told).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def units(text: Column, upto: Column, encoding: str) -> Column:
    """The column of a place in the client's units: utf-8, utf-16 or utf-32."""
    head = F.substr(text, F.lit(1), upto)
    return {"utf-8": F.octet_length(head), "utf-16": (F.octet_length(F.encode(head, "UTF-16LE")) / 2).cast("int"), "utf-32": F.length(head)}[encoding]

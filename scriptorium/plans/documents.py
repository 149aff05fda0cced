"""Documents made of the tables' columns, for queries over LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 50


def _tasks(spark: SparkSession) -> int:
    """Reading a document takes far more work than its bytes tell, so documents are dealt to all cores, however small the table is."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(_tasks(spark), "p_partkey") if name == "part" else rows


def _big(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("long").alias(alias or name)


def part_documents(spark: SparkSession, sf_dir: str, line: Column, head: str = "") -> DataFrame:
    """(doc_id, text): a line for each of PART consecutive parts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") / PART).cast("long").alias("doc_id"), F.struct("p_partkey", line.alias("t")).alias("x"))
    return rows.repartition(_tasks(spark), "doc_id").groupBy("doc_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n")).alias("text"))


def order_documents(spark: SparkSession, sf_dir: str, line: Column, before: str, after: str) -> DataFrame:
    """(doc_id, text): a line for each line item of an order."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", line.alias("t")).alias("x"))
    return rows.repartition(_tasks(spark), "doc_id").groupBy("doc_id").agg(F.concat(F.lit(before), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n"), F.lit(after)).alias("text"))


def _say(pattern: str, *columns: str) -> Column:
    """A line in which each @ stands for the next column, as text."""
    parts = pattern.split("@")
    out = [F.lit(parts[0])]
    for c, p in zip(columns, parts[1:], strict=True):
        out += [F.col(c).cast("string"), F.lit(p)]
    return F.concat(*out)

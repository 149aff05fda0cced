"""Joins of places and intervals of one document, without comparing all pairs: dyadic blocks for containment, running values for the last before.

An interval [start, stop) is the disjoint union of a few blocks [block * 2^level, (block + 1) * 2^level), at most two of a level. A place is in one
block of each level, so it lies in an interval exactly where one of its blocks is one of the interval's: an equi-join, whose rows
are the answer's rows. Nested sets are intervals of node numbers, segments are intervals of siblings, sections are intervals of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.tables import sorted_side



def blocks(start: Column, stop: Column) -> Column:
    """The blocks (level, block) that [start, stop) is made of; none where it is empty.

    What is left of the interval at a level is [a, b) in blocks of its size: odd ends are blocks of their own, the rest pairs up above.
    """
    one = F.lit(1).cast("long")
    lo, hi = start.cast("long"), stop.cast("long")

    def level(k: Column) -> Column:
        a, b = F.call_function("shiftright", lo + F.call_function("shiftleft", one, k) - 1, k), F.call_function("shiftright", hi, k)
        some = a < b
        return F.array(F.when(some & (F.pmod(a, F.lit(2)) == 1), F.struct(k.alias("level"), a.alias("block"))), F.when(some & (F.pmod(b, F.lit(2)) == 1), F.struct(k.alias("level"), (b - 1).alias("block"))))

    # No block is longer than the interval, so its length tells the levels.
    levels = F.when(lo < hi, F.sequence(F.lit(0), F.length(F.bin(hi - lo)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_compact(F.flatten(F.transform(levels, level)))


def containing(places: DataFrame, intervals: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), at: str = "at", start: str = "start", stop: str = "stop") -> DataFrame:
    """Each row of `places` with each row of `intervals` of the same keys whose [start, stop) holds its `at`; columns of the two must differ but for keys.

    Each pair is told once. Null keys meet nothing.
    """
    cut = intervals.select("*", F.explode(blocks(F.col(start), F.col(stop))).alias("__b")).select("*", F.col("__b.level").alias("__dyadic_level"), F.col("__b.block").alias("__dyadic_block")).drop("__b")
    # Only levels that a key's intervals have are asked for.
    used = cut.groupBy(*keys).agg(F.collect_set("__dyadic_level").alias("__dyadic_levels"))
    asked = places.join(sorted_side(used), list(keys)).select(*places.columns, F.explode("__dyadic_levels").alias("__dyadic_level")).withColumn("__dyadic_block", F.call_function("shiftright", F.col(at).cast("long"), F.col("__dyadic_level")))
    return asked.join(sorted_side(cut), [*keys, "__dyadic_level", "__dyadic_block"]).drop("__dyadic_level", "__dyadic_block")


def last_before(rows: DataFrame, marks: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), at: str, marked: str, mark: str, inclusive: bool = True) -> DataFrame:
    """rows with `mark`, the struct of the last row of `marks` whose `marked` is at or before (or, not inclusive, before) the row's `at`.

    One ordered pass over both for each key: nothing is joined, so rows need no number of their own, and either side is evaluated once.
    """
    one, two = F.struct(*rows.columns), F.struct(*marks.columns)
    none = F.lit(None)
    left = rows.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(1 if inclusive else 0).alias("__side"), one.alias("__row"), none.cast(marks.select(two.alias("m")).schema["m"].dataType).alias("__mark"))
    right = marks.select(*keys, F.col(marked).cast("long").alias("__at"), F.lit(0 if inclusive else 1).alias("__side"), none.cast(rows.select(one.alias("r")).schema["r"].dataType).alias("__row"), two.alias("__mark"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(mark, F.last("__mark", ignorenulls=True).over(upto)).filter("__row IS NOT NULL").select("__row.*", mark)

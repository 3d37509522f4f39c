"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of the total, at most `most` times what it
holds; what a source can't take is shared by weight among the others, until none is above. The ratio
of target and size says how many whole copies of its documents are certain. The rest is drawn by Pareto order
sampling: a document's random odds u / (1 - u) are divided by the odds of its inclusion, and the
documents of a source are taken in rising order of that quotient until the target is met. Samples have
a fixed size in words, so the last document may be taken in part, and a source's words differ from its
target by less than one. With a column of preferences (`weight`), inclusion is proportional to it.

Cases: a null text has size 0 and gives no words; documents of size 0 are returned with 0 taken; null is a
source of its own, the last; a null, negative or non-finite weight counts as 0; documents of weight 0 are drawn after all others;
rows that agree in number, source, text and weight may be exchanged for one another, so reruns give the same rows;
a source without words has target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORDS
from tickloom.session import cut_lineage

UNIT = float(1 << 53)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, into: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows before each, within `by` (not null), along `order`.

    Rows are dealt by ranges of (by, order), so a group of any size is spread over many tasks; each
    range sums its rows, and the sums of the ranges before are added.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    dealt = cut_lineage(dealt, "ranges")
    here = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    joined = dealt.join(sums, [*by, "__range"])
    return joined.withColumn(into, F.coalesce(F.sum(value).over(here), F.lit(0)) + F.col("__before")).drop("__range", "__sum", "__before")


def shared(rows: DataFrame, by: str, total: str, weight: str, cap: str, into: str) -> DataFrame:
    """`rows` with min(cap, level * weight), the level being such that each group of `by` sums up to its `total`.

    The level starts as if there were no caps; rows that reach theirs leave the sharing and the rest of
    the total is shared anew, until no further row is above. Every round is one aggregation. Where the caps of
    all rows with a weight sum up to less than the total, each of them takes its cap.
    """
    full, level = F.col("__level") * F.col(weight) >= F.col(cap), None
    while True:
        seen = rows.withColumn("__full", F.lit(False)) if level is None else rows.join(level, by).withColumn("__full", full)
        weights = F.sum(F.when(F.col("__full"), F.lit(0.0)).otherwise(F.col(weight)))
        left = F.first(total) - F.sum(F.when(F.col("__full"), F.col(cap)).otherwise(F.lit(0)))
        new = seen.groupBy(by).agg(F.when(weights > 0, left / weights).otherwise(F.lit(float("inf"))).alias("__level"), F.count_if("__full").alias("__n"))
        new = cut_lineage(new, "levels")
        if level is not None and new.join(level.select(by, F.col("__n").alias("__m")), by).where("__n <> __m").isEmpty():
            break
        level = new
    amount = F.when(F.col(weight) > 0, F.when(full, F.col(cap)).otherwise(F.col("__level") * F.col(weight))).otherwise(F.lit(0.0))
    return rows.join(level, by).withColumn(into, amount.cast("double")).drop("__level", "__n")


def source_targets(sized: DataFrame, cycle: Sequence[float], percent: int, most: int) -> DataFrame:
    """(key, source_size, target) of every source of rows (key, source, size)."""
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).withColumns({"all": F.lit(0), "one": F.lit(1)})
    placed = running(sources, ["all"], [F.col("source").asc_nulls_last()], "one", "place")
    weights = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    placed = cut_lineage(placed.withColumns({"weight": weights, "cap": most * F.col("source_size")}), "sources")
    total = placed.groupBy("all").agg((F.sum("source_size") * percent / 100).alias("total"))
    return shared(placed.join(total, "all"), "all", "total", "weight", "cap", "target").select("key", "source_size", "target")


def mixed(
    docs: DataFrame,
    cycle: Sequence[float] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: int = 0,
    weight: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, inclusion) of every document.

    Sources in the order of their names have the weights `cycle`, repeating, and share `percent` of all
    words. `taken` words of a document are in the mix: whole copies, and one in part at the end of a source.
    """
    source, text = F.col(f"`{source_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    wish = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    wish = F.when(F.isnan(wish) | (wish < 0) | (wish == float("inf")), 0.0).otherwise(F.coalesce(wish, F.lit(0.0)))
    sized = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("long"), text, wish).alias("draw"),
        wish.alias("wish"),
    )
    sized = cut_lineage(sized, "sizes")
    targets = source_targets(sized, cycle, percent, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("copies", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    rows = sized.join(cut_lineage(targets, "targets"), "key")
    if weight is None:
        rows = rows.withColumn("inclusion", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    else:
        rows = shared(cut_lineage(rows.withColumn("__wish", F.col("wish") * F.col("size")), "wishes"), "key", "rest", "__wish", "size", "__words")
        rows = rows.withColumn("inclusion", F.when(F.col("size") > 0, F.least(F.col("__words") / F.col("size"), F.lit(1.0))).otherwise(F.lit(0.0))).drop("__words", "__wish")
    u = (F.pmod("draw", F.lit(1 << 53)) + F.lit(0.5)) / F.lit(UNIT)
    p = F.col("inclusion")
    quotient = F.when(p > 0, u / (1 - u) * (1 - p) / F.when(p > 0, p)).otherwise(F.lit(float("inf")))
    order = [F.col(c) for c in ("quotient", "draw", "doc_id", "size")]
    placed = running(rows.withColumn("quotient", quotient), ["key"], order, "size", "before")
    part = F.least(F.greatest(F.round("rest").cast("long") - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + part).cast("long").alias("taken"), "source", "inclusion")

"""Mixing sources to target weights by nested hash thresholds.

Every source gets a target number of words: its weight's share of the total, at most ``cap`` times what it has, the
excess dealt to the others. A target of 1.3 times a source's size takes each document once and a further 0.3 of them by
hash: words are summed by source and leading bits of the hash, the bucket in which the budget ends is refined by the
next bits, and so on until it holds one hash; documents below that threshold are taken once more. No rows are sorted
and only sums leave the executors. A refined bucket holds 1 / 4096 of its source, whatever the source's size.

Edge cases. Null or empty text: size 0; the mix takes 0 words of it. Null source: a source of its own, the last.
Repeated rows have one hash, so they are taken together. Ties at the threshold: taken if that brings the source
nearer to its target. An empty table: an empty result. ``mix_documents`` keeps every other column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm._common import fresh, key60, n_words, own, settle, small_side

WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all words that the mix has; most times a document is taken.
TOTAL, CAP = 1.5, 2
#: The hash has LEVELS digits of DIGIT bits.
DIGIT, LEVELS = 12, 5


def key(doc_id: Column, text: Column) -> Column:
    """A 60-bit hash of a document's id and text."""
    return key60(F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit("|"), F.coalesce(text, F.lit("~"))))


def ordered(rows: DataFrame, order: list[Column], **summed: str) -> DataFrame:
    """rows, settled, with ``rank`` (from 0) in the order and, by name, the sums of columns over the rows before.

    Rows are dealt to ranges, ranks and sums counted inside each and carried over the ranges, of which there are no more
    than shuffle partitions; so no task sees all rows.
    """
    dealt = settle(settle(rows).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    names = {"rank": F.lit(1).cast("long"), **{name: F.col(c) for name, c in summed.items()}}
    whole = dealt.groupBy("range").agg(*[F.sum(c).alias(f"in_{name}") for name, c in names.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = whole.select("range", *[F.coalesce(F.sum(f"in_{name}").over(earlier), F.lit(0)).alias(f"to_{name}") for name in names])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"at_{name}") for name, c in names.items()])
    told = [(F.col(f"to_{name}") + F.col(f"at_{name}")).alias(name) for name in names]
    return settle(here.join(F.broadcast(starts), "range").select(*rows.columns, *told))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources reach their cap in the order of cap / weight, so the level at which the rest share is found from running
    sums: a source is capped if the level that would hold without it and all later ones is above its own cap.
    """
    by_source = F.col("source").asc_nulls_last()
    ranked = ordered(sizes, [by_source])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ready = ranked.withColumn("w", w).drop("rank").withColumn("top", cap * F.col("source_size").cast("double")).withColumn("turn", F.col("top") / F.col("w"))
    turned = ordered(ready, [F.col("turn").asc(), by_source], top_before="top", w_before="w")
    sums = turned.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    left = F.lit(total * (sums["size"] or 0)) - F.col("top_before")
    levelled = turned.withColumn("level", left / (F.lit(sums["w"]).cast("double") - F.col("w_before"))).withColumn("full", F.col("level") >= F.col("turn"))
    least = levelled.agg(F.min(F.when(~F.col("full"), F.struct("turn", "source", "level"))).alias("least")).first()["least"]
    share = F.lit(least["level"] if least else None).cast("double")
    return levelled.select("source", "source_size", F.when(F.col("full") | share.isNull(), F.col("top")).otherwise(F.least("top", share * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, bound): documents are taken ``whole`` times, those with a hash below ``bound`` once more.

    sized: (source, h, size), settled. Each level sums the words of the buckets that are still open and keeps, by
    source, the one in which the budget ends.
    """
    state = goals.select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int").alias("whole"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    state = settle(state.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    for level in range(LEVELS):
        shift, last = DIGIT * (LEVELS - 1 - level), level == LEVELS - 1
        s = small_side(state.select(F.col("source").alias("s"), "prefix"))
        open_rows = sized.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + DIGIT) == F.col("prefix")))
        sums = open_rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = sums.withColumn("cum", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        r = running.select(F.col("source").alias("s"), "bucket", "words", "cum")
        at = state.join(r, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("ends", F.col("below") + F.col("cum"))
        # inside the last bucket are documents of one hash: they go as the nearer side says
        stop = (2 * F.col("ends") - F.col("words") > 2 * F.col("budget")) if last else (F.col("ends") > F.col("budget"))
        first = F.min(F.when(stop, F.struct("bucket", (F.col("ends") - F.col("words")).alias("below"))))
        state = at.groupBy("source", "source_size", "target", "whole", "budget").agg(first.alias("first"), F.max("prefix").alias("prefix"), F.max("below").alias("old"))
        # a budget that no bucket exceeds: everything in the open prefix is taken
        state = settle(state.select("source", "source_size", "target", "whole", "budget", F.coalesce("first.bucket", ((F.col("prefix") + 1) * 2**DIGIT).cast("long") if last else ((F.col("prefix") + 1) * 2**DIGIT - 1).cast("long")).alias("prefix"), F.coalesce("first.below", "old").alias("below")))
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("bound"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **goal) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of every document, settled, and the thresholds of every source."""
    sized = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key(F.col(id_col), F.col(text)).alias("h")))
    return sized, small_side(thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **goal)))


def assign(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized, limits = plan(docs, **options)
    l = limits.withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("h") < F.col("bound")).cast("int")
    return sized.join(l, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **goal) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns. Texts are read twice and never shuffled."""
    _, limits = plan(docs, id_col, text, source, **goal)
    h, s, whole, bound = fresh(docs, "gl_h", "gl_s", "gl_whole", "gl_bound")
    l = limits.select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("bound").alias(bound))
    joined = docs.withColumn(h, key(F.col(id_col), F.col(text))).join(l, F.col(source).eqNullSafe(F.col(s)))
    copies = F.col(whole) + (F.col(h) < F.col(bound)).cast("int")
    (again,) = fresh(joined, "gl_again")
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(1), copies))).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))

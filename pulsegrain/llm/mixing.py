"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected copies are its source's target over the source's size
(times its own weight, if there is one); whole copies are certain, and the rest is an inclusion probability p. Documents
are ranked by the random odds u / (1 - u) over the inclusion odds p / (1 - p), and taken in that order until the words
that the certain copies leave of the target are used up. The cut is found from two levels of histograms of the rank key,
so that no task ever holds a source: only the documents of one bucket in 16 million are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed

WEIGHTS, MOST, SEED, BUCKETS = (5, 2, 1), 3, "mix-1", 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the document's id alone, or from its text where there is no id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target. Weights go round the sources by code point, null last. A source's target stops at
    `most` times its size; sources are filled in order of that limit over their weight, which reshares every excess."""
    # one row for each source: these windows see no documents
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "at")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns({"total": F.sum("source_size").over(whole).cast("double"), "all_w": F.sum("w").over(whole), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "ws": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    ranked = ranked.withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    # the first source that its limit does not stop sets the level of all that follow, whose own would be lower
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    ranked = ranked.withColumn("target", F.least("cap", level * F.col("w")))
    return ranked.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def _keyed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (mix_id, mix_u, mix_source, mix_size, mix_weight) with their source's plan, certain copies and rank key."""
    joined = rows.join(plan, F.col("mix_source").eqNullSafe(F.col("source_")), "left")
    expected = F.least(F.lit(float(MOST)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("mix_weight") / F.col("mean_weight")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("certain", F.floor(expected).cast("long")).withColumn("p", expected - F.col("certain"))
    u = F.col("mix_u")
    odds = u / (1 - u) * ((1 - F.col("p")) / F.col("p"))
    joined = joined.withColumn("key", F.when(F.col("p") > 0, odds / (1 + odds)))
    return joined.withColumn("b1", F.floor(F.col("key") * BUCKETS)).withColumn("b2", F.floor(F.col("key") * BUCKETS * BUCKETS) - F.col("b1") * BUCKETS)


def _cut(counts: DataFrame, bucket: str) -> DataFrame:
    """Per source the bucket in which the running words reach the budget, and what of the budget is left for it."""
    run = F.sum("words").over(Window.partitionBy("source_").orderBy(bucket))
    crossing = counts.withColumn("run", run).where("run >= budget").groupBy("source_")
    return crossing.agg(F.min(F.struct(bucket, (F.col("budget") - F.col("run") + F.col("words")).alias("budget"))).alias("c")).select("source_", F.col(f"c.{bucket}").alias(f"{bucket}_at"), F.col("c.budget").alias("budget"))


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: size, target, and the rank at which its sample ends."""
    rows = checkpointed(rows)
    sums = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.try_divide(F.sum(F.col("mix_size") * F.col("mix_weight")), F.sum("mix_size").cast("double")).alias("mean_weight"))
    sums = checkpointed(sums)
    goal = targets(sums.select("source", "source_size"), weights)
    plan = goal.join(sums.select(F.col("source").alias("s"), "mean_weight"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("source_"), "source_size", "target", F.coalesce(F.nullif("mean_weight", F.lit(0.0)), F.lit(1.0)).alias("mean_weight"))
    plan = checkpointed(plan)
    keyed = _keyed(rows, broadcast_if_small(plan, 64))
    level1 = keyed.groupBy("source_", "b1").agg(F.sum("mix_size").alias("words"), F.sum(F.col("mix_size") * F.col("certain")).alias("certain"), F.max("target").alias("target"))
    level1 = level1.withColumn("budget", F.col("target") - F.sum("certain").over(Window.partitionBy("source_"))).where("b1 IS NOT NULL")
    cut1 = checkpointed(_cut(level1, "b1"))
    near = keyed.join(broadcast_if_small(cut1.withColumnRenamed("source_", "s"), 64), F.col("source_").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("b1_at")))
    near = checkpointed(near.select("source_", "b2", "budget", "key", "mix_id", "mix_size"))
    level2 = near.groupBy("source_", "b2").agg(F.sum("mix_size").alias("words"), F.max("budget").alias("budget"))
    cut2 = checkpointed(_cut(level2, "b2"))
    last = near.drop("budget").join(broadcast_if_small(cut2.withColumnRenamed("source_", "s"), 64), F.col("source_").eqNullSafe(F.col("s")) & (F.col("b2") == F.col("b2_at")))
    run = F.sum("mix_size").over(Window.partitionBy("source_").orderBy("key", "mix_id").rowsBetween(Window.unboundedPreceding, 0))
    ends = last.withColumn("run", run).where(F.col("run") - F.col("mix_size") / 2 <= F.col("budget")).groupBy("source_").agg(F.max(F.struct("key", "mix_id")).alias("last"))
    ends = ends.select(F.col("source_").alias("s3"), "last")
    cuts = cut1.select(F.col("source_").alias("s1"), "b1_at").join(cut2.select(F.col("source_").alias("s2"), "b2_at"), F.col("s1").eqNullSafe(F.col("s2")), "left").join(ends, F.col("s1").eqNullSafe(F.col("s3")), "left")
    return checkpointed(plan.join(cuts, F.col("source_").eqNullSafe(F.col("s1")), "left").select("source_", "source_size", "target", "mean_weight", "b1_at", "b2_at", "last"))


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    keyed = _keyed(rows, broadcast_if_small(plan, 96))
    at_end = F.struct(F.col("key"), F.col("mix_id")) <= F.col("last")
    inside = F.when(F.col("b1_at").isNull(), True).when(F.col("b1") != F.col("b1_at"), F.col("b1") < F.col("b1_at")).when(F.col("b2") != F.col("b2_at"), F.col("b2") < F.col("b2_at")).otherwise(F.coalesce(at_end, F.lit(False)))
    return keyed.withColumn("copies", F.col("certain") + F.when(F.col("key").isNotNull() & inside, 1).otherwise(0))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str, weight: str | None) -> list[Column]:
    return [F.col(doc_id).alias("mix_id"), uniform(F.col(doc_id), F.col(text)).alias("mix_u"), F.col(source).alias("mix_source"), word_count(F.col(text)).alias("mix_size"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("mix_weight")]


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target, taken (words the mix takes), copies.

    Null and empty texts have size 0 and take none; a null source is a source, last in order; a row without
    an id is ranked by its text. Rows that repeat an id, or a text without one, share a rank, so all or none of them cross the
    cut. An empty table gives no rows.
    Reruns agree: the rank comes from the id. With `weight`, documents of a source differ in probability; no document is
    taken more than three times, and what that leaves over goes to the next in rank.
    """
    rows = checkpointed(docs.select(*_rows(docs, doc_id, text, source, weight)))
    out = _copies(rows, mixing_plan(rows))
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """The rows that the mix takes, with all their columns and how many copies (`copies`, replacing any column of that name). Cases as in mix_sizes."""
    plan = mixing_plan(docs.select(*_rows(docs, doc_id, text, source, weight)))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), *_rows(docs, doc_id, text, source, weight))
    out = _copies(whole, plan).where("copies > 0")
    return out.select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns if c != "copies"], "copies")

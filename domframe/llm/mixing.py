"""Mixing sources to target weights, in DataFrame operations only.

Tokens are counted per source, the source's target gives a repetition rate, and every document is taken
floor(rate) times plus once more if a number seeded by its id falls below a threshold.  The threshold is the
fraction of the rate, moved to the place in the order of these numbers where the words taken come closest to the
target: few long documents can hold much of a source, and with the bare fraction their luck would decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, digest_number

#: Up to so many sources their table of a few numbers each is broadcast (about 20 MB); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 200_000
#: Steps on which thresholds lie.
STEPS = 4096
#: Parts into which the documents of one source are dealt when the table of sources is not broadcast.
SALTS = 64


def source_targets(stats: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """Targets for (source, source_size): sources by code point, null last, have the weights in turn.

    The whole size is shared by weight; no target exceeds ceiling x its source's size, and what is above goes
    to the others by weight until none is above.  That fixed point is reached at once: with sources ordered by
    ceiling-to-weight ratio, those at their ceiling are a first part of the order.  The windows run over one
    row per source.  Sources of size 0 keep their turn in the order and have target 0.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(turn) - 1) % len(weights)
    weighed = stats.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), number + 1).cast("decimal(19,0)").alias("w"),
                           (F.col("source_size") * ceiling).cast("decimal(19,0)").alias("cap"))
    ratio = Window.orderBy((F.col("cap") / F.col("w")).cast("double"), F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(19,0)")
    at = weighed.select(
        "*", F.sum("source_size").over(everything).cast("decimal(19,0)").alias("all"), F.sum("w").over(everything).cast("decimal(19,0)").alias("all_w"),
        F.coalesce(F.sum("cap").over(before), zero).cast("decimal(19,0)").alias("cap_before"), F.coalesce(F.sum("w").over(before), zero).cast("decimal(19,0)").alias("w_before"))
    full = F.col("cap") * (F.col("all_w") - F.col("w_before")) < F.col("w") * (F.col("all") - F.col("cap_before"))
    full_sum = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(zero)).over(everything)
    level = (F.col("all") - full_sum("cap")).cast("double") / (F.col("all_w") - full_sum("w")).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w").cast("double") * F.col("level")))
    return (at.withColumn("full", full).withColumn("level", F.when(F.col("all_w") > full_sum("w"), level).otherwise(0.0))
            .select("source", "source_size", target.alias("target")))


def _taken(docs: DataFrame, keep: Sequence[str], weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: str = "mix") -> DataFrame:
    """_row, the columns keep of every document, and size, source_size, target, rate and copies.

    A null text has size 0; a null source is a source of its own.  A null doc_id draws by its text alone;
    repeated rows draw alike, and each is a row of the result.  No document is taken more than ceiling times.
    The sources' table is broadcast after its rows have been counted, or else joined on (source, salt).
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    sized = docs.select(F.struct(*keep).alias("_row"), F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        digest_number(F.lit(f"{seed}:"), part("doc_id"), F.when(F.col("doc_id").isNull(), F.md5(part("text"))).otherwise("")).alias("_draw"))
    # A row for each step that has documents: at most STEPS for a source, and one for a document.
    steps = cut(sized.groupBy(F.col("_source").alias("source"), F.floor(F.col("_draw") * STEPS).cast("int").alias("step")).agg(F.sum("size").alias("words")))
    stats = cut(thresholds(steps, weights, ceiling).withColumnRenamed("source", "_name"))
    same = F.col("_source").eqNullSafe(F.col("_name"))
    if stats.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(stats), same)
    else:
        dealt = sized.withColumn("_salt", F.pmod(F.hash("_draw"), F.lit(SALTS)))
        spread = stats.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(spread, same & (F.col("_salt") == F.col("_part")))
    return joined.select("_row", "size", "source_size", "target", "rate", (F.floor("rate") + (F.col("_draw") < F.col("threshold")).cast("long")).alias("copies"))


def thresholds(steps: DataFrame, weights: Sequence[int], ceiling: int) -> DataFrame:
    """source, source_size, target, rate and threshold from the words on each step of a source's draws (source, step, words).

    Of the places between steps, the beginning included, the first is taken at which the words of the draws below it
    come closest to what the target asks for beyond floor(rate) times the source.
    """
    targets = source_targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.withColumn("rate", rate).withColumn("extra", F.col("target") - F.floor("rate") * F.col("source_size")).withColumnRenamed("source", "_s")
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    places = steps.select("source", (F.col("step") + 1).alias("place"), F.sum("words").over(upto).alias("below"))
    begin = steps.select("source").distinct().select("source", F.lit(0).alias("place"), F.lit(0).cast("long").alias("below"))
    off = F.abs(F.col("below") - F.col("extra"))
    asked = places.unionByName(begin).join(rated, F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("best"), *(F.first(c).alias(c) for c in ("source_size", "target", "rate")))
    return asked.select("source", "source_size", "target", "rate", (F.col("best.place") / F.lit(float(STEPS))).alias("threshold"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id of every document, and size, source_size, target, rate and copies.  Options: weights, ceiling, seed."""
    return _taken(docs, ("doc_id",), **options).select("_row.*", "size", "source_size", "target", "rate", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns docs has, whatever their names."""
    taken = _taken(docs, docs.columns, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")

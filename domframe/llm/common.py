"""Helpers that several operators of this folder share: tables, cut lineage, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process (tests), a folder is made here.
    """
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="domframe-"))
    return jsc.getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored where every executor can read it; a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def digest_number(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id on an edge: comp is the smallest id it is connected with.

    Rounds of large-star and small-star: every round hangs each node's larger neighbours, and then the node
    itself with its smaller neighbours, on the smallest of them.  The edges end as stars around the smallest
    ids.  The number of rounds is about logarithmic in the longest path.  A node that very many edges share is
    the smaller end of them, so the large star's join has stored tables on both sides: adaptive execution can
    then split that node's rows, or send the other side to all tasks if it is small.  Edges that are stars already
    need no round: no node has two smaller neighbours, or smaller and larger ones.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        for end in ("v", "u"):
            if end == "v":  # large star: the least that v sees, itself included
                both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
                    now.select(F.col("u").alias("x"), F.col("v").alias("y")))
                least = cut(both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("m")))
                step = now.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v"))
            else:  # small star: the least of u's smaller neighbours
                least = now.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
                near = now.join(least, F.col("u") == F.col("x"))
                step = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                    least.select(F.col("x").alias("u"), F.col("m").alias("v")))
            now = step.where("u != v").distinct()
            if end == "u":
                now = cut(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())

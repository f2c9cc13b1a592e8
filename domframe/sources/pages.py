"""Where pages come from and nodes go to: tables, text files, raw bytes, and stored node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import decode


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """A Parquet table of pages; the reader reads the columns that are used and pushes filters down."""
    return spark.read.options(**options).parquet(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """url and html of UTF-8 files, one page each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_html_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """url, encoding-sniffed html and bytes of files in any encoding, one page each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode(files.select(F.col("path").alias("url"), F.col("content").alias("data")), "data")


def write_nodes(nodes: DataFrame, path: str, partitions: int | None = None, mode: str = "error") -> None:
    """Nodes as Parquet, a document's rows together and in page order, so that readers skip by tag and kind."""
    dealt = nodes.repartition(partitions, "doc_id") if partitions else nodes.repartition("doc_id")
    dealt.sortWithinPartitions("doc_id", "node_id").write.mode(mode).parquet(path)


def save_nodes(nodes: DataFrame, name: str, buckets: int, mode: str = "error") -> None:
    """Nodes as a table bucketed by document: joins of its nodes with each other then need no shuffle."""
    nodes.write.mode(mode).bucketBy(buckets, "doc_id").sortBy("doc_id", "node_id").saveAsTable(name)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

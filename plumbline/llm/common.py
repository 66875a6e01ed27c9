"""Helpers that several operators share: durable intermediate results and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def body(column: str | Column = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Only in local mode, where one machine is all there is, a temporary folder takes its place if the session names none;
    elsewhere that is an error, as every machine would write to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep the rows in the shared folder and forget how they were made.

    The rows survive the loss of any executor; Spark deletes them when the result is no longer referenced.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, as a Parquet table: for results of many narrow rows, which Parquet packs well.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of an undirected graph with the smallest node of its component.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; loops and repeated edges are
    harmless, rows with a null end are ignored. Returns ``node, component``; an empty graph gives no rows.

    Large-star and small-star steps alternate until every edge leads to the root of a star, which takes a number of
    rounds that grows with the logarithm of the longest path; one aggregate tells, so no round is spent on finding
    that nothing changes. A node's neighbours are never gathered in one place: a
    step needs only the least neighbour, which is a partial aggregate, and joins it back; Spark's adaptive
    execution splits the partition of a hub in that join. Every round is cut in the shared folder.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def star(links: DataFrame) -> DataFrame:
        """Connect what each node ``u`` is linked to (``v``) with the least of them and itself."""
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return links.join(cut(least), "u")

    def unfinished(links: DataFrame) -> DataFrame:
        """The nodes that have several parents, or a parent and children."""
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(False).alias("is_parent")).unionByName(
            links.select(F.col("b").alias("node"), F.lit(0).alias("parents"), F.lit(True).alias("is_parent"))
        )
        sums = ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("is_parent").alias("is_parent"))
        return sums.where("parents > 1 OR parents = 1 AND is_parent")

    while unfinished(current).count():
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        current = cut(small.where("a <> b").distinct())
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )

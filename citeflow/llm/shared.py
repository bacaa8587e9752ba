"""What several corpus operators need: written tables, repeated rows, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.sources.scratch import forget, written

__all__ = ["checked", "components", "forget", "key_of", "repeated", "small_batches", "whole", "written"]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from 64 MB to 4 MB, unless they were
    set: rows are whole texts here, and a task holds several copies of its
    batch, in the JVM and in Python.  Batches from Python stay as they come:
    maxBytesPerOutputBatch cuts those only after the JVM has read them, and
    Spark 4.1.2 closes the vectors it still reads into when a batch over that
    limit follows one below it in a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, f"{64 << 20}b") == f"{64 << 20}b":
        spark.conf.set(key, "4m")


def checked(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of narrow rows, to be broadcast where it has at most so many;
    larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one column ``row`` beside columns of our own, so that no
    name of theirs can clash; ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def key_of() -> Column:
    """A document: its doc_id and its text."""
    return F.xxhash64("doc_id", "text")


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as ``times`` says, without that column; in runs, so
    that no array grows with the copies."""
    out = df.withColumn(times, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(1 << 16).cast("long")), lambda x: F.least(F.lit(1 << 16), F.col(times) - x).cast("int"))))
    return out.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).drop(times)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node reachable.

    Alternating large-star and small-star until nothing changes any more: every
    round links nodes to the smallest neighbour, and the rounds grow with the
    logarithm of the longest path.  A hub's neighbours are never gathered:
    each round is joins and minimum aggregations only."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        stars = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        new = written(stars.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        forget(edges)
        edges = new
        # done when every node hangs on one root that hangs on nothing
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    out = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")))
    forget(edges)
    return out

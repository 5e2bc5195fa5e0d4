"""Spark helpers that the operators share: cutting lineage, connected components, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if a count of its rows, done first, stays within this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, keep, added: str) -> T.StructType:
    """The fields of kept columns, whatever their types, and of a DDL string."""
    return T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(added).fields])


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs as the needed columns and one struct of all others, and what lays such a frame out as docs again.

    The latter takes the frame and the names of columns to add behind those of docs.

    Between the two, columns of any name can be added without meeting one of the caller's.
    """
    others = [c for c in docs.columns if c not in needed]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest_")] if others else []
    narrow = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c in needed), *rest)
    return narrow, lambda df, *more: df.select(*(F.col("rest_").getField(c).alias(c) if c in others else F.col(f"`{c}`") for c in docs.columns), *more)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``; only a local session without one, as in tests, gets a
    temporary folder, as the executors of a cluster would not share it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if its counted rows are within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) of every end of an undirected edge; component: the smallest id that it can reach.

    Alternates large-star and small-star steps, each of which hangs neighbours under a smaller node, until
    the edges are stars. Minimum labels are pre-aggregated before the shuffle, so a node with very many
    neighbours costs no more than its edges. Self-loops and nulls are ignored. Eager: it runs one job a step.
    """
    now = settle(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where((F.col("u") != F.col("v")) & F.col(left).isNotNull() & F.col(right).isNotNull())
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        before, now = now, settle(step.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        drop_checkpoint(before)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    tree = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return tree.unionByName(tree.select(F.col("component").alias("id"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

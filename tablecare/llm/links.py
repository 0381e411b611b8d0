"""Connected components of a table of links, in Spark jobs whose rows never exceed the links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.scratch import new_path

#: Bits of a sized filter: for each id, at least and at most.
ID_BITS, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 29


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    # files that shuffles left go once the driver's JVM sees that nothing refers to them; it looks when asked
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) of each node of ``links`` (a, b): ``root`` is the smallest node reachable.

    Two steps alternate until nothing changes: every node hands its smallest neighbour to its larger neighbours, then to
    its smaller ones. A node's smallest neighbour is found by a combined minimum, so a node with very many links costs
    each task one row; the join back splits such a node.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = both.join(least, "a")
        if larger:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        hung = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        return hung.unionByName(least.select("a", F.col("low").alias("b")).filter("a != b")).distinct()

    def state(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = state(edges)
    while seen[0]:
        last, edges = edges, stored(star(star(edges, True), False), "links")
        discard(last)
        now = state(edges)
        if now == seen:
            break
        seen = now
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def bit_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits, whatever the number of ids (one long column): an id's bit is set.

    Tasks use it to leave out rows that no one asks for before anything is shuffled. The more ids, the more rows pass
    needlessly; none is lost.
    """
    slots = ids.select(F.pmod(F.col(ids.columns[0]), F.lit(bits)).alias("slot"))
    rows = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    found = np.zeros(-(-bits // 64), "<i8")
    for batch in rows.to_batches():
        found[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return found.view("<u4")[: bits // 32]


def sized_filter(ids: DataFrame) -> np.ndarray:
    """A filter with as many bits as the ids (a table, which is read twice) ask for: of others about one in ID_BITS passes.

    From MOST_BITS / ID_BITS ids on, 45 million, more do.
    """
    many = ids.agg(F.approx_count_distinct(ids.columns[0])).first()[0]
    return bit_filter(ids, min(max(ID_BITS * many // 64 * 64, LEAST_BITS), MOST_BITS))


def passes(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids (64-bit integers) may be in the filter."""
    slot = np.mod(ids, len(found) * 32)
    return (found[slot // 32] >> (slot % 32).astype(np.uint32)) & 1 > 0

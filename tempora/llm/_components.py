"""Connected components of an edge table, by star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._shared import drop_path, new_path, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b) -> node, label: the smallest node of its component, for every node of an edge; a staged table.

    Large-star and small-star steps alternate until nothing changes, a logarithmic number of rounds in practice.  A step is one
    grouped minimum (pre-aggregated) and one join back, where AQE splits the rows of a hot centre; each round is
    written to the shared folder, so nothing is recomputed and a lost executor costs its tasks only.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def save(df: DataFrame) -> DataFrame:
        kept.append(new_path(spark, "stars"))
        df.write.parquet(kept[-1])
        while len(kept) > 2:
            drop_path(spark, kept.pop(0))
        return spark.read.schema("u bigint, v bigint").parquet(kept[-1])

    def large(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return out.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = save(edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct())
    was = state(e)
    while was[0]:
        e = save(small(large(e)))
        now = state(e)
        if now == was:
            break
        was = now
    for path in kept[:-1]:
        drop_path(spark, path)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    out = stage(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots), "components")
    drop_path(spark, kept[-1])
    return out

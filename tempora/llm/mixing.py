"""Mixing sources to target weights: each document floor(rate) times plus one hash-seeded Bernoulli copy.

Sizes are words ([^\\x20\\x09-\\x0D]+; null text: 0).  Sources in code point order (null last) take the cyclic
weights; together they share `share` of all sizes.  A target stops at `most` times its source's size and the excess
goes to the others by weight, until none is above: a few rounds, each one aggregate over the sources, which may be as many as hosts
(their place in the order is found without a sort in one task).  The copy count of a document is floor(rate) or that plus one, so it
never exceeds ceil(most).

Defined cases: a null text or one without words has size 0 and is never repeated beyond floor(rate); a source of
size 0 has target and rate 0; a null doc_id is hashed as the word "null"; equal rows get equal decisions; an empty
table gives no rows.  Other columns, whatever their names, are untouched in mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._shared import plain, stage
from tempora.operators.order import PLACE, in_order

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Source tables up to this many rows are broadcast; larger ones join by shuffle, where AQE splits hot sources.
BROADCAST_ROWS = 50_000
_WORD = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: str) -> Column:
    """52 hash bits of the key as a number in [0, 1)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sizes(source, size) -> one row per source: source, source_size, target, rate."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per, _ = in_order(per, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col(PLACE), F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    budget, full, was = float(share) * total, F.lit(False), -1
    while True:  # the sources above their caps only grow in number
        n, rest, free = per.agg(F.count_if(full), F.lit(budget) - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == was or not free:
            break
        was = n
        full = full | (F.col("cap") * F.lit(free) <= F.col("w") * F.lit(rest))
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(rest / free if free else 0.0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def rated(docs: DataFrame, keep: list[str], id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """keep columns of every document with its size, source_size, target, rate and copies, each prefixed with an underscore."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")
    sized = docs.select(*[F.col(c) for c in keep], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"))
    if text_col not in keep:  # small rows: count the words once
        sized = stage(sized, "mix-sizes")
        sums = sized
    else:
        sums = docs.select(F.col(source_col).alias("_source"), size.alias("_size"))
    t = stage(targets(sums.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, most), "mix-targets")
    t = t.select(F.col("source").alias("_t"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    if t.count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    out = sized.join(t, F.col("_source").eqNullSafe(F.col("_t")), "left")
    whole = F.floor("_rate")
    copies = whole + (uniform(F.col("_id"), seed) < F.col("_rate") - whole).cast("bigint")
    return out.withColumn("_copies", copies).drop("_t")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """Every document as often as the mix takes it; the columns of docs."""
    names, inner = docs.columns, plain(docs)
    at = {k: f"c{names.index(c)}" for k, c in (("id_col", id_col), ("text_col", text_col), ("source_col", source_col))}
    out = rated(inner, inner.columns, **at, **options)
    return out.where("_copies > 0").select(*inner.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).select(*inner.columns).toDF(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rated(docs, ["doc_id"])
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
  (sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE AS cap_before,
  (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM w),
f AS (SELECT *, (cap * w_left)::DOUBLE <= w * (budget - cap_before) AS filled FROM o),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE w * ((budget - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE)
  / (sum(CASE WHEN filled THEN 0 ELSE w END) OVER ())::DOUBLE) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, (floor(rate) + CASE WHEN
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

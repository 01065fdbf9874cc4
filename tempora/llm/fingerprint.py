"""Document fingerprints by consistent weighted sampling, in Spark SQL functions only.

Terms are lower-cased words ([^\\x20\\x09-\\x0D]+), weighted by how often they occur.  For sample j and term k with weight w, the hash
of (k, j) gives r, c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1).  The term with the least
a is the sample, known by (k, t).  Two texts agree in a sample with probability sum(min(w, v)) / sum(max(w, v)), the
generalised Jaccard similarity of their weights, so the share of agreeing samples estimates it.

Each sample is one min() over one long: 31 bits of ln a above 32 bits of hash(k, t), so all samples are one generated
aggregation without objects, which a term enters once for each of PARTS parts of the samples, so that the plan stays small.  The
fingerprint is the 32-bit halves in hexadecimal; equal texts have equal ones.

The quantiles are ratios of polynomials, since logarithms would triple the time: r is right to 0.4 % and cut at 1 - 2e-5, ln c right to 0.003 and
cut at its 99th percentile, where no least value of many comes from; a term alone in its text is its own sample whatever its draws.  The
bias of the collision rate this leaves is within 0.003 over texts of one to 80 terms and weights up to 10,000 (tests/llm/test_fingerprint.py).

Neighbours in doc_id order come from one shuffle of the texts into id ranges (splitters from a quantile sketch of all ids; rows of a doc_id
that fills several ranges, or of none, are dealt over ranges by a hash of the text),
where a window looks one row ahead; ranges join through their first rows.  Everything after stays in those partitions.

Defined cases: null text is empty; a text without words has an empty fingerprint, alike (1.0) to another empty one and unlike (0.0)
to any other; equal doc_ids are ordered by a hash of the text, then by text; a null doc_id comes last in descending order; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm._shared import beside, plain, stage

SAMPLES = 64
PARTS = 4
TAIL, LOG_TAIL = 2e-5, 0.99
_ABOVE = (1.4193525879832358, -4.644080789462541, 5.457540206186922, -2.6601854055487824, 0.42737340358405224)
_LOG_ABOVE = (-15.957462558711034, 4.9223056886492875, 83.36982781097711, -116.13143338904175, 43.804179523045185)
_LOG_BELOW = (1.0, 8.141875437472638, -15.096029581037834, 2.859095207734732, 3.09861602292157)
_BELOW = (1.0, -3.705653309301836, 5.123120734658776, -3.129275428704367, 0.7118080035368667)


def words_of(text: Column) -> Column:
    """The words, with empty strings at the ends where the text begins or ends with white space."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _gamma(bits: Column, n: int) -> Column:
    """Gamma(2, 1) from n hash bits: its quantile at p = (bits + 0.5) / 2**n, as s times a ratio of polynomials in s = sqrt(p).

    The ratio was fitted to p up to 1 - TAIL (where p is cut) and is right to 0.4 %.  A logarithm would be three times as slow here.
    """
    s = F.sqrt((bits.cast("double") + F.lit(0.5)) * F.lit((1 - TAIL) / 2**n))
    return s * _poly(_ABOVE, s) / _poly(_BELOW, s)


def _log_gamma(bits: Column, n: int) -> Column:
    """The logarithm of such a quantile, right to 0.003 for p up to LOG_TAIL (where p is cut: a sample is the least of many, so the far
    upper tail does not decide), as a ratio of polynomials in the eighth root of p."""
    u = F.sqrt(F.sqrt(F.sqrt((bits.cast("double") + F.lit(0.5)) * F.lit(LOG_TAIL / 2**n))))
    return _poly(_LOG_ABOVE, u) / _poly(_LOG_BELOW, u)


def _poly(c: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda y, k: F.lit(k) + x * y, reversed(c[:-1]), F.lit(c[-1]))


def draws(spark: SparkSession, samples: int, parts: int) -> DataFrame:
    """_part, _j0, _j1, ..., _r: for each part of the samples a row with their numbers and with r for each of the 2**16 numbers that 16 bits make.

    The driver analyses, plans, compiles and describes every node of the samples anew with each stage that ends, and Catalyst writes a value out
    wherever it is used: the plan of 64 samples with r as a formula took 1.3 million characters.  So r is looked up, and a part's formulas serve all.
    """
    part, size = F.col("id").cast("int"), samples // parts
    up = F.sequence(part, part + F.lit(2**16 - 1))  # not of literals alone, else the plan would hold the table
    numbers = [(part * size + k).alias(f"_j{k}") for k in range(size)]
    return spark.range(0, parts, numPartitions=1).select(part.alias("_part"), *numbers, F.transform(up, lambda x: _gamma(x - part, 16)).alias("_r"))


def sample(term: Column, log_weight: Column, j: Column) -> Column:
    """The packed value of a term in sample j: one hash gives 16 bits for r, by its place in the column _r of draws(), 24 for c and 24 for b."""
    h = F.xxhash64(term, j)
    r = F.get("_r", h.bitwiseAND(F.lit(2**16 - 1)))
    ln_c = _log_gamma(F.shiftright(h, 16).bitwiseAND(F.lit(2**24 - 1)), 24)
    b = F.shiftrightunsigned(h, 40).cast("double") / F.lit(float(2**24))
    t = F.floor(log_weight / r + b)
    a = ln_c - r * (t - b + F.lit(1.0))  # between -64 and 4 for any weight below e**40
    level = ((a + F.lit(96.0)) * F.lit(float(2**23))).cast("bigint")
    return F.shiftleft(level, 32).bitwiseOR(h.bitwiseXOR(F.shiftleft(t, 7)).bitwiseAND(F.lit(2**32 - 1)))


def weighted_terms(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """keys..., term, lw: the distinct words of each row hashed, and the logarithm of their counts; one row of nulls if there are none.

    Words are hashed and sorted inside their row and counted by the distance of the places where the value changes.
    """
    empty = F.xxhash64(F.lit(""))
    sorted_ = rows.select(*keys, F.sort_array(F.transform(F.col(words), lambda w: F.xxhash64(w))).alias("_h"))
    at = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1)))
    found = sorted_.withColumn("_at", F.when(F.size("_h") > 0, at))
    pair = lambda i, k: F.struct(F.get("_h", i).alias("_term"), (F.coalesce(F.get("_at", k + 1), F.size("_h")) - i).alias("_many"))
    terms = F.filter(F.transform("_at", pair), lambda t: t["_term"] != empty)
    return found.select(*keys, F.inline_outer(terms)).select(*keys, F.col("_term").alias("term"), F.log(F.col("_many").cast("double")).alias("lw"))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys..., term, lw -> keys..., sig array<bigint> (the 32-bit sample ids; empty without terms)."""
    parts = math.gcd(samples, PARTS)
    size = samples // parts
    drawn = terms.crossJoin(F.broadcast(draws(terms.sparkSession, samples, parts)))
    mins = drawn.groupBy(*keys, "_part").agg(*[F.min(sample(F.col("term"), F.col("lw"), F.col(f"_j{k}"))).alias(f"s{k}") for k in range(size)])
    ids = F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(2**32 - 1)) for k in range(size)])
    some = mins.select(*keys, "_part", F.when(F.col("s0").isNull(), F.array().cast("array<bigint>")).otherwise(ids).alias("ids"))
    sig = F.concat(*[F.first(F.when(F.col("_part") == p, F.col("ids")), ignorenulls=True) for p in range(parts)])
    return some.groupBy(*keys).agg(sig.alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; empty and empty 1.0, empty and other 0.0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).otherwise(same.cast("double") / F.greatest(F.size(a), F.size(b)))


def to_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _at_most(cuts: list[int], x: Column, below: bool = False) -> Column:
    """How many of the sorted cuts are at most x (or below x): two short searches, one over the heads of groups and one in a group."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    fits = (lambda c: c < x) if below else (lambda c: c <= x)
    group = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), fits))
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), F.greatest(group, F.lit(1))), fits))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * size + inside)


def ranges(docs: DataFrame, col: str, tie: str, buckets: int) -> Column:
    """Number of the range of (col, tie), in their order; nulls have negative numbers."""
    cuts, rows, nulls = docs.agg(F.percentile_approx(col, [i / buckets for i in range(1, max(2, buckets))], 20 * buckets), F.count("*"), F.count_if(F.col(col).isNull())).first()
    cuts = sorted(cuts or []) if buckets > 1 else []
    share = F.shiftrightunsigned(tie, 11).cast("double") / F.lit(float(2**53))  # of the tie in the order of its bits
    low, high = _at_most(cuts, F.col(col), True), _at_most(cuts, F.col(col))
    more = F.greatest(high - low - 1, F.lit(0))  # a value that fills ranges of its own
    at = high - more + F.floor(share * (more + 1)).cast("int")
    spread = max(1, round(buckets * nulls / max(1, rows)))
    return F.when(F.col(col).isNull(), F.floor(share * spread).cast("int") - spread).otherwise(at)


def following(tops: DataFrame) -> DataFrame:
    """bucket, next: the range that comes after each in descending order, after the last the first.  One row per range."""
    down = Window.orderBy(F.col("bucket").desc())
    return tops.select("bucket", F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(down.rowsBetween(Window.unboundedPreceding, 0))).alias("next"))


def with_next(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """bucket, doc_id, pos, text, next_text: the next document in descending doc_id order, after the last the first."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the tie in the order of its bits as an unsigned number
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    base = base.withColumn("bucket", ranges(base, "doc_id", "tie", 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = base.withColumn("tie", F.col("tie").bitwiseXOR(F.lit(-(2**63))))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text")]
    # one row per range (a multiple of the shuffle partitions): its first key, and the range that follows
    tops = base.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
    heads = base.join(F.broadcast(tops), "bucket").where(F.struct("doc_id", "tie").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("text"))
    heads = stage(heads, "heads")
    links = following(heads).join(heads.select(F.col("bucket").alias("next"), F.col("text").alias("after")), "next")
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = base.select("bucket", "doc_id", "text", F.lead("text").over(w).alias("ahead"), F.row_number().over(w).alias("pos"))
    return rows.join(links, "bucket").select("bucket", "doc_id", "pos", "text", F.coalesce("ahead", "after").alias("next_text"))


def fingerprints(docs: DataFrame, text_col="text", samples: int = SAMPLES) -> DataFrame:
    """docs with a column `fingerprint` (one of that name is kept as fingerprint_input); rows are kept apart by a number of their own."""
    names, inner = docs.columns, plain(docs)
    rows = stage(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    words = rows.select("_row", words_of(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))).alias("w"))
    sig = signatures(weighted_terms(words, ["_row"], "w"), ["_row"], samples).select("_row", to_string(F.col("sig")).alias("fingerprint"))
    return rows.join(sig, "_row").drop("_row").toDF(*beside(names, ["fingerprint"]), "fingerprint")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_next(docs)
    half = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("next_text"), F.lit(1), F.length("text") - half))
    rows = rows.select("bucket", "doc_id", "pos", "text", edited.alias("edited"))
    rows = rows.select("bucket", "doc_id", "pos", F.length("text").cast("bigint").alias("n"), F.sha2("edited", 256).alias("sha"), "text", "edited")
    keys = ["bucket", "pos", "doc_id", "n", "sha"]
    two = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("x"))))
    words = rows.select(*keys, two.alias("k")).select(*keys, F.col("k.kind").alias("kind"), words_of(F.col("k.x")).alias("w"))
    sig = signatures(weighted_terms(words, [*keys, "kind"], "w"), [*keys, "kind"])
    of = lambda k: F.first(F.when(F.col("kind") == k, F.col("sig")), ignorenulls=True)
    docs = stage(sig.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b")), "signatures")
    w = Window.partitionBy("bucket").orderBy("pos")
    heads = docs.where("pos = 1")
    links = following(heads).join(heads.select(F.col("bucket").alias("next"), F.col("a").alias("after")), "next")
    out = docs.withColumn("ahead", F.lead("a").over(w)).join(links, "bucket")
    return out.select(
        "doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), to_string(F.col("a")).alias("fingerprint"), to_string(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.coalesce("ahead", "after")).alias("near_next"),
    )

"""URL filters: host and path rules, and link-graph propagation for the urls that no rule names.

Hosts link to hosts by the absolute or protocol-relative href values of their pages.  Trust starts at hosts with
allowed pages, by their number, and flows along links; distrust starts at hosts with blocked pages and flows against them (who links to
blocked places is suspect).  Both are personalised PageRanks over every host that has a page or a link, each of sum 1: a host passes on
`damping` of its mass, shared by number of links, and the rest, like the mass of hosts without links to pass it on, restarts at
the seeds.  So a seed host without links has exactly its share of the restarts.

A host is blocked if its distrust is over `margin` times its trust and at least `lift` times the mean host's mass, 1 / hosts.

Defined cases: a null url or one without :// has empty host and path, fits no rule and is allowed; null html has no links; without
blocked seeds every page without a rule is allowed; repeated page ids are rows of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._shared import discard, drop_path, new_path, stage

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Rounds go on until all ranks together change by less than this share of the mean host's mass.
TOLERANCE = 1e-3
#: Distrust over this multiple of trust, and at least this multiple of the mean mass, blocks a host.
MARGIN, LIFT = 1.0, 1.0
#: Blocked hosts up to this many are broadcast to the pages; more join by shuffle, where AQE splits hot hosts.
BROADCAST_ROWS = 100_000
_HREF = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of two equally long ones the block rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url="url", html="html") -> DataFrame:
    """src, dst, n: links between different hosts, summed before and after the shuffle."""
    links = F.explode(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1)))
    df = pages.select(host_of(F.col(url)).alias("src"), links.alias("link"))
    df = df.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return df.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping=DAMPING, tolerance=TOLERANCE) -> DataFrame:
    """edges(src, dst, n), seeds(host, good, bad) -> host, trust, distrust of every host named there.

    A round is one shuffle join per direction and one sum; its result is written to the shared folder.  The change shrinks by `damping` a
    round: without links one round is enough, else about 85 for a thousand hosts and 130 for a million.
    """
    if not 0 <= damping < 1:
        raise ValueError(f"damping has to be in [0, 1), not {damping}")
    spark = edges.sparkSession
    out_n = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("in_n"))
    nodes = edges.select(F.col("src").alias("host")).unionAll(edges.select("dst")).unionAll(seeds.select("host")).distinct()
    nodes = nodes.join(seeds.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "host", "left").fillna(0.0, ["good", "bad"])
    nodes = stage(nodes.join(out_n, "host", "left").join(in_n, "host", "left"), "hosts")
    good, bad, hosts = nodes.agg(F.sum("good"), F.sum("bad"), F.count("*")).first()
    along = stage(edges.join(out_n.withColumnRenamed("host", "src"), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("p")), "along")
    against = stage(edges.join(in_n.withColumnRenamed("host", "dst"), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("in_n")).alias("p")), "against")
    start = [(F.col(c) / F.lit(x or 1.0)).alias(c) for c, x in (("good", good), ("bad", bad))]
    ranks = nodes.select("host", *start, F.col("out_n").isNull().alias("ends"), F.col("in_n").isNull().alias("begins"))
    ranks = ranks.withColumns({"t": F.col("good"), "d": F.col("bad"), "change": F.lit(2.0)})
    stuck = [F.coalesce(F.sum(F.when(F.col(w), F.col(x))), F.lit(0.0)) for w, x in (("ends", "t"), ("begins", "d"))]
    zero, kept = F.lit(0.0), None
    lost_t, lost_d = ranks.agg(*stuck).first()
    while True:
        got = along.join(ranks, "host").select(F.col("to").alias("host"), (F.col("p") * F.col("t")).alias("tin"), zero.alias("din"))
        got = got.unionAll(against.join(ranks, "host").select(F.col("to").alias("host"), zero.alias("tin"), (F.col("p") * F.col("d")).alias("din")))
        got = got.groupBy("host").agg(F.sum("tin").alias("tin"), F.sum("din").alias("din"))
        new = lambda seed, lost, come: F.lit(1 - damping + damping * lost) * F.col(seed) + F.lit(damping) * F.coalesce(come, zero)
        step = ranks.join(got, "host", "left").select("host", "good", "bad", "ends", "begins", new("good", lost_t, F.col("tin")).alias("t"), new("bad", lost_d, F.col("din")).alias("d"), (F.abs(new("good", lost_t, F.col("tin")) - F.col("t")) + F.abs(new("bad", lost_d, F.col("din")) - F.col("d"))).alias("change"))
        path = new_path(spark, "ranks")
        step.write.parquet(path)
        ranks = spark.read.schema(step.schema).parquet(path)
        if kept:
            drop_path(spark, kept)
        kept = path
        lost_t, lost_d, change = ranks.agg(*stuck, F.sum("change")).first()
        if (change or 0.0) < tolerance / max(1, hosts):
            break
    discard(nodes, along, against)
    return ranks.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def blocked_hosts(ranks: DataFrame, margin=MARGIN, lift=LIFT) -> DataFrame:
    """The hosts of ranks(host, trust, distrust) over the thresholds; the mean mass is that of all hosts there."""
    hosts = ranks.count()
    return ranks.where((F.col("distrust") > F.lit(margin) * F.col("trust")) & (F.col("distrust") >= F.lit(lift / max(1, hosts)))).select("host")


def judge(pages: DataFrame, rules=RULES, damping=DAMPING, margin=MARGIN, lift=LIFT, page_id="page_id", url="url", html="html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = stage(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("r", rule_column(F.col("host"), F.col("path"), rules)), "judged")
    edges = stage(host_edges(pages, url, html), "host-edges")
    count = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    bad = stage(blocked_hosts(propagate(edges, seeds, damping), margin, lift).withColumn("_b", F.lit("block")), "blocked-hosts")
    discard(edges)
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    out = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    return out.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "_b", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""URL filters: rules, and link-graph propagation over hosts where no rule fits.

A rule is ``host/path-prefix``; it fits its host and all subdomains.  The longest
fitting rule decides (of equally long ones that with the longer host, then block).
For the other pages their host decides: trust is personalised PageRank over host
edges, started from the hosts whose pages the rules allow; distrust runs over the
reversed edges from hosts whose pages the rules block.  Distrust is shared among
all hosts that link to a blocked one, so it tells nothing of one host's conduct:
beside it goes each host's lead, what its own links take over from their targets,
each by its share of the host's links.  A host is blocked if its lead reaches
``LEAST_LEAD`` and is ``RATIO`` times its trust.

All of it is DataFrame operations.  Host tables are aggregated before they are
joined; they are broadcast only below a checked number of rows.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule, and verdict allow; null html has no links; repeated rows are judged each and
count each towards their host; empty tables give empty results; further columns
of pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints

DAMPING = 0.85
ROUNDS = 12
RATIO = 2.0
#: A host with all its links to wholly blocked hosts has 0.1275.
LEAST_LEAD = 0.01
#: Hosts up to which a table with a row for each host (below 1 kB) is broadcast.
BROADCAST_HOSTS = 20_000
#: Rules of the query: (host/path, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]*)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    rows = [(r.split("/", 1)[0].translate(str.maketrans(_UPPER, _LOWER)), "/" + r.split("/", 1)[1] if "/" in r else "", r, v) for r, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the rules that fit it, the strongest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("c"), F.col("rule"), F.col("rule_path"), F.col("verdict"))
    return each.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst, weight: links between different hosts, counted once for each page and target."""
    host, _ = split_url(pages[url_col])
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))
    each = pages.select(host.alias("src"), F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return each.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, lead from seeds (host, allowed, blocked: shares of its pages)."""
    kinds = (("trust", "allowed", "src", "dst", "src"), ("distrust", "blocked", "dst", "src", "dst"), ("lead", "blocked", "dst", "src", "src"))
    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(seed).alias("seed")) for kind, seed, *_ in kinds))).alias("x"))
    start = checkpoints.cut(start.select("host", "x.kind", (F.col("x.seed") * (1 - damping)).alias("score")).where("score > 0"))
    ranks = start
    edges = checkpoints.cut(edges)
    if not edges.isEmpty():
        # each kind goes from a to b, by the share of the edge in the weight of one of its ends
        each = edges.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(by).alias("by")) for kind, _, a, b, by in kinds))).alias("x"), "weight").select("x.*", "weight")
        sums = each.groupBy("kind", "by").agg(F.sum("weight").alias("all"))
        steps = checkpoints.cut(each.join(sums, ["kind", "by"]).select("kind", F.col("a").alias("host"), "b", (damping * F.col("weight") / F.col("all")).alias("share")))
        for i in range(rounds):
            sent = steps.join(ranks, ["kind", "host"]).select(F.col("b").alias("host"), "kind", (F.col("share") * F.col("score")).alias("score"))
            ranks = sent.unionByName(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            ranks = checkpoints.cut(ranks) if i % 3 == 2 else ranks
    by = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(by("trust"), by("distrust"), by("lead"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_HOSTS else df


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, trust and distrust of each page."""
    spark = pages.sparkSession
    host, path = split_url(pages[url_col])
    rows = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path"))
    table = checkpoints.cut(host_rules(rows.select("host").where("host <> ''").distinct(), _rule_table(spark, rules)))
    judged = rows.join(_small(table), "host", "left").withColumn("hit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0)))
    judged = judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    scores = checkpoints.cut(propagate(host_edges(pages, url_col, html_col), seeds))
    bad = (F.col("lead") >= LEAST_LEAD) & (F.col("lead") >= RATIO * F.col("trust"))
    out = judged.join(_small(scores), "host", "left").fillna(0.0, ["trust", "distrust", "lead"])
    verdict = F.coalesce(F.col("ruled"), F.when(bad, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), RULES)

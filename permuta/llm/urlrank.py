"""URL filtering by rules, and by trust and distrust that links carry between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

DAMPING = 0.85
ITERATIONS = 20
THRESHOLD = 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: (verdict, host, path); fixed by the query's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty where there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rule_match(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null; equal lengths in the order of the rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    seeds: (host, trusted, blocked) pages. Trust follows links, distrust runs against
    them: who links to a blocked host is suspect. Both start from pages in one unit, so
    they compare; a host without links out passes nothing on. One join and one
    aggregate an iteration serve both directions; every fifth cuts the lineage.
    """
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    reverse = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = forward.unionByName(reverse)
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    weights = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "url-edges")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "seed"))
    start = materialize(start.where("seed > 0").select("kind", "host", F.col("seed").cast("double").alias("seed")), "url-seeds")
    rank = start.select("kind", "host", F.col("seed").alias("r"))
    for i in range(0 if weights.isEmpty() else iterations):
        moved = weights.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("w") * damping).alias("x"))
        rank = moved.unionByName(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("x"))).groupBy("kind", "host").agg(F.sum("x").alias("r"))
        if i % 5 == 4:
            rank = materialize(rank, "url-rank")
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(pick("trust"), pick("distrust"))


def filter_urls(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, iterations: int = ITERATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html).

    A fitting rule decides; else the page is blocked where its host's distrust exceeds
    its trust by more than ``threshold``. Hosts that no evidence reaches are allowed. A
    null url has empty host and path, a null html no links; rows may repeat.
    """
    placed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    placed = placed.withColumn("match", rule_match(F.col("host"), F.col("path"), rules))
    judged = materialize(placed.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict")), "url-pages")
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    scores = propagate(host_edges(placed), seeds, damping, iterations)
    bad = scores.where(F.col("distrust") - F.col("trust") > threshold).select("host").withColumn("_bad", F.lit(True))
    open_ = judged.where("verdict is null").drop("verdict").join(bad, "host", "left")
    open_ = open_.select("page_id", "host", "path", "rule", F.when(F.col("_bad"), "block").otherwise("allow").alias("verdict"))
    return judged.where("verdict is not null").unionByName(open_)


def filter_sql(rules: tuple = RULES, damping: float = DAMPING, iterations: int = ITERATIONS, threshold: float = THRESHOLD) -> str:
    """The same as DuckDB SQL over the view pages."""
    fits = lambda r: f"((host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}'))"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "case " + " ".join(f"when {fits(r)} then '{r[1] + r[2]}'" for r in ordered) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then '{r[0]}'" for r in ordered) + " end"
    link = LINK.replace("'", "''")
    parts = [
        f"u as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{PATH}', 1) as path from pages)",
        f"j as (select *, {rule} as rule, {verdict} as verdict from u)",
        f"l as (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') as dst from u)",
        "e as (select src, dst, count(*) as n from l where src <> dst and src <> '' group by src, dst)",
        "b as (select 'trust' as kind, src, dst, n from e union all select 'distrust', dst, src, n from e)",
        "w as (select kind, src, dst, n / sum(n) over (partition by kind, src) as w from b)",
        "s as (select case verdict when 'allow' then 'trust' else 'distrust' end as kind, host, count(*)::double as seed from j where verdict is not null and host <> '' group by 1, 2)",
        "r0 as (select kind, host, seed as r from s)",
    ]
    for i in range(iterations):
        parts.append(f"r{i + 1} as (select kind, host, sum(x) as r from (select w.kind, w.dst as host, r * w * {damping} as x from w join r{i} r on w.kind = r.kind and w.src = r.host union all select kind, host, seed * {1 - damping} from s) group by kind, host)")
    score = "coalesce(sum(case kind when 'distrust' then r end), 0) - coalesce(sum(case kind when 'trust' then r end), 0)"
    parts.append(f"bad as (select host from r{iterations} group by host having {score} > {threshold})")
    return f"with {', '.join(parts)} select page_id, host, path, rule, coalesce(verdict, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from j"

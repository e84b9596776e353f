"""URL filter: explicit rules first, else trust and distrust propagated over the host link graph.

Personalised PageRank spreads trust from hosts whose pages rules allow along links, and distrust from
hosts whose pages rules block against them. Both run as one power series over host edges, counted
before anything else is shuffled; only sums of mass reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, spread_join, table

#: verdict and host/path, the query's rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, TOLERANCE, ITERATIONS = 0.85, 1e-6, 30
#: Distrust, the damped share of links that lead to blocked hosts, above which a host is blocked if it also exceeds its trust.
THRESHOLD = 0.5

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def longest_first(rules) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[1]))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict for the columns host and path, null where none fits. rules: a configured list of some hundreds at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in reversed(longest_first(rules)):
        own, slash, start = text.partition("/")
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit(f".{own}"))) & F.startswith(F.col("path"), F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target, n: links between different hosts, counted. Relative links stay on their host."""
    links = pages.select(host_of(F.col(url)).alias("source"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    to = F.translate(F.regexp_extract("link", r"//(?:[^/?#@]*@)?([^/?#:]*)", 1), _UPPER, _LOWER)
    edges = links.select("source", to.alias("target")).filter("source != '' AND target != '' AND source != target")
    return edges.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, by_source: bool = False) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust) over edges (source, target, n).

    Each step sends on what the step before has brought; the sum over the steps is the personalised
    PageRank over (1 - damping). It ends when what is on its way is below tolerance of what arrived.
    Mass at a host without links ends there. Each step is written to the shared folder. Distrust is
    divided among those that link to a host or, by_source, reaches each of them in proportion to its
    own links, so that it doesn't shrink with their number.
    """
    edges = materialize(edges, "host-edges")
    out = edges.groupBy("source").agg(F.sum("n").alias("all"))
    into = edges.groupBy("target").agg(F.sum("n").alias("all"))
    ways = edges.join(out, "source").select(F.lit(0).alias("kind"), F.col("source").alias("host"), F.col("target").alias("next"), (F.col("n") / F.col("all")).alias("share"))
    back = (edges.join(out, "source") if by_source else edges.join(into, "target")).select(F.lit(1).alias("kind"), F.col("target").alias("host"), F.col("source").alias("next"), (F.col("n") / F.col("all")).alias("share"))
    ways = materialize(ways.union(back), "host-ways")
    pair = F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").cast("double").alias("mass")), F.struct(F.lit(1).alias("kind"), F.col("distrust").cast("double").alias("mass")))
    step = materialize(seeds.select("host", F.explode(pair).alias("x")).select("x.kind", "host", "x.mass").filter("mass > 0"), "host-mass")
    steps, total = [step], step.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    for _ in range(iterations):
        moved = step.join(ways, ["kind", "host"]).groupBy("kind", F.col("next").alias("host")).agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
        step = materialize(moved, "host-mass")
        mass = step.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
        if mass == 0:
            break
        steps.append(step)
        total += mass
        if mass <= tolerance * total:
            break
    arrived = reduce(DataFrame.unionByName, steps)
    sums = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0))
    return arrived.groupBy("host").agg(sums(0).alias("trust"), sums(1).alias("distrust"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD, iterations: int = ITERATIONS, by_source: bool = True) -> DataFrame:
    """key, host, path, rule and verdict of every row.

    The longest fitting rule decides. Where none fits, a host is blocked if its distrust exceeds the
    threshold and its trust. With by_source, distrust is the damped share of a host's links that lead
    to blocked hosts, whatever the number of hosts that link there; without, a blocked host's distrust
    is divided among them. A host's seeds are the shares of its pages that rules allow and block.
    A null url, or one without `://`, has an empty host and path and is allowed. Repeated rows are
    judged alike and count as often; other columns are ignored; an empty table gives no rows.
    """
    rule, verdict = rule_of(rules)
    named = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = materialize(named.select(key, "host", "path", rule.alias("rule"), verdict.alias("ruled")), "ruled-pages")
    share = lambda word: F.avg(F.when(F.col("ruled") == word, 1.0).otherwise(0.0))
    seeds = materialize(ruled.filter("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"), F.count("*").alias("times")), "host-seeds")
    scores = propagate(seeds.drop("times"), host_edges(pages, url, html), iterations=iterations, by_source=by_source)
    bad = scores.filter((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("spread"))
    bad = materialize(bad.join(seeds.select("host", "times"), "host"), "blocked-hosts")
    return spread_join(ruled, bad, ["host"], "times", F.col(key)).select(key, "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql(steps: int = ITERATIONS) -> str:
    cases = lambda give: "CASE " + " ".join(f"WHEN (host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{give(w, t)}'" for w, t in longest_first(RULES)) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    walk = ",\n".join(f"r{i + 1} AS MATERIALIZED (SELECT w.kind, w.next AS host, {DAMPING} * sum(r.mass * w.share) AS mass FROM r{i} r JOIN ways w ON w.kind = r.kind AND w.host = r.host GROUP BY 1, 2)" for i in range(steps))
    union = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(steps + 1))
    link = LINK.replace("'", "''")
    return rf"""
WITH p AS MATERIALIZED (
  SELECT page_id, html, {lower(f"regexp_extract(coalesce(url, ''), '{URL}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, {cases(lambda w, t: t)} AS rule, {cases(lambda w, t: w)} AS ruled FROM p),
seeds AS (SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS trust, avg((coalesce(ruled, '') = 'block')::INT) AS distrust FROM ruled WHERE host <> '' GROUP BY 1),
links AS (SELECT host AS source, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM p),
ends AS (SELECT source, {lower("regexp_extract(link, '//(?:[^/?#@]*@)?([^/?#:]*)', 1)")} AS target FROM links),
edges AS MATERIALIZED (SELECT source, target, count(*) AS n FROM ends WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
ways AS MATERIALIZED (
  SELECT 0 AS kind, source AS host, target AS next, n / sum(n) OVER (PARTITION BY source) AS share FROM edges
  UNION ALL SELECT 1, target, source, n / sum(n) OVER (PARTITION BY source) FROM edges),
r0 AS MATERIALIZED (SELECT 0 AS kind, host, trust AS mass FROM seeds WHERE trust > 0 UNION ALL SELECT 1, host, distrust FROM seeds WHERE distrust > 0),
{walk},
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0) AS trust, coalesce(sum(mass) FILTER (kind = 1), 0) AS distrust FROM ({union}) GROUP BY 1)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN s.distrust > {THRESHOLD} AND s.distrust > s.trust THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN scores s ON s.host = r.host
"""


OP4_SQL = _sql()

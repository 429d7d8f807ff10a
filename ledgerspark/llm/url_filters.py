"""URL filters: rules by host and path, and link-graph propagation for the urls that no rule fits.

Links between hosts make a graph. Trust starts on the hosts of pages that a rule allows and flows along
links (personalised PageRank); distrust starts on the hosts of blocked pages and flows against them, so a
host that links to blocked ones gathers it. Both start with total mass 1, spread by the number of such pages.
An url without a rule is blocked if its host has more than `share` of its mass in distrust, and allowed else,
also where neither reaches it. Only the ratio of the two counts, so the number of pages doesn't matter.

A score is the sum of what reaches a host after any number of links, (1 - damping) of the seeds' mass damped
at each link. Rounds go on until no host gained more than `tolerance` of its score in the last one: a host's own
score is the measure, so neither the number of seeds nor that of pages decides how far mass is carried, and a
chain of links is followed to its end. Mass at a host without links goes no further.

Edges are summed by pair of hosts before anything is joined; both flows are carried by one table, so a round
is one join and one aggregation with map-side sums. Every few rounds are written.

Defined results: null urls and urls without :// have an empty host and path, no rule and are allowed; null or
empty html has no links; relative links and links of a host to itself don't propagate; equal urls are judged alike; other
columns are kept, and columns already named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read

#: (host, path, verdict) of the rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, SHARE, TOLERANCE = 0.85, 0.5, 1e-3
#: Rounds between two looks at the gains; each such state is written.
STRIDE = 4
#: Part of a host's mass by which its distrust must pass the share, so that the order of sums doesn't matter.
MARGIN = 1e-9
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s<>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def _fitting(rules) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits columns host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _judged(pages: DataFrame, url: str, rules) -> DataFrame:
    parts = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": _part(F.col(f"`{url}`"), 2)})
    name, verdict = _fitting(rules)
    return parts.withColumns({"rule": name, "verdict": verdict})


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts."""
    found = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst AND src <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(flow, host, score) of trust along the edges and distrust against them, from seeds (flow, host, mass)."""
    along = edges.select(F.lit("trust").alias("flow"), F.col("src").alias("from"), F.col("dst").alias("to"), "links")
    against = edges.select(F.lit("distrust").alias("flow"), F.col("dst").alias("from"), F.col("src").alias("to"), "links")
    both = along.unionByName(against)
    out = both.groupBy("flow", "from").agg(F.sum("links").alias("out"))
    steps = materialize(both.join(out, ["flow", "from"]).select("flow", "from", "to", (F.col("links") / F.col("out")).alias("part")), "steps")
    first = (F.col("mass") * F.lit(1 - damping)).alias("score")
    state, last = seeds.select("flow", "host", first).withColumn("moving", F.col("score")), None
    while True:
        for _ in range(STRIDE):
            ahead = state.where("moving > 0").select("flow", F.col("host").alias("from"), "moving")
            moved = steps.join(ahead, ["flow", "from"]).select("flow", F.col("to").alias("host"), (F.col("moving") * F.col("part") * F.lit(damping)).alias("moving"))
            rows = state.select("flow", "host", "score", F.lit(0.0).alias("moving")).unionByName(moved.select("flow", "host", F.col("moving").alias("score"), "moving"))
            state = rows.groupBy("flow", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
        state = materialize(state, "scores")
        if last is not None:
            discard(last)
        last = state
        if state.where(F.col("moving") > F.lit(tolerance) * F.col("score")).isEmpty():
            return state.select("flow", "host", "score")


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", damping: float = DAMPING, share: float = SHARE, tolerance: float = TOLERANCE) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict."""
    new = ("host", "path", "rule", "trust", "distrust", "verdict")
    own = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in new))
    judged = _judged(own, url, rules)
    counted = judged.where("verdict IS NOT NULL").groupBy("host", "verdict").agg(F.count("*").alias("n"))
    sums = counted.groupBy(F.col("verdict").alias("of")).agg(F.sum("n").alias("total"))
    flow = F.when(F.col("verdict") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = materialize(counted.join(sums, F.col("verdict") == F.col("of")).select(flow.alias("flow"), "host", (F.col("n") / F.col("total")).alias("mass")), "seeds")
    scores = propagate(materialize(host_edges(pages, url, html), "edges"), seeds, damping, tolerance)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("flow") == name, F.col("score"))), F.lit(0.0)).alias(name)
    hosts = materialize(scores.groupBy(F.col("host").alias("scored")).agg(of("trust"), of("distrust")), "hosts")
    joined = judged.withColumnRenamed("verdict", "said").join(hosts, F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > F.lit(share + MARGIN) * (trust + distrust), "block").otherwise("allow")
    return joined.select(*(F.col(f"`{c}`") for c in own.columns), "host", "path", "rule", trust.alias("trust"), distrust.alias("distrust"), F.coalesce("said", method).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
judged AS (SELECT *, {rule} AS rule, {said} AS said FROM cut),
counted AS (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS flow, host, count(*) AS n FROM judged WHERE said IS NOT NULL GROUP BY ALL),
seeds AS (SELECT flow, host, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY flow) AS mass FROM counted),
found AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1, 'i'))")} AS dst FROM judged),
edges AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> dst AND src <> '' GROUP BY ALL),
moves AS (SELECT 'trust' AS flow, src AS "from", dst AS "to", links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
steps AS (SELECT flow, "from", "to", CAST(links AS DOUBLE) / sum(links) OVER (PARTITION BY flow, "from") AS part FROM moves),
state AS (
  SELECT 0 AS k, flow, host, mass * {1 - DAMPING} AS score, mass * {1 - DAMPING} AS moving, 1e0 AS gain FROM seeds
  UNION ALL
  SELECT k + 1 AS k, flow, host, sum(score) AS score, sum(moving) AS moving, max(sum(moving) / sum(score)) OVER () AS gain
  FROM (SELECT k, flow, host, score, 0e0 AS moving, gain FROM state
        UNION ALL SELECT t.k, t.flow, s."to", t.moving * s.part * {DAMPING}, t.moving * s.part * {DAMPING}, t.gain FROM state t JOIN steps s ON s.flow = t.flow AND s."from" = t.host WHERE t.moving > 0)
  WHERE k % {STRIDE} <> 0 OR k = 0 OR gain > {TOLERANCE} GROUP BY k, flow, host),
terms AS (SELECT * FROM state WHERE k = (SELECT max(k) FROM state)),
hosts AS (SELECT host, coalesce(sum(score) FILTER (flow = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (flow = 'distrust'), 0) AS distrust
          FROM terms GROUP BY host)
SELECT page_id, j.host AS host, path, rule,
       coalesce(said, CASE WHEN coalesce(distrust, 0) > {SHARE + MARGIN} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN hosts h ON j.host = h.host
"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE_SQL = {"op2_url_filters": _oracle()}

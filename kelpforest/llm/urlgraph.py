"""URL filters: path rules, then trust and distrust that flow over the host graph.

Hosts that allow rules name seed a personalised PageRank along the links; hosts
that block rules name seed distrust that flows against them, each host taking
the mean over its own links. Both are held to scales that don't depend on the
size of the graph: trust is divided by the rank that all hosts together would
lend the host, so it is the share of its rank that trusted hosts account for;
distrust is the damped share of its own links' weight that leads to blocked
pages, directly or further on. A host is blocked where its distrust exceeds
both ``FLOOR`` and its trust. A seed's own share doesn't count: a rule about one
path says nothing about the rest of its host.

Links are summed to (from, to, weight) before anything is joined, so a hot host
costs a row per distinct neighbour; the rank table has a row per host. Both
directions run in one join and one sum per round.

Null urls, and those without ``://``, have an empty host and path, fit no rule
and are allowed; null html has no links. Hosts without links get no rank and are
allowed. Repeated rows count as often as they come. Urls and pages of any
length are read whole. Empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import LOWER, UPPER, ascii_lower, stored

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 8
#: Share of a host's links, damped, that must lead to blocked pages.
FLOOR = 0.25
_URL = "://([^/?#]*)([^?#]*)"
#: Start of a link to another host, up to and with its host.
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
#: Rounds between two written rank tables.
CUT = 4


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def rule_of(host: Column, path: Column, rules=RULES, verdicts: bool = False) -> Column:
    """The longest rule that fits, or its verdict; null where none fits. The rule list becomes one expression."""
    out = None
    for verdict, name, prefix in _longest_first(rules):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.lit(verdict if verdicts else name + prefix)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("dst")
    ).withColumn("dst", ascii_lower(F.col("dst")))
    return links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): shares that reach a host from others. ``seeds``: (host, trusted, blocked) weights of all hosts, 0 to 1."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    # The same share of a link carries rank to its end (way 0) and distrust back to its start (way 1).
    share = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p"))
    both = share.select(F.lit(0).alias("way"), F.col("src").alias("f"), F.col("dst").alias("t"), "p").unionByName(
        share.select(F.lit(1).alias("way"), F.col("dst").alias("f"), F.col("src").alias("t"), "p")
    )
    flow = stored(both, "host-flow")
    # ``x`` is trust or distrust; ``y`` is what all hosts lend along the links.
    own = stored(
        seeds.select(F.lit(0).alias("way"), F.col("host").alias("f"), F.col("trusted").cast("double").alias("x"), F.lit(1.0).alias("y"))
        .unionByName(seeds.select(F.lit(1).alias("way"), F.col("host").alias("f"), F.col("blocked").cast("double").alias("x"), F.lit(0.0).alias("y")))
        .where("x > 0 OR y > 0"),
        "host-seeds",
    )
    rank, reached = own, None
    for k in range(1, rounds + 1):
        step = [(damping * F.sum(F.col(c) * F.col("p"))).alias(c) for c in ("x", "y")]
        reached = rank.join(flow, ["way", "f"]).groupBy("way", F.col("t").alias("f")).agg(*step)
        if k % CUT == 0 or k == rounds:
            reached = stored(reached, "host-ranks")
        rank = own.unionByName(reached).groupBy("way", "f").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert reached is not None
    trust = F.when((F.col("way") == 0) & (F.col("y") > 0), F.col("x") / F.col("y")).otherwise(0.0)
    return reached.groupBy(F.col("f").alias("host")).agg(
        F.sum(trust).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("x")).otherwise(0.0)).alias("distrust")
    )


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumns(
        {"rule": rule_of(F.col("host"), F.col("path"), rules), "_v": rule_of(F.col("host"), F.col("path"), rules, verdicts=True)}
    )
    seeds = ruled.where("host != ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("_v"), F.lit("")) == "allow").cast("double")).alias("trusted"),
        F.avg((F.coalesce(F.col("_v"), F.lit("")) == "block").cast("double")).alias("blocked"),
    )
    bad = (
        ranks(host_edges(pages.select("url", "html")), seeds, damping, rounds)
        .where((F.col("distrust") > floor) & (F.col("distrust") > F.col("trust")))
        .select("host", F.lit("block").alias("_g"))
    )
    return ruled.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_v", "_g", F.lit("allow")).alias("verdict")
    )


def oracle_sql(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, floor: float = FLOOR) -> str:
    def case(verdicts: bool) -> str:
        whens = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if verdicts else h + p}'"
            for v, h, p in _longest_first(rules)
        )
        return f"CASE {whens} END"

    steps = ""
    rank = "own"
    for k in range(1, rounds + 1):
        steps += f"""
c{k} AS (SELECT way, t AS f, {damping} * sum(x * p) AS x, {damping} * sum(y * p) AS y FROM {rank} JOIN flow USING (way, f) GROUP BY way, t),
r{k} AS (SELECT way, f, sum(x) AS x, sum(y) AS y FROM (SELECT * FROM own UNION ALL SELECT * FROM c{k}) GROUP BY way, f),"""
        rank = f"r{k}"
    link = _LINK.replace("'", "''")
    return f"""
WITH split AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {case(False)} AS rule, {case(True)} AS v FROM split),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM split),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst),
share AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM edges),
flow AS (SELECT 0 AS way, src AS f, dst AS t, p FROM share UNION ALL SELECT 1, dst, src, p FROM share),
seeds AS (SELECT host, avg((coalesce(v, '') = 'allow')::INT) AS g, avg((coalesce(v, '') = 'block')::INT) AS b FROM ruled WHERE host <> '' GROUP BY host),
own AS (SELECT 0 AS way, host AS f, g::DOUBLE AS x, 1.0::DOUBLE AS y FROM seeds UNION ALL SELECT 1, host, b, 0 FROM seeds WHERE b > 0),{steps}
bad AS (SELECT f AS host FROM c{rounds} GROUP BY f HAVING sum(CASE way WHEN 1 THEN x ELSE 0 END) > {floor}
  AND sum(CASE way WHEN 1 THEN x ELSE 0 END) > sum(CASE WHEN way = 0 AND y > 0 THEN x / y ELSE 0 END))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM ruled"""

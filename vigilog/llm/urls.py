"""URL filters: rules, and trust and distrust that spread over links; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, table

#: (verdict, host, path): of a rule's host and all its subdomains, urls whose path begins so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share of a host's rank that goes on to its neighbours.
DAMPING = 0.85
#: The walks end when a round changes no host's figure by more than this (of what reaches it from all hosts).
TOLERANCE = 1e-3
#: A host is blocked if its distrust exceeds its trust by this much. Both lie between 0 and 1, and depend
#: neither on the number of hosts nor on how many others link to the same bad host.
THRESHOLD = 0.5
LINK = r"""(?i)<a\x20[^>]*?href\x20*=\x20*["']?(?:https?:)?//([^\x20\x09-\x0D"'<>/?#]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z in lower case, and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; NULL if none does.

    Rules are few and fixed, so they are one CASE. Of two that fit, that with the longer text wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts. Counted per pair before the shuffle."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", _lower(F.col("dst")).alias("dst"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _shares(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst, share): the part of a host's links that goes to another."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return scratch.keep(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")


def _trust(hosts: DataFrame, shares: DataFrame, damping: float, tolerance: float, scratch: Scratch) -> DataFrame:
    """(host, trust): of all that links bring a host in a personalised PageRank, the part from allowed seeds.

    One walk restarts at the hosts in proportion to the share of their pages that a rule allows, the
    other at all hosts alike. What a host starts with itself is not counted. Each round is a written
    table and moves less than ``damping`` of what the one before did.
    """
    both = ("from_seeds", "from_all")
    # Hosts that are only linked to have no pages, but the walk from all begins there too.
    every = hosts.select("host", "allowed").unionByName(
        shares.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("allowed")))
    start = scratch.keep(every.groupBy("host").agg(
        (F.max("allowed") * (1 - damping)).alias("from_seeds"), F.lit(1 - damping).alias("from_all")), "start")
    came = scratch.keep(start.select("host", *[F.lit(0.0).alias(c) for c in both], F.lit(True).alias("moves")), "rank")
    moving = True
    while moving:
        rank = came.join(start.select("host", *[F.col(c).alias(f"own_{c}") for c in both]), "host").select(
            F.col("host").alias("src"), *[(F.col(c) + F.col(f"own_{c}")).alias(c) for c in both])
        moved = shares.join(rank, "src").select(F.col("dst").alias("host"), *[(F.col(c) * F.col("share") * damping).alias(c) for c in both])
        moved = moved.groupBy("host").agg(*[F.sum(c).alias(c) for c in both])
        was = came.select("host", *[F.col(c).alias(f"was_{c}") for c in both])
        change = F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0)) - F.col(f"was_{c}")) for c in both])
        new = scratch.keep(was.join(moved, "host", "left").select(
            "host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in both], (change > tolerance * F.coalesce("from_all", F.lit(0.0))).alias("moves")), "rank")
        scratch.drop(came)
        came = new
        moving = not came.filter("moves").isEmpty()
    return came.select("host", F.when(F.col("from_all") > 0, F.col("from_seeds") / F.col("from_all")).otherwise(0.0).alias("trust"))


def _distrust(hosts: DataFrame, shares: DataFrame, damping: float, tolerance: float, scratch: Scratch) -> DataFrame:
    """(host, distrust): how likely a walk along its links comes to blocked pages, each further step counting less.

    Distrust goes against links, to each linking host by the part of its own links that lead there:
    1 for who links to blocked hosts alone, however many do. The walk ends at a blocked page. Each round is
    a written table and adds less than ``damping`` of what the one before did.
    """
    bad = hosts.select(F.col("host").alias("dst"), "blocked")
    steps = scratch.keep(shares.join(bad, "dst", "left").select(
        "src", "dst", (F.col("share") * F.coalesce("blocked", F.lit(0.0))).alias("meets"),
        (F.col("share") * (1 - F.coalesce("blocked", F.lit(0.0))) * damping).alias("goes")), "steps")
    far = scratch.keep(steps.groupBy("src").agg(F.sum("meets").alias("distrust"), F.lit(True).alias("moves")), "far")
    moving = True
    while moving:
        after = steps.join(far.select(F.col("src").alias("dst"), F.col("distrust").alias("next")), "dst", "left")
        after = after.groupBy("src").agg(F.sum(F.col("meets") + F.col("goes") * F.coalesce("next", F.lit(0.0))).alias("distrust"))
        new = scratch.keep(after.join(far.select("src", F.col("distrust").alias("was")), "src").select(
            "src", "distrust", (F.col("distrust") - F.col("was") > tolerance).alias("moves")), "far")
        scratch.drop(far)
        far = new
        moving = not far.filter("moves").isEmpty()
    return far.select(F.col("src").alias("host"), "distrust")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of pages (page_id, url, html) with host, path, rule, verdict, trust and distrust.

    A rule decides its urls. Other urls go by their host: trust spreads along links from hosts in
    proportion to the share of their pages that a rule allows; distrust spreads against links from
    hosts in proportion to the share that a rule blocks, so that who links to blocked hosts is
    distrusted. What a host starts with itself does not count, only what links bring: that a rule
    blocks some of its pages says nothing about the others. It is blocked if its distrust exceeds its
    trust by ``threshold``.

    A NULL url, or one without ``://``, has an empty host and path, and is allowed. A NULL html has
    no links; relative links stay on their host and do not count. Rows that repeat are judged alike.
    Empty tables give no rows. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = split.select("page_id", "host", "path", *[c.alias(n) for c, n in zip(rule_of(F.col("host"), F.col("path"), rules), ("rule", "own"), strict=True)])
    edges = scratch.keep(host_edges(split), "edges")
    share = lambda v: F.avg(F.when(F.col("own") == v, 1.0).otherwise(0.0))
    hosts = scratch.keep(judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    shares = _shares(edges, scratch)
    ranks = hosts.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    if not shares.isEmpty():
        ranks = hosts.select("host").join(_trust(hosts, shares, damping, tolerance, scratch), "host").join(
            _distrust(hosts, shares, damping, tolerance, scratch), "host", "left")
    # One row per host, written, so that the join may split a hot host's pages.
    ranks = scratch.keep(ranks, "ranks")
    out = judged.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("own", F.when((F.col("host") != "") & (F.col("distrust") - F.col("trust") >= threshold), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def query(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = LINK.replace("'", "''")

    rounds = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))

    def trust():
        """The same walk over so many rounds that less than TOLERANCE of it is left."""
        both = lambda what: f"{what.format('seeds')} AS seeds, {what.format('alls')} AS alls"
        parts = [f"""start AS MATERIALIZED (SELECT host, max(seed) * {1 - DAMPING} AS seeds, {1 - DAMPING} AS alls FROM (
  SELECT host, allowed AS seed FROM hosts UNION ALL SELECT src, 0 FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY host),
t0 AS (SELECT host, 0.0::DOUBLE AS seeds, 0.0::DOUBLE AS alls FROM start)"""]
        parts += [f"""t{i} AS (SELECT dst AS host, {both(f"sum((coalesce(r.{{0}}, 0) + s.{{0}}) * share * {DAMPING})")}
  FROM shares JOIN start s ON s.host = src LEFT JOIN t{i - 1} r ON r.host = src GROUP BY dst)""" for i in range(1, rounds + 1)]
        return ",\n".join([*parts, f"t_end AS (SELECT host, CASE WHEN alls > 0 THEN seeds / alls ELSE 0 END AS rank FROM t{rounds})"])

    def distrust():
        parts = [f"""steps AS MATERIALIZED (SELECT src, dst, share * coalesce(blocked, 0) AS meets,
  share * (1 - coalesce(blocked, 0)) * {DAMPING} AS goes FROM shares LEFT JOIN hosts ON host = dst),
d0 AS (SELECT src AS host, sum(meets) AS rank FROM steps GROUP BY src)"""]
        parts += [f"""d{i} AS (SELECT src AS host, sum(meets + goes * coalesce(rank, 0)) AS rank
  FROM steps LEFT JOIN d{i - 1} r ON r.host = dst GROUP BY src)""" for i in range(1, rounds + 1)]
        return ",\n".join(parts)

    return f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS row_id, page_id, html, {low("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(own, name, start) AS (VALUES {rules}),
fit AS (
  SELECT row_id, name || start AS rule, own,
         row_number() OVER (PARTITION BY row_id ORDER BY length(name || start) DESC) AS place
  FROM split JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)),
judged AS (SELECT s.*, rule, own FROM split s LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (row_id)),
links AS (SELECT DISTINCT row_id, host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM split),
edges AS (
  SELECT src, {low("dst")} AS dst, count(*) AS weight FROM links
  WHERE src <> {low("dst")} AND src <> '' AND dst <> '' GROUP BY ALL),
hosts AS (
  SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed,
         avg(CASE WHEN own = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM judged GROUP BY host),
shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
{trust()},
{distrust()}
SELECT page_id, j.host, path, rule,
       coalesce(own, CASE WHEN j.host <> '' AND coalesce(d.rank, 0) - coalesce(t.rank, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t_end t ON t.host = j.host LEFT JOIN d{rounds} d ON d.host = j.host
"""


SQL = _sql()

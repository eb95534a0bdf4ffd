"""URL filters: rules, and for the rest trust and distrust over the link graph of hosts.

A url is judged by the longest rule that fits its host and path. Where none fits, its
host is judged by the links between hosts: trust flows along links from the hosts whose
pages the rules allow (personalised PageRank), distrust flows against links from the
hosts whose pages they block, so that who links to blocked hosts is distrusted. A host
is allowed if trust has at least ``SHARE`` of the sum. A host that neither reaches is
allowed.

All of it is DataFrame operations. Links are counted per pair of hosts before anything
is joined, ranks are written after each round, and hosts are joined to pages by Spark's
choice of join, which splits a host with very many pages.

A null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed. A null html has no links. Repeated rows are judged each; their links and
seeds count each. An empty table gives no rows. Columns besides the named ones are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import column
from fleetgauge.session import stored

#: Rule (host and path) and verdict.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

#: Share of rank that follows links, rounds at most, and trust a host needs.
FOLLOWED, ROUNDS, SHARE = 0.85, 20, 0.5

HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def lowered(host: Column) -> Column:
    return F.translate(host, _UPPER, _LOWER)


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path`` of every page."""
    rest = F.coalesce(after_scheme(column(url)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return pages.select(
        column(page_id).cast("bigint").alias("page_id"),
        lowered(host).alias("host"),
        F.regexp_extract(
            F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0
        ).alias("path"),
    )


def ruled(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` and ``decision`` of the longest rule that fits; null without one."""
    which = {"rule": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")}
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & (
            F.startswith(F.col("path"), F.lit(slash + path))
        )
        for name, value in (("rule", rule), ("decision", verdict)):
            which[name] = F.when(fits, F.lit(value)).otherwise(which[name])
    return pages.withColumns(which)


def host_links(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``source, target, links`` between different hosts; relative links stay at home."""
    source = lowered(F.regexp_extract(after_scheme(column(url)), "^[^/?#]*", 0))
    hrefs = F.filter(
        F.regexp_extract_all(column(html), F.lit(HREF), F.lit(1)),
        lambda link: link.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"),
    )
    target = lowered(F.regexp_extract("link", "//([^/?#]*)", 1))
    return (
        pages.select(source.alias("source"), F.explode(hrefs).alias("link"))
        .select("source", target.alias("target"))
        .filter((F.col("source") != "") & (F.col("target") != "")
                & (F.col("source") != F.col("target")))
        .groupBy("source", "target").agg(F.count("*").alias("links"))
    )


def seeds(judged: DataFrame) -> DataFrame:
    """``kind, host, seed``: each host's share of the pages that rules allow or block."""
    kind = F.when(F.col("decision") == "allow", "trust").otherwise("distrust")
    counts = (
        judged.filter(F.col("decision").isNotNull())
        .groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows at most
    return counts.join(F.broadcast(totals), "kind").select(
        "kind", "host", (F.col("n") / F.col("total")).alias("seed")
    )


def ranks(links: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of trust along links and of distrust against them.

    Rounds end early once a round changes nothing.
    """
    both = links.select(
        F.lit("trust").alias("kind"), F.col("source").alias("from"),
        F.col("target").alias("to"), "links",
    ).unionAll(links.select(F.lit("distrust"), "target", "source", "links"))
    out = both.groupBy("kind", "from").agg(F.sum("links").alias("out"))
    steps = stored(
        both.join(out, ["kind", "from"]).select(
            "kind", F.col("from").alias("host"), "to",
            (F.lit(FOLLOWED) * F.col("links") / F.col("out")).alias("share"),
        ),
        "link-steps",
    )
    base = stored(
        start.select("kind", "host", (F.lit(1 - FOLLOWED) * F.col("seed")).alias("rank")), "seeds"
    )
    rank = base
    if steps.isEmpty():
        return rank
    for _ in range(rounds):
        moved = rank.join(steps, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share")).alias("rank")
        )
        new = stored(
            base.unionAll(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")),
            "ranks",
        )
        before = rank.select("kind", "host", F.col("rank").alias("before"))
        same = new.join(before, ["kind", "host"], "left").filter(
            F.abs(F.col("rank") - F.coalesce(F.col("before"), F.lit(0.0))) > 1e-15
        ).isEmpty()
        rank = new
        if same:
            break
    return rank


def host_verdicts(rank: DataFrame, share: float = SHARE) -> DataFrame:
    """``host, host_verdict`` of every host that trust or distrust reaches."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    part = F.col("trust") / (F.col("trust") + F.col("distrust"))
    return (
        rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
        .select(
            "host",
            F.when(F.round(part, 9) >= share, "allow").otherwise("block").alias("host_verdict"),
        )
    )


def judged(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    read = ruled(parsed(pages, page_id, url), rules)
    rank = ranks(host_links(pages, page_id, url, html), seeds(read))
    hosts = stored(host_verdicts(rank), "host-verdicts")
    return read.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decision", "host_verdict", F.lit("allow")).alias("verdict"),
    )


def _sql() -> str:
    def walk(kind: str, source: str, target: str) -> str:
        text = ""
        for i in range(ROUNDS):
            before = f"{kind}{i}"
            text += f""", {kind}{i + 1} AS MATERIALIZED (
  SELECT host, sum(rank) AS rank FROM (
    SELECT host, rank FROM {kind}0 UNION ALL
    SELECT l.{target}, r.rank * {FOLLOWED} * l.links / l.out_{kind}
    FROM {before} r JOIN links l ON r.host = l.{source}) GROUP BY host)"""
        return text

    rules = ",\n    ".join(
        f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES
    )
    return rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id, html, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, html, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path
  FROM h
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
    {rules}
), fit AS (
  SELECT page_id, rule, verdict FROM p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1
), j AS (SELECT p.*, fit.rule, fit.verdict FROM p LEFT JOIN fit USING (page_id)),
counted AS (
  SELECT source, target, count(*) AS links FROM (
    SELECT host AS source, translate(regexp_extract(link, '//([^/?#]*)', 1),
      '{_UPPER}', '{_LOWER}') AS target
    FROM (SELECT host, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) AS link
      FROM p)
    WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//'))
  WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target
), links AS MATERIALIZED (
  SELECT *, sum(links) OVER (PARTITION BY source) AS out_trust,
    sum(links) OVER (PARTITION BY target) AS out_distrust
  FROM counted
), seeded AS (
  SELECT verdict, host, count(*) / sum(count(*)) OVER (PARTITION BY verdict) AS seed
  FROM j WHERE verdict IS NOT NULL GROUP BY verdict, host
), trust0 AS (SELECT host, {1 - FOLLOWED} * seed AS rank FROM seeded WHERE verdict = 'allow'),
distrust0 AS (SELECT host, {1 - FOLLOWED} * seed AS rank FROM seeded WHERE verdict = 'block')
{walk("trust", "source", "target")}
{walk("distrust", "target", "source")}
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict,
    CASE WHEN coalesce(t.rank, 0) + coalesce(d.rank, 0) = 0 THEN 'allow'
      WHEN round(coalesce(t.rank, 0) / (coalesce(t.rank, 0) + coalesce(d.rank, 0)), 9) >= {SHARE}
      THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN trust{ROUNDS} t USING (host) LEFT JOIN distrust{ROUNDS} d USING (host)
"""


SQL = _sql()

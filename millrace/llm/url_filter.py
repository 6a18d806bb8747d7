"""URL filter: rules by host and path, and link-graph propagation for what no rule fits.

Hosts are the nodes. A page's links to other hosts make weighted edges from its host; links
within a host say nothing of it and make none. A host's trust seed is the share of its
pages that a rule allows, its distrust seed the share that a rule blocks.

Trust is a personalised PageRank from the trusted seeds: a host has its seed and, from
each host that links to it, ``follow`` percent of that one's trust by the share of its
links. Distrust runs the other way: a host has its seed and ``follow`` percent of the mean
distrust of what it links to. Both are x = seed + follow * W x, the usual PageRank over
(1 - follow) and over the sum of the seeds, so that a wholly blocked host has ONE at least
and the limit per host doesn't move with the size of the web. A host without links passes
nothing on; to send that back to the seeds, as is usual, would scale all scores alike.

A host whose distrust is above ``limit`` and above its trust is blocked.

Scores are integers (parts of ONE) and start from the seeds, so they only rise, sums do not
depend on their order, and reruns and other engines agree to the last digit. A flow is
floored once, when it is made, so a link of a host with many million links counts too.
Rounds go on until no host can change its verdict any more, or no score moves. What a
block of rounds adds shrinks by follow ** rounds from one block to the next: for distrust
the most that it adds to any host (a host's is a mean), for trust the sum over all hosts (a
host passes on no more than it has). That bounds what all rounds to come can add to a host,
but for the floors, a part of ONE a link; so the verdicts are those of the exact solution.

Null urls, and those without ``://``, have an empty host and path, fit no rule and are
allowed. Null html has no links, and very long html is searched whole. Repeated pages, and
rows of one page_id, count as often as they occur. Of rules of one length that fit, the
first by name wins; distrust equal to trust, or to the limit, doesn't block. An empty
table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Parts of a score, percent that is passed on, and the distrust above which a host is blocked.
ONE, FOLLOW, LIMIT = 10**9, 85, 10**9 // 2
#: Rounds of the SQL: after these, less than a hundred-thousandth of a score is missing.
SQL_ROUNDS = 72
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_fit(host: Column, path: Column, rules: tuple[Rule, ...], take: str) -> Column:
    """``take`` (name or verdict) of the longest rule that fits, else null."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, getattr(r, take)) if found is None else found.when(fits, getattr(r, take))
    return F.lit(None).cast("string") if found is None else found


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.select("page_id", "host", "path", first_fit(host, path, rules, "name").alias("rule"), first_fit(host, path, rules, "verdict").alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n, total): links from a host to another, and all of its links to others."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    absolute = links.where(full.rlike(ABSOLUTE)).select("src", host_of(full).alias("dst"))
    counted = absolute.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    counted = written(counted, "links")
    return counted.join(counted.groupBy("src").agg(F.sum("n").alias("total")), "src")


def seeds(marked: DataFrame) -> DataFrame:
    """(host, kind, seed) from judged pages, in parts of ONE."""
    n = lambda verdict: F.count(F.when(F.col("by_rule") == verdict, 1))
    by_host = marked.where("host <> ''").groupBy("host").agg(n("allow").alias("allowed"), n("block").alias("blocked"), F.count("*").alias("pages"))
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.expr(f"{c} * {ONE} div pages").alias("seed"))
    return by_host.select("host", F.explode(F.array(part("trust", "allowed"), part("distrust", "blocked"))).alias("s")).select("host", "s.*").where("seed > 0")


def propagate(edges: DataFrame, start: DataFrame, rounds: int | None = None, follow: int = FOLLOW, limit: int | None = None, save_every: int = 4) -> DataFrame:
    """(host, kind, score) after ``rounds`` steps at most; ``follow`` is in percent. With a
    ``limit`` it ends once the verdicts by that limit are certain.

    Both kinds advance in one join and one sum a round. Shuffles carry one row for an edge
    before the sum and, through the map-side combine, one for a host and task after it.
    """
    along = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n", "total")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n", "total")
    steps = written(along.unionByName(against), "steps")
    base = start.select("kind", "host", F.col("seed").alias("part"))
    saved = scores = start.select("kind", "host", F.col("seed").alias("score"))
    if steps.isEmpty():
        return scores
    flow = F.expr(f"cast(score as decimal(19,0)) * cast(n * {follow} as decimal(19,0)) div cast(total * 100 as decimal(19,0))").cast("bigint")
    for k in count(1):
        moved = steps.join(scores.select("kind", F.col("host").alias("from"), "score"), ["kind", "from"])
        summed = moved.select("kind", F.col("to").alias("host"), flow.alias("part")).unionByName(base).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        scores = summed
        if k % save_every == 0:
            scores = written(scores, f"scores{k}")
            ahead = still_to_come(scores, saved, (follow / 100) ** save_every)
            # scores never fall, so if nothing was added they have settled
            if not any(ahead.values()) or limit is not None and ahead["distrust"] <= limit and open_hosts(scores, ahead, limit).isEmpty():
                break
            saved = scores
        if k == rounds:
            break
    return scores


def still_to_come(scores: DataFrame, saved: DataFrame, kept: float) -> dict[str, int]:
    """The most that later rounds can add to a host's trust and distrust, if what ``scores``
    have above the ``saved`` ones shrinks to ``kept`` of it in as many rounds again."""
    grown = scores.join(saved.select("kind", "host", F.col("score").alias("was")), ["kind", "host"], "left").select("kind", (F.col("score") - F.coalesce("was", F.lit(0))).alias("by"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("by"))
    added = grown.agg(F.sum(of("trust").cast("decimal(38,0)")).alias("trust"), F.max(of("distrust")).alias("distrust")).first()
    return {kind: ceil(float(added[kind] or 0) * kept / (1 - kept)) for kind in ("trust", "distrust")}


def by_host(scores: DataFrame) -> DataFrame:
    """(host, trust, distrust)."""
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def open_hosts(scores: DataFrame, ahead: dict[str, int], limit: int) -> DataFrame:
    """Hosts that are neither blocked nor free whatever of ``ahead`` is still to come."""
    low, high = F.col("distrust"), F.col("distrust") + ahead["distrust"]
    blocked = (low > limit) & (low > F.col("trust") + ahead["trust"])
    return by_host(scores).where(~blocked & (high > limit) & (high > F.col("trust")))


def blocked_hosts(scores: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Hosts whose distrust is above the limit and above their trust."""
    return by_host(scores).where((F.col("distrust") > limit) & (F.col("distrust") > F.col("trust"))).select("host")


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    held = pages.select("page_id", "url", "html")
    marked = judged(held, rules)
    blocked = written(blocked_hosts(propagate(host_edges(held), written(seeds(marked), "seeds"), rounds, limit=limit), limit), "blocked")
    joined = marked.join(blocked.withColumn("bad", F.lit(True)), "host", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _sql(rounds: int = SQL_ROUNDS, follow: int = FOLLOW) -> str:
    """The same rows in DuckDB: every round is a table expression."""

    def host(url: str) -> str:
        return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"

    fit = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda take: "case " + " ".join(f"when {fit(r)} then '{getattr(r, take)}'" for r in ordered) + " end"
    link = LINK.replace("'", "''")
    ctes = [
        f"parts as materialized (select page_id, html, {host('url')} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)",
        f"marked as materialized (select page_id, host, path, {case('name')} as rule, {case('verdict')} as by_rule from parts)",
        f"links as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) as link from parts)",
        f"ends as (select src, case when starts_with(link, '//') then 'x:' || link else link end as url from links)",
        f"counted as materialized (select src, dst, count(*) as n from (select src, {host('url')} as dst from ends where regexp_matches(url, '{ABSOLUTE}')) where src <> '' and dst <> '' and src <> dst group by all)",
        "edges as (select src, dst, n::hugeint as n, (sum(n) over (partition by src))::hugeint as total from counted)",
        "steps as materialized (select 'trust' as kind, src as a, dst as b, n, total from edges union all select 'distrust', dst, src, n, total from edges)",
        f"by_host as (select host, count(*) filter (by_rule = 'allow') * {ONE} // count(*) as t, count(*) filter (by_rule = 'block') * {ONE} // count(*) as d from marked where host <> '' group by host)",
        "seeds as materialized (select 'trust' as kind, host, t as seed from by_host where t > 0 union all select 'distrust', host, d from by_host where d > 0)",
        "r0 as (select kind, host, seed as score from seeds)",
    ]
    for k in range(1, rounds + 1):
        flow = f"select s.kind, s.b as host, score * (n * {follow}) // (total * 100) as part from steps s join r{k - 1} r on s.kind = r.kind and s.a = r.host union all select kind, host, seed from seeds"
        ctes.append(f"r{k} as materialized (select kind, host, sum(part)::bigint as score from ({flow}) group by kind, host)")
    ctes.append(f"bad as (select host from (select host, coalesce(max(score) filter (kind = 'trust'), 0) as t, coalesce(max(score) filter (kind = 'distrust'), 0) as d from r{rounds} group by host) where d > {LIMIT} and d > t)")
    return "with " + ", ".join(ctes) + " select page_id, host, path, rule, coalesce(by_rule, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from marked"


ORACLE_SQL = _sql()

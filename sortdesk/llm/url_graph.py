"""Url filter: rules first, then trust and distrust spread over the host graph.

Rules (host, path) settle the pages they fit; the longest rule wins. Hosts get trust from pages
that rules allow and distrust from pages that rules block, and both spread by personalised
PageRank over host edges: trust along links from its seeds, distrust against the links. A page
without a rule is blocked if its host's distrust exceeds `ratio` times its trust.

Edges are the links in the pages' html to other hosts (absolute addresses in href or src), and
both ways between a host and its parent domain, as far as it is a host of the graph or lies
above one. Ranks are whole numbers in parts of 10 ** 15 and mass is divided with remainders
dropped, so results do not depend on the order of addition. Hosts and edges stay tables: a page
table is reduced to one row per host pair before anything is joined, and the iterations work on
written host tables.

Defined results. Null urls or urls without "://": empty host and path, no rule, allowed. Null
html: no links. Repeated rows: judged alike, and counted each. Empty table: no rows. Columns that
the filter does not read are not carried, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Fixed rules of the registered query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SCALE = 10 ** 15
#: Share of the mass that four rounds may still move, and rounds after which it is an error.
SETTLED, MOST_ROUNDS = 1e-6, 200
#: Edges of a task in the rounds. Every task of a round leaves files until the run ends, so a small
#: graph must not be dealt over as many tasks as the pages are.
EDGES_A_TASK = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
                                  _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """<rule, verdict> of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, start in reversed(ordered):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(on + start).alias("rule"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _parent(host: str) -> Column:
    """The domain above, down to two labels; null for shorter hosts and addresses."""
    h = F.col(host)
    return F.when(h.rlike(r"^[^.]+\.[^.]+\.[^.]+") & ~h.rlike(r"^[0-9.]+$"),
                  F.regexp_replace(h, r"^[^.]+\.", ""))


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, each ordered pair once."""
    links = judged.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all(
        "html", F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1)))).alias("to"))
    to = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    found = links.select(F.col("host").alias("src"), to.alias("dst")).where(
        "dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))

    hosts = judged.where("host <> ''").select("host").distinct()
    levels = F.transform(F.sequence(F.lit(0), F.size(F.split("host", r"\.")) - 2),
                         lambda i: F.array_join(F.slice(F.split("host", r"\."), i + 1, 99), "."))
    domains = hosts.where(r"host rlike '\\.' and not host rlike '^[0-9.]+$'").select(
        F.explode(levels).alias("host")).distinct()
    family = domains.withColumn("up", _parent("host")).where("up is not null")
    up = family.select(F.col("host").alias("src"), F.col("up").alias("dst"))
    down = family.select(F.col("up").alias("src"), F.col("host").alias("dst"))
    return found.unionByName(up.unionByName(down).withColumn("n", F.lit(1).cast("long"))).groupBy(
        "src", "dst").agg(F.sum("n").alias("n"))


def _in_tasks(df: DataFrame, edges: int) -> DataFrame:
    """df in no more tasks than a graph of so many edges calls for; a large one stays as dealt."""
    return df.coalesce(max(1, -(-edges // EDGES_A_TASK)))


def _moved(before: DataFrame, rank: DataFrame, edges: int) -> int:
    """Parts of the mass by which the ranks of either kind differ, the larger of both."""
    differ = before.unionByName(rank.withColumn("rank", -F.col("rank"))).groupBy(
        "kind", "host").agg(F.abs(F.sum("rank")).alias("d"))
    return _in_tasks(differ, edges).groupBy("kind").agg(F.sum("d").alias("d")).agg(
        F.max("d")).first()[0] or 0


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85,
              settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of both kinds, in one run of joins.

    seeds: (host, trust, distrust) page counts. Distrust takes every edge backwards. Rounds go on
    until four of them move no more than the share `settled` of the mass of either kind; a damping
    with which MOST_ROUNDS do not settle them is an error.
    """
    keep = int(round(damping * 100))
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "n").withColumn(
        "kind", F.lit("distrust")))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = written(both.join(out, ["kind", "src"]), "host-edges")
    n_edges = both.count()

    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("n")),
                              F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("n"))))
    base = seeds.select("host", kinds.alias("s")).select("host", "s.*").where("n > 0")
    total = base.groupBy("kind").agg(F.sum("n").alias("all"))
    base = written(base.join(total, "kind").select("kind", "host", F.expr(
        f"cast(n * cast({SCALE} as decimal(20,0)) div all as bigint)").alias("base")), "host-seeds")

    rank = before = base.withColumnRenamed("base", "rank")
    for i in range(MOST_ROUNDS):
        share = F.expr(f"cast(cast(rank as decimal(20,0)) * n * {keep} div (total * 100) as bigint)")
        moved = rank.withColumnRenamed("host", "src").join(both, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), share.alias("part"))
        start = base.select("kind", "host", F.expr(f"base * {100 - keep} div 100").alias("part"))
        rank = _in_tasks(moved.unionByName(start), n_edges).groupBy("kind", "host").agg(
            F.sum("part").alias("rank"))
        if i % 4 == 3:
            rank = written(_in_tasks(rank, n_edges), "host-ranks")
            if _moved(before, rank, n_edges) <= settled * SCALE:
                break
            before = rank
    else:
        raise ArithmeticError(f"ranks still move after {MOST_ROUNDS} rounds")
    return rank.groupBy("host").agg(
        F.coalesce(F.max(F.expr("if(kind = 'trust', rank, null)")), F.lit(0)).alias("trust"),
        F.coalesce(F.max(F.expr("if(kind = 'distrust', rank, null)")), F.lit(0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, ratio: float = 1.0, id_col: str = "page_id",
                url_col: str = "url", html_col: str = "html",
                settled: float = SETTLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    url = F.col(url_col).cast("string")
    judged = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.col(html_col).cast("string").alias("html"))
    ruled = F.expr("found.verdict")
    judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count_if(ruled == "allow").alias("trust"), F.count_if(ruled == "block").alias("distrust"))
    ranks = propagate(host_edges(judged), seeds, settled=settled)
    verdicts = written(seeds.select("host").join(ranks, "host", "left").select(
        "host", F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust")), "hosts")
    spread = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return judged.join(verdicts, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), spread).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"))

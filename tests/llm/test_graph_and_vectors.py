"""Url filter and neighbour search against brute force on small tables."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sortdesk.llm import components, neighbours, url_graph
from sortdesk.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.01"


# url filter

def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[:min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_graph.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.net/es/1?x#y", "HTTPS://WWW.Example.com/en/2", "https://example.com/en/",
        "https://sub.example.com/en", "ftp://net/fr/", "nothing", None, "", "http://", "://x.com",
        "http://b.org?u=http://c.com/", "http://x.org/p#f", "http://Ä.com/ü", "http://notcom/en/",
        "http://a.com://b/en/"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)],
                                  "page_id long, url string, html string")
    for r in url_graph.filter_urls(pages).collect():
        host, path = split(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        name, verdict = rule(host, path)
        assert r.rule == name
        assert verdict is None or r.verdict == verdict


def spread(edges, base, rounds=400, keep=85):
    total = defaultdict(int)
    for (a, _), n in edges.items():
        total[a] += n
    all_mass = sum(base.values())
    start = {h: n * url_graph.SCALE // all_mass for h, n in base.items() if n}
    rank = dict(start)
    for _ in range(rounds):
        new = defaultdict(int)
        for (a, b), n in edges.items():
            if a in rank:
                new[b] += rank[a] * n * keep // (total[a] * 100)
        for h, n in start.items():
            new[h] += n * (100 - keep) // 100
        rank = {h: n for h, n in new.items()}
    return rank


def near(got, want):
    return abs(got - want) < 2e-6 * url_graph.SCALE


def test_propagation_matches_a_plain_walk(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.org" for i in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randint(1, 5) for _ in range(40)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = [(h, rng.randint(0, 3), rng.randint(0, 2)) for h in hosts]
    got = {r.host: r for r in url_graph.propagate(
        spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"),
        spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    trust = spread(edges, {h: t for h, t, _ in seeds})
    distrust = spread({(b, a): n for (a, b), n in edges.items()}, {h: d for h, _, d in seeds})
    assert set(trust) | set(distrust) <= set(got) | {h for h in hosts if not trust.get(h)}
    for h, r in got.items():
        assert near(r.trust, trust.get(h, 0)) and near(r.distrust, distrust.get(h, 0))


def test_ranks_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(url_graph, "MOST_ROUNDS", 8)
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1, 0)], "host string, trust long, distrust long")
    with pytest.raises(ArithmeticError):
        url_graph.propagate(edges, seeds)


def test_verdicts_of_settled_ranks(spark):
    """A parent and 20 children: 12 rounds allow an unseeded child, settled ranks block it."""
    hosts = [f"c{i}.farm.org" for i in range(20)]
    pages = [(i, f"http://{h}/", "") for i, h in enumerate(hosts)] + [
        (20, "http://farm.org/bad", ""), (21, "http://farm.org/", "")]
    rules = [("allow", h, "/") for h in hosts[:10]] + [("block", "farm.org", "/bad")]
    got = {r.page_id: r for r in url_graph.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    edges = {e: 1 for h in hosts for e in ((h, "farm.org"), ("farm.org", h))}
    trust = spread(edges, {h: 1 for h in hosts[:10]})
    distrust = spread(edges, {"farm.org": 1})
    for i, h in enumerate([*hosts, "farm.org", "farm.org"]):
        assert near(got[i].trust, trust[h]) and near(got[i].distrust, distrust[h])
        if got[i].rule is None:
            assert got[i].verdict == ("block" if distrust[h] > trust[h] else "allow")
    early = [spread(edges, base, 12)["c15.farm.org"]
             for base in ({"farm.org": 1}, {h: 1 for h in hosts[:10]})]
    assert early[0] < early[1] and got[15].verdict == "block"


def test_registered_query_settles(spark, tmp_path):
    """Two trusted sites link to two of four children of a blocked parent: 12 rounds block an
    unlinked child, settled ranks allow it; the check statement agrees."""
    kids = [f"c{i}.farm.net" for i in range(4)]
    pages = [(i, f"http://h{i}.com/", f'<a href="http://{kids[i]}/">x</a>') for i in range(2)] + [
        (10 + i, f"http://{h}/", None) for i, h in enumerate(kids)] + [
        (20, "http://farm.net/es/bad", ""), (21, "http://farm.net/", "")]
    edges = {e: 1 for h in kids for e in ((h, "farm.net"), ("farm.net", h))}
    edges |= {(f"h{i}.com", kids[i]): 1 for i in range(2)}
    back = {(b, a): n for (a, b), n in edges.items()}
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(
        f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in QUERIES["op1_link_graph"](spark, str(tmp_path)).collect()}
    verdicts = {}
    for rounds in (12, 400):
        trust = spread(edges, {"h0.com": 1, "h1.com": 1}, rounds)
        distrust = spread(back, {"farm.net": 1}, rounds)
        verdicts[rounds] = {10 + i: "block" if distrust[h] > trust.get(h, 0) else "allow"
                            for i, h in enumerate(kids)}
    assert verdicts[12] != verdicts[400]
    assert {i: got[i] for i in verdicts[400]} == verdicts[400]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    plain = con.execute(f"select page_id, verdict from ({CHECKS['op1_link_graph']})").fetchall()
    assert dict(plain) == got


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = '<a href="http://bad.example.net/es/1">x</a><img src="//bad.example.net/i.png">'
    pages = spark.createDataFrame(
        [(1, "http://bad.example.net/es/1", ""), (2, "http://farm.org/x", link),
         (3, "http://plain.org/x", '<a href="/local">x</a>'), (4, "http://good.example.com/", None),
         (5, "http://farm.org/x", link), (5, "http://farm.org/x", link)],
        "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_graph.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}
    assert url_graph.filter_urls(pages).count() == 6
    assert url_graph.filter_urls(pages.limit(0)).count() == 0


# components

@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(300)],
             "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
             "none": [(1, 1)]}[kind]
    got = {r.v: r.root for r in components.roots(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x, r in got.items():
        groups[r].add(x)
    wanted = defaultdict(set)
    for x in parent:
        wanted[find(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in wanted.values() if len(g) > 1)


# neighbours

def cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / (
        math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))


def test_recall_and_scores_on_given_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0"), k=5).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    hit = total = 0
    for q in sorted(i for i in x if i % 10 == 0):
        best = sorted((-cosine(x[q].tolist(), v.tolist()), i) for i, v in x.items() if i != q)[:5]
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, len(mine) + 1))
        for r in mine:
            assert r.score == pytest.approx(cosine(x[q].tolist(), x[r.vec_id].tolist()), abs=1e-12)
        hit += len({i for _, i in best} & {r.vec_id for r in mine})
        total += 5
    assert hit / total >= 0.9


def test_hot_buckets_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, (base + rng.standard_normal(8) * 0.01).tolist()) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, vectors.where("vec_id < 20"), k=4, setting=neighbours.Setting(hashes=2))
    by = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        by[r.query_id].append(r.vec_id)
    for q in range(20):
        assert by[q] == [i for _, i in sorted((-cosine(rows[q][1], v), i) for i, v in rows if i != q)[:4]]


def test_ties_of_thousands_of_equal_vectors_go_to_the_least_ids(spark):
    """Over blocks of many shapes, which round the same product differently."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64).tolist()
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame([(i, base) for i in range(5000)], schema)
    asked = spark.createDataFrame(
        [(i, base) for i in (0, 3, 4999)]
        + [(10_000 + i, rng.standard_normal(64).tolist()) for i in range(600)], schema)
    by = defaultdict(list)
    for r in neighbours.nearest(vectors, asked, k=5, setting=neighbours.Setting(hashes=1)).orderBy("query_id", "rank").collect():
        by[r.query_id].append(r.vec_id)
    assert len(by) > 500
    for q, found in by.items():
        assert found == [i for i in range(6) if i != q][:5]


def test_equal_directions_of_many_lengths_are_ranked_by_the_exact_score(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(64)
    rows = [(i, (base * rng.uniform(0.1, 9)).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=5)
    by = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        by[r.query_id].append((r.vec_id, r.score))
    x = vectors.where("vec_id % 100 = 0").alias("q").join(vectors.alias("v"), F.expr(
        "q.vec_id <> v.vec_id")).selectExpr("q.vec_id as q", "v.vec_id as v", """
        aggregate(zip_with(q.embedding, v.embedding, (a, b) -> a * b), 0d, (s, v) -> s + v)
        / (sqrt(aggregate(q.embedding, 0d, (s, v) -> s + v * v))
           * sqrt(aggregate(v.embedding, 0d, (s, v) -> s + v * v))) as score""").collect()
    for q in range(0, 1500, 100):
        assert by[q] == sorted(((r.v, r.score) for r in x if r.q == q), key=lambda p: (-p[1], p[0]))[:5]


def test_queries_that_meet_too_few_candidates_get_all_there_are(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 7)
    rng = np.random.default_rng(8)
    near = rng.standard_normal(16)
    rows = [(i, (near + rng.standard_normal(16) * 0.01).tolist()) for i in range(40)]
    rows += [(40, (-near).tolist()), (41, (-near).tolist())]
    rows += [(i, rng.standard_normal(16).tolist()) for i in range(42, 50)]
    few = [(i, x) for i, x in enumerate(np.vstack([np.eye(4), -np.eye(4)[:1]]).tolist())]
    for table in (rows, few):
        vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        by = defaultdict(list)
        for r in neighbours.nearest(vectors, vectors, k=5).orderBy("query_id", "rank").collect():
            by[r.query_id].append((r.vec_id, r.score))
        for q, x in table:
            others = [(-cosine(x, v), i) for i, v in table if i != q]
            assert len(by[q]) == min(5, len(others))
            if q in (40, 41) or table is few:
                assert [i for i, _ in by[q]] == [i for _, i in sorted(others)[:5]]


def clustered(n, seed, size=40, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x, queries, k=5):
    near = [x[np.argsort(-(x @ x[q]), kind="stable")[1:k + 1]] for q in range(queries)]
    return neighbours.fitted(x[-neighbours.FIT_ROWS:], x[:queries], near, len(x), len(x) // 50, 5)


def test_candidates_grow_more_slowly_than_a_clustered_table():
    small, large = (fit(clustered(n, 3), 40) for n in (2000, 32_000))
    assert small.recall >= neighbours.FIT_RECALL <= large.recall
    assert large.share * 32_000 < 8 * small.share * 2000
    assert large.share < 0.25


def test_recall_of_fitted_settings_in_clusters(spark):
    x = clustered(4000, 7)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                    "vec_id long, embedding array<double>").repartition(8)
    by = defaultdict(set)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 40 = 0"), k=5).collect():
        by[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 4000, 40):
        score = x @ x[q]
        score[q] = -2
        hit += len(by[q] & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert hit >= 0.9 * 5 * 100


def test_probes_come_in_the_order_of_estimated_success():
    hashing = neighbours.Hashing(6, 2, 3, 1.5, 20, 1)
    places = np.random.default_rng(2).normal(0, 3, (2, 4, 3))
    got = hashing.probe(places)
    low = np.floor(places)
    for t in range(2):
        for q in range(4):
            moves = [m for m in np.ndindex(3, 3, 3)]
            cost = lambda m: sum((places[t, q, i] - low[t, q, i]) ** 2 if s == 0 else
                                 (low[t, q, i] + 1 - places[t, q, i]) ** 2 if s == 2 else 0
                                 for i, s in enumerate(m))
            want = sorted(moves, key=cost)[:20]
            assert [tuple(int(v) for v in row) for row in got[t, q]] == [
                tuple(int(low[t, q, i] + s - 1) for i, s in enumerate(m)) for m in want]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]),
            (1, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "id", F.lit("clash")).withColumn("vector", F.lit("clash"))
    got = neighbours.nearest(vectors, vectors, k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)]
    assert neighbours.nearest(vectors.limit(0), vectors).count() == 0
    assert neighbours.nearest(vectors, vectors.limit(0)).count() == 0


def test_rounds_over_a_small_graph_leave_few_files(spark, monkeypatch):
    """However many partitions the tables are dealt over: every task of a round leaves files."""
    files, plain = [], url_graph.written

    def written(df, what):
        out = plain(df, what)
        if what == "host-ranks":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(url_graph, "written", written)
    edges = spark.range(150).selectExpr(
        "concat('h', id) as src", "concat('h', id * 7 % 150 + 1) as dst", "1L as n")
    seeds = spark.range(150).selectExpr("concat('h', id) as host", "id % 3 as trust", "id % 2 as distrust")
    settings = {"spark.sql.shuffle.partitions": "12",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = url_graph.propagate(edges, seeds, damping=0.5, settled=0.1).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and set(files) == {1} and got > 100

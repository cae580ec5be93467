"""Simhash groups against all pairs on small tables, and the parts they are made of."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from edge import ROWS, documents, empty

from sortdesk.llm import fingerprints as fp
from sortdesk.llm.queries import QUERIES


def plain_fingerprint(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)][:len(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_groups(rows, k, distance):
    """{id: least id reachable}, rows of one id being one document."""
    prints = [(i, plain_fingerprint(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2)
             if a == b or (x ^ y).bit_count() <= distance]
    return components({i for i, _ in prints}, links)


def near(prints, distance):
    at = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(at, 1)))))


def clustered(n, seed, flips=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 63, size=max(n // 20, 1), dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(flips):
        bit = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        out = out ^ bit * (rng.random(n) < 0.6).astype(np.uint64)
    return np.unique(out)


def linked(spark, prints, distance):
    """Components of the found links, as positions in prints."""
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    links = [(place[r.u], place[r.v]) for r in fp.hamming_links(table, distance).collect()]
    return components(range(len(prints)), links)


def edited(seed, n, size):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(size)] = f"w{rng.randrange(400)}"
        out.append(" ".join(words) if rng.random() < 0.8 else " ".join(words[:rng.randint(0, 9)]))
    return out


def test_groups_match_all_pairs(spark):
    rows = list(enumerate(edited(1, 60, 300) + edited(2, 60, 120) + ["", " ", None, "A b", "a  B"]))
    got = fp.fingerprint_groups(documents(spark, rows), shingle=3).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {
        i: f"{plain_fingerprint(t, 3):016x}" for i, t in rows}
    want = plain_groups(rows, 3, 3)
    assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < len(rows) - 20


def test_registered_query_on_a_fixture(spark, tmp_path):
    rows = list(enumerate(edited(3, 40, 200))) + [(100, "x"), (101, "X")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_generalised_pigeonhole"](spark, str(tmp_path)).collect()
    want = plain_groups(rows, 3, 3)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (i, f"{plain_fingerprint(t, 3):016x}", want[i]) for i, t in rows)


def test_awkward_rows(spark):
    for k in (3, 5):
        got = fp.fingerprint_groups(documents(spark), shingle=k).collect()
        want = plain_groups(ROWS, k, 3)
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got) == sorted(
            (i or -1, f"{plain_fingerprint(t, k):016x}", want.get(i, -1)) for i, t in ROWS)
    assert fp.fingerprint_groups(empty(spark)).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (9, "q r s t u v"), (7, "a b c d e f"), (8, "zz")]
    got = {r.doc_id: r.component_id for r in fp.fingerprint_groups(
        documents(spark, rows), shingle=3).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 8: 8}


@pytest.mark.parametrize("partitions", [2, 3, 4, 5])
def test_links_with_any_number_of_partitions(spark, monkeypatch, partitions):
    monkeypatch.setattr(fp, "partitions_for", lambda n, d: partitions)
    prints = clustered(1500, partitions)
    assert linked(spark, prints, 3) == components(range(len(prints)), near(prints, 3))


@pytest.mark.parametrize("distance", [1, 2, 5])
def test_other_distances(spark, distance):
    prints = clustered(400, distance)
    assert linked(spark, prints, distance) == components(range(len(prints)), near(prints, distance))


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    """All fingerprints share three of four quarters: whole buckets, cut into blocks."""
    monkeypatch.setattr(fp, "BLOCK", 16)
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 2 ** 16, 700, dtype=np.uint64) + np.uint64(7 << 40))
    assert linked(spark, prints, 3) == components(range(len(prints)), near(prints, 3))


def test_thresholds_sum_and_cost_least():
    rng = np.random.default_rng(5)
    costs = np.concatenate([np.zeros((4, 1, 30)), np.cumsum(rng.random((4, 4, 30)), axis=1)], axis=1)
    got = fp.allocated(costs, 0)
    assert (got.sum(axis=1) == 0).all()
    for row in range(30):
        best = min(sum(costs[p, t + 1, row] for p, t in enumerate(choice))
                   for choice in itertools.product(range(-1, 4), repeat=4) if sum(choice) == 0)
        assert abs(sum(costs[p, t + 1, row] for p, t in enumerate(got[row])) - best) < 1e-12


def test_shells_count_every_distance():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, 64).astype(float)
    found = fp.shells(counts, 3)
    for value in range(64):
        for e in range(4):
            assert found[e, value] == sum(c for v, c in enumerate(counts) if (v ^ value).bit_count() == e)


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 40:56] = bits[:, :16] ^ (rng.random((2000, 16)) < 0.05)
    groups = fp.grouped_bits(np.corrcoef(bits.T), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    for pair in range(16):
        assert sum(pair in g and pair + 40 in g for g in groups) == 1


def test_wide_partitions_in_large_tables():
    assert [fp.partitions_for(n, 3) for n in (10 ** 4, 10 ** 9, 10 ** 11)] == [4, 2, 2]

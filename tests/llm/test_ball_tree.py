"""Ranked search over ball trees against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import ROWS, documents, empty

from sortdesk.llm import ball_tree as B


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=10):
    """[(item, rank, id, score)] by brute force; every row is a document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, q in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (
            x[0], x[1], x[2] or 0))[:k])]
    return out


def corpus(seed, n, vocabulary=300):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            out.append(rng.choice(out))          # copies tie
        else:
            out.append(" ".join(f"Wort{t}" for t in rng.choices(
                range(vocabulary), weights, k=rng.randint(0, 60))))
    return list(enumerate(out))


def questions(seed, n, vocabulary=320):
    rng = random.Random(seed)
    return [(i, " ".join(f"wort{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 25))))
            for i in range(n)]


def ranked(spark, docs, items, **settings):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = B.rank_documents(documents(spark, docs), asked, **settings).collect()
    return sorted((r.item_id if r.item_id is not None else -1, r["rank"], r.doc_id, r.score) for r in got)


def wanted(docs, items, **settings):
    return sorted((i if i is not None else -1, r, d, s) for i, r, d, s in plain(docs, items, **settings))


@pytest.mark.parametrize("k", [1, 10])
def test_ranks_match_plain_scores(spark, monkeypatch, k):
    monkeypatch.setattr(B, "BLOCK", 64)
    docs, items = corpus(1, 500), questions(2, 40)
    assert ranked(spark, docs, items, k=k) == wanted(docs, items, k=k)


def test_questions_in_groups_and_blocks_cut_by_entries(spark, monkeypatch):
    monkeypatch.setattr(B, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(B, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(B, "ROOTS_TOGETHER", 2)
    monkeypatch.setattr(B, "FIRST_BLOCKS", 1)
    docs, items = corpus(3, 150), questions(4, 30)
    assert ranked(spark, docs, items) == wanted(docs, items)


def test_a_crowded_bitmap_only_passes_more(spark, monkeypatch):
    monkeypatch.setattr(B, "BITMAP_BITS", 18)
    docs, items = corpus(5, 80, 2000), questions(6, 10, 2000)
    assert ranked(spark, docs, items) == wanted(docs, items)


def test_thousands_of_copies_keep_the_least_ids(spark):
    docs = [(i, "alpha beta") for i in range(3000, 0, -1)] + [(5000, "alpha alpha beta"), (5001, "gamma")]
    items = [(1, "alpha"), (2, "beta gamma")]
    assert ranked(spark, docs, items) == wanted(docs, items)


def test_awkward_rows(spark):
    items = [(1, "the quick FOX"), (2, None), (3, ""), (4, "w5 w6 zzz"), (None, "no id"), (5, "é été 漢字 mit"),
             (6, "the the the of"), (1, "the quick FOX"), (7, "a" * 5000)]
    once = list(dict(items).items())
    assert ranked(spark, ROWS, items) == wanted(ROWS, once)
    assert ranked(spark, [], items) == [] == ranked(spark, ROWS, [])
    assert B.rank_documents(empty(spark), spark.createDataFrame(items[1:3], "item_id long, text string")).count() == 0


def test_bounds_hold_at_every_node():
    """No document below a node scores more than its bound, and the search finds the best ones."""
    rng = np.random.default_rng(7)
    lists, values = [], []
    for _ in range(200):
        some = rng.choice(400, rng.integers(1, 60), replace=False)
        lists.append([f"t{i}" for i in some])
        values.append(rng.integers(1, 10 ** 6, len(some)).tolist())
    table = pa.table({"id": pa.array(range(200)), "terms": pa.array(lists), "values": pa.array(values)})
    block = B.Block(pa.Table.from_batches([B._block(table, 3)]))
    weights = [dict(zip(rng.choice(420, 12, replace=False).tolist(), rng.integers(1, 20000, 12).tolist()))
               for _ in range(50)]
    asked = B.Questions(pa.table({
        "q": pa.array(range(50)), "terms": pa.array([[f"t{t}" for t in w] for w in weights]),
        "weights": pa.array([list(w.values()) for w in weights])}))
    scores = np.array([[sum(w.get(int(t[1:]), 0) * v for t, v in zip(ts, vs))
                        for ts, vs in zip(lists, values)] for w in weights])
    by_place = scores[:, block.ids.to_numpy()]
    bounds = block.bounds(asked, *asked.within(block.vocabulary))
    for node, (a, b) in enumerate(block.spans):
        assert (bounds[:, node] >= by_place[:, a:b].max(axis=1)).all()
    assert sorted(block.ids.to_pylist()) == list(range(200))
    q, place, score, scored = block.search(asked, np.ones(50, np.int64), 5)
    for i in range(50):
        best = np.sort(by_place[i])[::-1][:5]
        assert sorted(score[q == i], reverse=True)[:5] == best[best > 0].tolist()
        assert (by_place[i, place[q == i]] == score[q == i]).all()
    assert scored < 50 * 200


def test_same_spans_for_the_same_number():
    for n in (1, 2, 8, 9, 100, 512):
        spans = B.node_spans(n)
        leaves = spans[len(spans) // 2:]
        assert leaves[0][0] == 0 and leaves[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
        assert all(0 < b - a <= B.LEAF for a, b in leaves)

"""Top-k of many questions against brute force, and what the bounds leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortdesk.operators import retrieval as H


def words(rng, n, kinds=60):
    return [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in
            (min(int(rng.expovariate(0.08)), kinds - 1) for _ in range(n))]


def lexical(docs, asked, k):
    held = [(place, set(text.split())) for place, text in docs]
    n = len(held)
    df = {}
    for _, s in held:
        for w in s:
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in asked:
        scored = [(-round(sum(1 / (1 + df[w] / n) for w in set(text.split()) & s), 9), *place)
                  for place, s in held if set(text.split()) & s]
        out += [(q, *place, -s, r + 1) for r, (s, *place) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits, first, k", [(0, 1, 3), (3, 1, 5), (8, 2, 3)])
def test_lexical_topk_of_many_questions(spark, bits, first, k):
    rng = random.Random(bits)
    docs = [((f"d{i % 90}", i // 90), " ".join(words(rng, rng.randint(1, 12)))) for i in range(270)]
    asked = [(f"q{i}", " ".join(words(rng, rng.randint(0, 9)))) for i in range(80)] + [("one", "wortaa")]
    chunks = spark.createDataFrame([(*p, t) for p, t in docs], "doc_id string, chunk_pos long, text string")
    q = spark.createDataFrame(asked, "query_id string, text string")
    got = H.lexical_topk(q, chunks, k, block_bits=bits, first_blocks=first).collect()
    assert sorted((r.query_id, r.doc_id, r.chunk_pos, round(r.score, 9), r["rank"]) for r in got) == lexical(
        docs, asked, k)


def test_lexical_topk_of_nothing(spark):
    chunks = spark.createDataFrame([("d", 0, "wortaa"), ("d", 1, None)], "doc_id string, chunk_pos long, text string")
    q = spark.createDataFrame([(1, None), (2, ""), (None, "wortaa"), (3, "wortzz")], "query_id long, text string")
    assert H.lexical_topk(q, chunks).collect() == []
    assert H.lexical_topk(q, chunks.limit(0)).collect() == []
    assert H.lexical_topk(q.limit(0), chunks).collect() == []


def nearest(vectors, asked, k, exclude_self=False):
    out = []
    for q, x in asked:
        d = sorted((round(float(((np.array(v) - np.array(x)) ** 2).sum()), 9), i) for i, v in vectors
                   if not (exclude_self and i == q))
        out += [(q, i, s, r + 1) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def tables(spark, vectors, asked):
    return (spark.createDataFrame(asked, "query_id string, embedding array<double>"),
            spark.createDataFrame(vectors, "vec_id string, embedding array<double>"))


def clusters(seed, n, d, many=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((many, d)) * 8
    return [(f"v{i:04}", (centres[i % many] + rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("cell_rows, floats", [(10_000, 1 << 20), (25, 60), (5, 12)])
def test_vector_topk_in_clusters(spark, cell_rows, floats):
    vectors = clusters(1, 300, 6)
    vectors += [(f"w{i}", vectors[0][1]) for i in range(9)]          # ties
    asked = [(i.replace("v", "q"), v) for i, v in vectors[:40]] + [("far", [1e3] * 6), ("v0001", vectors[1][1])]
    q, v = tables(spark, vectors, asked)
    for alone in (False, True):
        got = H.vector_topk(q, v, 4, exclude_self=alone, cell_rows=cell_rows, block_floats=floats).collect()
        assert sorted((r.query_id, r.vec_id, round(r.distance, 9), r["rank"]) for r in got) == nearest(
            vectors, asked, 4, alone)


def test_bounds_leave_out_far_cells(spark, monkeypatch):
    """In separate clusters a question meets few cells, and all of them in noise."""
    met = []
    whole = H._Meeting.meet

    def counted(self, vectors, asked):
        met.append(asked.count())
        return whole(self, vectors, asked)
    monkeypatch.setattr(H._Meeting, "meet", counted)
    vectors = clusters(2, 600, 6)
    q, v = tables(spark, vectors, vectors[:100])
    H.vector_topk(q, v, 3, cell_rows=10).collect()
    assert met[0] == 100 and met[1] < 0.4 * 100 * 60


def test_repeated_questions_and_empty_tables(spark):
    vectors = clusters(3, 20, 3)
    asked = [("a", vectors[0][1]), ("a", vectors[0][1]), ("b", None), (None, vectors[0][1]), ("c", [1.0])]
    q, v = tables(spark, vectors, asked)
    got = H.vector_topk(q, v, 2).collect()
    assert {r.query_id for r in got} == {"a"} and {r.vec_id for r in got} == {"v0000"}
    assert H.vector_topk(q.limit(0), v, 2).collect() == []
    assert H.vector_topk(q, v.limit(0), 2).collect() == []
    wide = v.withColumn("cell", F.lit("clash")).withColumn("away", F.lit("clash"))
    assert H.vector_topk(q, wide, 2).count() == 2

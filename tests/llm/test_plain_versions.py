"""The shuffle and the classifier chain against plain versions on small tables."""

import re
from collections import Counter

import numpy as np
from edge import documents
from pyspark.sql import functions as F

from sortdesk.llm import sharding, toxicity
from sortdesk.llm.queries import QUERIES


# --- shuffle -------------------------------------------------------------------------------
def java_permutation(n, seed):
    """Fisher-Yates from the inside out, with the draws of a Mersenne twister seeded as Java's."""
    draw = np.random.RandomState(np.array([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF]))
    bits = lambda: int(draw.randint(0, 1 << 32, dtype=np.uint32)) >> 1

    def below(m):
        if m & -m == m:
            return m * bits() >> 31
        while True:
            x = bits()
            if x - x % m + m - 1 < 1 << 31:
                return x % m
    out = [0] * n
    for i in range(n):
        j = below(i + 1)
        out[i] = out[j]
        out[j] = i
    return out


def plain_shards(spark, docs, shards, seed=17):
    """{row: (shard, slot)} of a table that fits one bucket."""
    marked = docs.withColumn("at", F.monotonically_increasing_id()).select("at", F.xxhash64(
        F.lit(seed), "doc_id", "text", "at").alias("scatter")).collect()
    order = [r["at"] for r in sorted(marked, key=lambda r: r.scatter)]
    places = java_permutation(len(order), seed)
    return {at: (p % shards, p // shards) for at, p in zip(order, places)}


def test_shards_of_a_plain_shuffle(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}") for i in range(300)], extra=False).coalesce(1)
    want = plain_shards(spark, docs, 16)
    got = {r.doc_id: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs).collect()}
    assert got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    place = {r["at"]: r.doc_id for r in stored.withColumn("at", F.monotonically_increasing_id()).collect()}
    want = {place[at]: x for at, x in plain_shards(spark, stored, 16).items()}
    rows = QUERIES["op3_two_pass_shuffle"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["shard"], r["slot"]) for r in rows} == want


# --- chain ---------------------------------------------------------------------------------
def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    raw = text.encode()
    count = lambda test: sum(map(test, raw)) / max(len(raw), 1)
    mark = lambda b: 0x20 < b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x7F
    form = [count(mark), count(lambda b: 0x41 <= b <= 0x5A), count(lambda b: 0x30 <= b <= 0x39),
            len(set(words)) / max(len(words), 1), np.log1p(len(words)) / 10]
    return set(words), form


def plain_model(sets, dense, y, rows):
    """p(row) of all rows from a ridge logistic model of words picked by chi-square."""
    n, positive = len(rows), y[rows].sum()
    seen = Counter(w for r in rows for w in sets[r])
    hit = Counter(w for r in rows if y[r] for w in sets[r])
    chi = {w: (hit[w] - c * positive / n) ** 2 / max(c * positive / n * (1 - positive / n) * (1 - c / n), 1e-12)
           for w, c in seen.items() if c >= toxicity.MIN_ROWS and c < n}
    chosen = sorted(w for w, x in chi.items() if x >= toxicity.MIN_CHI_SQUARE)
    assert len(chosen) <= toxicity.MAX_WORDS
    x = np.array([[w in s for w in chosen] + list(d) + [1.0] for s, d in zip(sets, dense)], float)
    hold = np.diag([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
    weights = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x[rows] @ weights))
        gradient = x[rows].T @ (p - y[rows]) + hold @ weights
        step = np.linalg.solve((x[rows].T * (p * (1 - p))) @ x[rows] + hold, -gradient)
        weights += np.clip(step, -4, 4)
    return 1 / (1 + np.exp(-x @ weights))


def plain_chain(texts, targets):
    """(rows x categories) probabilities of the texts that the chain is trained on."""
    sets, dense = zip(*map(plain_features, texts))
    dense, fold = np.array(dense), np.arange(len(texts)) % toxicity.FOLDS
    for_training, for_scoring, out = dense, dense, []
    for y in targets.T.astype(float):
        held = np.zeros(len(texts))
        for f in range(toxicity.FOLDS):
            held[fold == f] = plain_model(sets, for_training, y, np.flatnonzero(fold != f))[fold == f]
        both = plain_both(sets, for_training, for_scoring, y)
        for_training = np.hstack([for_training, held[:, None]])
        for_scoring = np.hstack([for_scoring, both[:, None]])
        out.append(both)
    return np.array(out).T


def plain_both(sets, trained, scored, y):
    """Fitted on out-of-fold columns, applied to those of the models themselves."""
    n = len(y)
    return plain_model(list(sets) * 2, np.vstack([trained, scored]), np.concatenate([y, y]),
                       np.arange(n))[n:]


def test_chain_of_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(160):
        junk, toxic = int(rng.random() < 0.4), int(rng.random() < 0.3)
        words = [f"w{j}" for j in rng.integers(0, 60, 40)]
        words += [f"junk{j}" for j in rng.integers(0, 5, 3 * junk)] + [f"vile{j}" for j in rng.integers(0, 4, 2 * toxic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + "!" * (3 * junk)))
        labels.append((i, 1 - junk, toxic))
    targets = np.array([[1 - q, t] for _, q, t in labels])
    want = plain_chain([t for _, t in rows], targets)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    got = sorted(QUERIES["op2_classifier_chain"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    found = np.array([[r.p_junk, r.p_toxic] for r in got])
    assert np.abs(found - want).max() < 0.01
    assert ((found > 0.5) == (targets == 1)).mean() > 0.9

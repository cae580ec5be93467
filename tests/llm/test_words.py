"""Hashes of words and runs: right arithmetic, and no words built to share one."""

import numpy as np
import pyarrow as pa
from edge import documents

from sortdesk.llm import near_duplicates, repeats, toxicity
from sortdesk.llm import words as W


def thue_morse(k, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << k))


def test_products_and_powers_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, W._PRIME, 5000, dtype=np.uint64) for _ in range(2))
    a[:4], b[:4] = [0, W._PRIME - 1, 1, W._PRIME - 1], [W._PRIME - 1, W._PRIME - 1, W._PRIME - 1, 1]
    assert W._product(a, b).tolist() == [x * y % W._PRIME for x, y in zip(a.tolist(), b.tolist())]
    x = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    x[:3] = [2 ** 64 - 1, W._PRIME, 2 * W._PRIME]
    assert W._reduced(x).tolist() == [y % W._PRIME for y in x.tolist()]
    for n in (0, 1, 2, 3, 64, 777):
        assert W.powers(W._STEP, n).tolist() == [pow(W._STEP, i, W._PRIME) for i in range(max(n, 1))]


def test_equal_runs_have_equal_hashes_and_others_differ():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    h[100:200] = h[300:400]
    spans = W.Spans(h)
    found = spans.hash(np.arange(490), 10)
    assert (found[100:191] == found[300:391]).all() and len(np.unique(found)) == 490 - 91
    assert len(W.Spans(h[:0]).hash(np.zeros(0, np.int64), 3)) == 0


def test_thue_morse_words_and_runs_differ():
    for k in range(1, 15):
        for letters in ("ab", "aq", "\x01\x7f"):
            both = W.cut(pa.array([f"{thue_morse(k, letters)} {thue_morse(k, letters[::-1])}"])).hash
            assert both[0] != both[1]
    for k in range(1, 14):
        text = " ".join(thue_morse(k)) + " " + " ".join(thue_morse(k, "ba"))
        found = W.Spans(W.cut(pa.array([text])).hash).hash(np.array([0, 1 << k]), 1 << k)
        assert found[0] != found[1]


def test_same_words_in_slices_of_any_size():
    text = "ab " * 300_000 + "x" * 5000 + " " + "é" * 200 + " tail"
    whole = W.cut(pa.array([text, None, "", "tail"]))
    assert whole.hash[0] == whole.hash[299_999] and whole.hash[-1] == whole.hash[-2]
    assert whole.hash[-3] == W.cut(pa.array(["é" * 200])).hash[0]


def test_no_repeats_and_no_links_of_built_words(spark):
    """Two documents of 19 equal words and one of either word; and of one such word each."""
    common = " ".join(f"w{i}" for i in range(19))
    one, two = thue_morse(10), thue_morse(10, "ba")
    rows = [(1, f"{common} {one}"), (2, f"{common} {two}"), (3, f"{common} {one}")]
    removed = {r.doc_id: r.n_removed for r in repeats.without_repeats(documents(spark, rows)).collect()}
    assert removed == {1: 0, 2: 0, 3: 20}
    rows = [(1, one), (2, two), (3, one)]
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(
        documents(spark, rows), shingle=2).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_training_takes_the_least_of_texts_that_share_an_id(spark):
    rng = np.random.default_rng(3)
    good = [(i, " ".join(f"fine{j}" for j in rng.integers(0, 40, 30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"vile{j}" for j in rng.integers(0, 40, 30))) for i in range(60)]
    twice = [(i, "vile1 vile2") for i, _ in good[:20]]
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in good + bad],
                                   "doc_id long, quality int, toxic int")
    models = [toxicity.train(documents(spark, rows).repartition(n), labels)
              for rows, n in ((good + bad + twice, 1), (twice[::-1] + bad + good, 7))]
    for (a, b), (c, d) in [zip(*models)]:
        for x, y in zip(a, b):
            assert (x.words == y.words).all() and (x.weights == y.weights).all()
        assert c == d

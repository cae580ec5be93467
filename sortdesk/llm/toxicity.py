"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear model over the words of a text
and a few measures of its form, and the models of later categories also read the probabilities
of the earlier ones. In training these come out of fold: a row's earlier probabilities are
predicted by models that have not seen it, so the later models learn from what they will meet.

Words enter by presence. A model takes the words most strongly tied to its category by a
chi-square test on its training rows, at most MAX_WORDS of them and none below MIN_CHI_SQUARE,
and is fitted by ridge logistic regression. A document is rejected where the last category reaches
the threshold that separates the out-of-fold predictions best. Training uses at most MAX_TRAINING labelled rows,
those of least hash of the id, in one task; scoring covers all documents, whole texts, in one pass
without a shuffle.

Defined results. Null or word-less texts have no words; they are scored by form alone. Null ids
and null labels do not train. Rows that repeat an id train once; repeated labels count as the
largest. Without labelled rows, or with one class only, probabilities are the smoothed share.
Repeated rows: equal results. An empty table gives no rows. All columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_long, free_name, small_batches
from .words import LETTERS_DIGITS, Words, cut, give_back, signed, slices, text_bytes

MAX_TRAINING = 10_000
MAX_WORDS = 4096
MIN_CHI_SQUARE = 20.0
MIN_ROWS = 3
FOLDS = 4
RIDGE = 0.1
FORMS = 5
LEAST_THRESHOLD = 0.1

#: Categories in chain order: name and target over the columns of `labels`.
CHAIN = (("junk", "1 - quality"), ("toxic", "toxic"))


def forms(words: Words, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(rows x FORMS): measures of a text's form, each between 0 and about 1."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    mark = ((raw > 0x20) & (raw < 0x30)) | ((raw > 0x39) & (raw < 0x41)) | (
        (raw > 0x5A) & (raw < 0x61)) | ((raw > 0x7A) & (raw < 0x7F))
    out = np.zeros((n, FORMS))
    out[:, 0] = sums(mark) / size
    out[:, 1] = sums((raw >= 0x41) & (raw <= 0x5A)) / size
    out[:, 2] = sums((raw >= 0x30) & (raw <= 0x39)) / size
    count = np.maximum(words.counts, 1)
    row, _, distinct = _presence(words)
    out[:, 3] = distinct / count
    out[:, 4] = np.log1p(words.counts) / 10
    return out


def _presence(words: Words):
    """(row, hash, number by row) of the distinct words of each row."""
    order = np.lexsort((words.hash, words.row))
    row, h = words.row[order], words.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], np.bincount(row[new], minlength=len(words.counts))


def features(texts: pa.Array):
    """(row, word hash, forms) of a slice of texts."""
    words = cut(texts, LETTERS_DIGITS, lower=True)
    raw, off = text_bytes(texts)
    row, h, _ = _presence(words)
    return row, h, forms(words, off, raw)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(row, column, n_columns: int, dense: np.ndarray, y: np.ndarray,
                 ridge: float = RIDGE) -> np.ndarray:
    """Ridge logistic weights of presences (row, column) and dense columns, intercept last, by
    Newton steps whose equations are solved by conjugate gradients."""
    dense = np.hstack([dense, np.ones((len(dense), 1))])
    hold = np.full(n_columns + dense.shape[1], ridge)
    hold[-1] = 1e-6

    def forward(w):
        return np.bincount(row, weights=w[column], minlength=len(y)) + dense @ w[n_columns:]

    def back(v):
        return np.concatenate([np.bincount(column, weights=v[row], minlength=n_columns),
                               dense.T @ v])

    w = np.zeros(len(hold))
    for _ in range(25):
        p = _sigmoid(forward(w))
        gradient, curve = back(p - y) + hold * w, p * (1 - p)
        step, rest = np.zeros(len(w)), -gradient
        way, size = rest.copy(), rest @ rest
        enough = 1e-6 * size
        for _ in range(60):
            if size <= enough:
                break
            bent = back(curve * forward(way)) + hold * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-3:
            break
    return w


class Model:
    """One category: word hashes in order, their weights, and those of forms and the chain."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights = words, weights

    @classmethod
    def fit(cls, row, word, codes, dense, y, rows) -> Model:
        """row/codes: presence of word[codes] in training rows; rows: which of them train."""
        y_rows = y[rows]
        n, positive = len(rows), y_rows.sum()
        if positive == 0 or positive == n:
            share = (positive + 0.5) / (n + 1)
            weights = np.zeros(dense.shape[1] + 1)
            weights[-1] = np.log(share / (1 - share))
            return cls(np.zeros(0, np.uint64), weights)
        used = np.zeros(len(y), bool)
        used[rows] = True
        used = used[row]
        seen = np.bincount(codes[used], minlength=len(word)).astype(float)
        hit = np.bincount(codes[used], weights=y[row[used]], minlength=len(word))
        expected = seen * positive / n
        spread = expected * (1 - positive / n) * (1 - seen / n)
        chi = np.where(spread > 0, (hit - expected) ** 2 / np.maximum(spread, 1e-12), 0)
        chi[seen < MIN_ROWS] = 0
        best = np.argsort(-chi, kind="stable")[:MAX_WORDS]
        best = np.sort(best[chi[best] >= MIN_CHI_SQUARE])   # word is sorted, so is word[best]
        chosen = np.full(len(word), -1)
        chosen[best] = np.arange(len(best))
        keep = used & (chosen[codes] >= 0)
        place = np.full(len(y), -1)
        place[rows] = np.arange(n)
        return cls(word[best], fit_logistic(place[row[keep]], chosen[codes[keep]], len(best),
                                            dense[rows], y_rows))

    def predict(self, row, h, dense) -> np.ndarray:
        score = dense @ self.weights[len(self.words):-1] + self.weights[-1]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            score = score + np.bincount(row[known], weights=self.weights[at[known]],
                                        minlength=len(dense))
        return _sigmoid(score)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row counts as positive: best F1 on out-of-fold rows, in
    the middle (of log odds) of the gap where it is reached, and LEAST_THRESHOLD at least."""
    order = np.argsort(-p, kind="stable")
    ordered, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    f1[:-1][ordered[1:] == ordered[:-1]] = 0
    at = int(np.argmax(f1))
    odds = np.log(np.clip(ordered, 1e-9, 1 - 1e-9) / (1 - np.clip(ordered, 1e-9, 1 - 1e-9)))
    middle = (odds[at] + odds[min(at + 1, len(y) - 1)]) / 2
    return float(np.clip(_sigmoid(middle), LEAST_THRESHOLD, 0.5))


def fit_chain(row, h, dense, targets: np.ndarray) -> tuple[list[Model], list[float]]:
    """Models and thresholds of all categories, trained with out-of-fold probabilities of the
    earlier ones."""
    word, codes = np.unique(h, return_inverse=True)
    fold = np.arange(len(dense)) % FOLDS
    models: list[Model] = []
    thresholds: list[float] = []
    earlier = np.zeros((len(dense), 0))
    for y in targets.T.astype(float):
        x = np.hstack([dense, earlier])
        out_of_fold = np.zeros((len(dense), 1))
        for f in range(FOLDS):
            held = fold == f
            model = Model.fit(row, word, codes, x, y, np.flatnonzero(~held))
            out_of_fold[held, 0] = model.predict(row, h, x)[held]
        models.append(Model.fit(row, word, codes, x, y, np.arange(len(dense))))
        thresholds.append(best_threshold(out_of_fold[:, 0], y))
        earlier = np.hstack([earlier, out_of_fold])
    return models, thresholds


def predict_chain(models: list[Model], row, h, dense) -> np.ndarray:
    """(rows x categories)"""
    done = np.zeros((len(dense), 0))
    for model in models:
        p = model.predict(row, h, np.hstack([dense, done]))
        done = np.hstack([done, p[:, None]])
    return done


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, h, dense = features(batch.column("text"))
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        flat = np.arange(0, dense.size + 1, FORMS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("targets"),
            pa.ListArray.from_arrays(edges, pa.array(signed(h))),
            pa.ListArray.from_arrays(flat, pa.array(dense.reshape(-1)))],
            ["id", "targets", "words", "forms"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of all rows of one bounded partition."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        rows = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        words, dense, targets = (rows.column(c).combine_chunks() for c in ("words", "forms", "targets"))
        h = words.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(rows.num_rows), np.diff(words.offsets.to_numpy()))
        models, thresholds = fit_chain(row, h, dense.flatten().to_numpy().reshape(rows.num_rows, FORMS),
                                       targets.flatten().to_numpy().reshape(rows.num_rows, -1))
        plain = pickle.dumps([(m.words, m.weights, t) for m, t in zip(models, thresholds)])
        yield pa.RecordBatch.from_arrays([pa.array([plain])], ["chain"])
        del batches, rows, words, dense, targets, h, row, models
        give_back()


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id",
          text_col: str = "text", max_training: int = MAX_TRAINING
          ) -> tuple[list[Model], list[float]]:
    """(models, thresholds) fitted on at most max_training labelled documents; empty without any."""
    small_batches(docs)
    ids = as_long(id_col)
    wanted = labels.select(ids.alias("id"), *[
        F.expr(target).cast("int").alias(f"t{i}") for i, (_, target) in enumerate(chain)]).dropna()
    wanted = wanted.groupBy("id").agg(F.array(*[F.max(f"t{i}") for i in range(len(chain))])
                                      .alias("targets"))
    sample = wanted.orderBy(F.xxhash64("id"), "id").limit(max_training)
    texts = docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").mapInArrow(
        _training_rows, "id long, targets array<int>, words array<long>, forms array<double>")
    # of several texts with one id, the least by content
    rows = rows.groupBy("id").agg(F.min(F.struct("targets", "words", "forms")).alias("r")).select(
        "id", "r.*")
    fitted = rows.repartition(1).mapInArrow(_train, "chain binary").first()
    parts = pickle.loads(fitted["chain"]) if fitted else []
    return [Model(words, weights) for words, weights, _ in parts], [t for *_, t in parts]


def score(docs: DataFrame, models: list[Model], thresholds: list[float], chain=CHAIN,
          text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """docs with a column <a probability for each category, rejected>; rejected: the last category
    reaches its threshold. If nothing was fitted, probabilities are 0 and nothing is rejected."""
    small_batches(docs)
    result = free_name(docs, result)
    names = [name for name, _ in chain]
    kind = T.StructType([*[T.StructField(n, T.DoubleType()) for n in names],
                         T.StructField("rejected", T.BooleanType())])
    limit = thresholds[-1] if thresholds else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            p = np.zeros((batch.num_rows, len(names)))
            if models:
                p = predict_chain(models, *features(batch.column(text_col))).round(9)
            column = pa.StructArray.from_arrays(
                [*[pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))],
                 pa.array(p[:, -1] >= limit)], [*names, "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                             [*batch.schema.names, result])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(result, kind)]))


def toxic_documents(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """docs with the verdict of the chain fitted on their labelled rows."""
    return score(docs, *train(docs, labels, chain, id_col, text_col), chain, text_col)

"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has 128 coordinates. In round i every shingle of a set falls into one hashed bin with
a hashed value; the bin keeps the least value of the first round that reached it. From round
128 on, round 128 + b sends every shingle to bin b, so no coordinate stays empty, however small
the set. Coordinates of two sets agree with probability equal to their Jaccard similarity, with
the concentration of sampling without replacement, at a cost near one pass for large sets.

32 bands of 4 coordinates give the candidates; a pair of similarity 0.8 shares no band with
probability (1 - 0.8 ** 4) ** 32 = 5e-8. Every link is confirmed on full shingle sets.

No bucket is paired out. Equal sets are one class from the start. Each class first meets the
most central member of its buckets (the one that meets the most others, as the original of
edited copies does); confirmed links are contracted; then the other centres of its buckets; and
last, exactly, those bucket members that still lie in different components: as pairs in small
buckets, block against block in large ones, where only links leave the task. A pair inside one
component cannot change the result and is never looked at.

Defined results. Null or word-less text: no shingles, linked with nothing, kept. Null id: a row
of its own without component, kept. Rows of one id are one document: what links one row links
all of them. Repeated rows: each gets the same result. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import roots
from .store import as_long, small_batches, written
from .words import cut, mix, shingle_sets, signed, slices

COORDINATES = 128
ROWS, BANDS = 4, 32
#: Buckets up to this size give pairs; larger ones are compared in blocks of bounded size.
SMALL_BUCKET = 32
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS_AT_ONCE = 1024, 500_000, 2048
_EMPTY = np.uint32(0xFFFFFFFF)
_U = np.uint64


def sketches(row: np.ndarray, shingles: np.ndarray, sizes: np.ndarray,
             t: int = COORDINATES) -> np.ndarray:
    """(rows x t) sketch of sets given as (row, shingle) in row order; empty sets stay empty."""
    sketch = np.full((len(sizes), t), _EMPTY, np.uint32)
    open_rows = sizes > 0
    for i in range(2 * t):
        if i:
            full = (sketch != _EMPTY).all(axis=1)
            open_rows &= ~full
            live = open_rows[row]
            row, shingles = row[live], shingles[live]
        if not len(row):
            break
        g = mix(shingles ^ mix(np.full(1, 2 * i + 1, _U)))
        value = np.minimum((g & _U(0xFFFFFFFF)).astype(np.uint32), _EMPTY - np.uint32(1))
        bins = (g >> _U(32)) % _U(t) if i < t else np.full(len(g), i - t, _U)
        cell = row * t + bins.astype(np.int64)
        least = np.full(sketch.size, _EMPTY, np.uint32)
        np.minimum.at(least, cell, value)
        flat = sketch.reshape(-1)
        flat[flat == _EMPTY] = least[flat == _EMPTY]
    return sketch


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(_U)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2])
    for r in range(ROWS):
        out = mix(out ^ (parts[:, :, r] * _U(0x9E3779B97F4A7C15)))
    return out


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, h, sizes = shingle_sets(cut(batch.column("text"), lower=True), k)
            at = np.concatenate([[0], np.cumsum(sizes)])
            keys = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                    for a, b in zip(at, at[1:])]
            keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            bands = signed(band_hashes(sketches(row, h, sizes))).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(sizes, pa.int64()),
                pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                pa.ListArray.from_arrays(
                    np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands))],
                ["id", "n", "k1", "k2", "bands"])
    return sign


def _similar(k: int, percent: int):
    """Pairs whose full shingle sets reach the similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            ra, ha, na = shingle_sets(cut(batch.column("ta"), lower=True), k)
            rb, hb, nb = shingle_sets(cut(batch.column("tb"), lower=True), k)
            row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
            both = np.bincount(row[1:][same], minlength=len(na))
            ok = (100 * both >= percent * (na + nb - both)) & (na > 0) & (nb > 0)
            yield batch.select(["u", "v"]).filter(pa.array(ok))
    return check


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity on the full sets of their texts."""
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("tb"))
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "ta", "tb").mapInArrow(
        _similar(k, percent), "u long, v long").distinct(), "links")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after adding links between nodes."""
    if links.isEmpty():
        return labels
    ends = links
    for end in "uv":
        to = labels.select(F.col("node").alias(end), F.col("label").alias("l" + end))
        ends = ends.join(to, end)
    to = roots(ends.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    return written(labels.join(to.withColumnRenamed("v", "label"), "label", "left").select(
        "node", F.coalesce("root", "label").alias("label")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for end in "uv":
        to = labels.select(F.col("node").alias(end), F.col("label").alias("l" + end))
        pairs = pairs.join(to, end)
    return pairs.where("lu <> lv").select("u", "v")


def _fits(a: str, b: str, percent: int):
    """Set sizes that allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are runs without ASCII white space, A-Z as a-z; a document's set holds its distinct
    shingles of `shingle` words. Documents are linked from `percent` similarity on; the
    component is named by its least id, and that document is kept.
    """
    small_batches(docs)
    source = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed_rows = written(source.mapInArrow(
        _signer(shingle), "id long, n long, k1 long, k2 long, bands array<long>"), "signatures")

    usable = signed_rows.where("id is not null and n > 0")
    classes = written(
        usable.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("n").alias("n"),
                                       F.first("bands").alias("bands")), "classes")
    labels = _link(source, classes, usable, shingle, percent)

    named = classes.select("k1", "k2", "node").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = written(named.groupBy("label").agg(F.min("node").alias("component_id")), "least")
    named = written(named.join(least, "label").select("k1", "k2", "component_id"), "components")
    key = ["id", "n", "k1", "k2"]
    joined = signed_rows.select(*key).join(named, ["k1", "k2"], "left")
    component = F.expr("case when id is null then null when n = 0 then id else component_id end")
    return joined.withColumn("component_id", component).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.expr("coalesce(id = component_id, true)").alias("kept"))


def _link(source: DataFrame, classes: DataFrame, usable: DataFrame, k: int,
          percent: int) -> DataFrame:
    """(node, label) of the classes that share a band or an id with another."""
    one_id = usable.select("id", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"])
    several = one_id.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where(
        "u < w").select("id", "u")
    same_id = written(one_id.join(several, "id").where("node <> u").select(
        "u", F.col("node").alias("v")).distinct(), "same-id")

    rows = classes.select("node", "n", F.explode("bands").alias("band"))
    many = written(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    shared = written(rows.join(many, "band"), "shared")
    weights = shared.groupBy("node").agg(F.sum("c").alias("w"))
    centres = written(
        shared.join(weights, "node").groupBy("band").agg(
            F.max(F.struct("w", (-F.col("node")).alias("neg"), "n")).alias("m")).select(
            "band", (-F.col("m.neg")).alias("v"), F.col("m.n").alias("nv")), "centres")
    met = written(
        shared.select("band", F.col("node").alias("u"), "n").join(centres, "band")
        .where(F.col("u") != F.col("v")).where(_fits("n", "nv", percent))
        .groupBy("u", "v").agg(F.count("*").alias("votes")), "met")

    nodes = shared.select("node").unionByName(same_id.select(F.col("u").alias("node"))).unionByName(
        same_id.select(F.col("v").alias("node"))).distinct()
    labels = written(nodes.withColumn("label", F.col("node")), "labels")
    if labels.isEmpty():
        return labels
    texts = written(
        source.join(shared.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        .dropDuplicates(["id", "text"]), "texts")

    best = met.groupBy("u").agg(F.max(F.struct("votes", (-F.col("v")).alias("neg"))).alias("m")
                                ).select("u", (-F.col("m.neg")).alias("v"))
    best = written(best, "best")
    labels = _merge(labels, same_id.unionByName(verified(best, texts, k, percent)))

    others = written(_apart(met.join(best, ["u", "v"], "left_anti"), labels), "others")
    if not others.isEmpty():
        labels = _merge(labels, verified(others, texts, k, percent))

    open_rows = written(_open_rows(shared, labels), "open")
    if open_rows.isEmpty():
        return labels
    done = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(_pairs_of_small(open_rows, percent).join(done, ["u", "v"], "left_anti"), "pairs")
    found = verified(pairs, texts, k, percent).unionByName(
        _links_of_large(open_rows, texts, k, percent))
    return _merge(labels, written(found.distinct(), "links"))


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, n, label, c, volume) of the buckets whose members lie in several components."""
    placed = shared.select("band", "node", "n").join(labels, "node")
    mixed = placed.groupBy("band").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c"),
        F.sum("n").alias("volume")).where("a <> b").select("band", "c", "volume")
    return placed.join(written(mixed, "mixed"), "band")


def _pairs_of_small(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in different components out of buckets of at most SMALL_BUCKET members."""
    small = open_rows.where(F.col("c") <= SMALL_BUCKET)
    left, right = (small.select("band", F.col("node").alias(x), F.col("n").alias("n" + x),
                                F.col("label").alias("l" + x)) for x in "uv")
    pairs = left.join(right, "band").where("u < v and lu <> lv").where(_fits("nu", "nv", percent))
    return pairs.select("u", "v").distinct()


def _links_of_large(open_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) out of larger buckets: each is cut into blocks of bounded size, every block
    meets every block of its bucket, and only confirmed links leave the task."""
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("volume") / BLOCK_SHINGLES))
    large = open_rows.where(F.col("c") > SMALL_BUCKET).withColumn("blocks", blocks)
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = large.select("band", F.least("own", "other").alias("i"),
                          F.greatest("own", "other").alias("j"), F.col("node").alias("id"), "label")
    return placed.join(texts, "id").groupBy("band", "i", "j").applyInArrow(
        _links_inside(k, percent), "u long, v long")


def _links_inside(k: int, percent: int):
    def links(rows: pa.Table) -> pa.Table:
        row, h, sizes = shingle_sets(cut(rows.column("text"), lower=True), k)
        label = rows.column("label").to_numpy()
        ids = rows.column("id").to_numpy()
        _, column, seen = np.unique(h, return_inverse=True, return_counts=True)
        keep = seen[column] > 1
        row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
            part = np.zeros((len(ids), COLUMNS_AT_ONCE), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            both += part @ part.T
        both = both.astype(np.int64)           # whole numbers below 2 ** 24: floats held them exactly
        union = sizes[:, None] + sizes[None, :] - both
        ok = (100 * both >= percent * union) & (label[:, None] != label[None, :]) & (
            ids[:, None] < ids[None, :]) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
        u, v = np.nonzero(ok)
        return pa.table({"u": ids[u], "v": ids[v]})
    return links

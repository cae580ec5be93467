"""Passages for a message: cutting documents, lexical and vector top-k, rendering.

Top-k is exact, for any number of questions, with one pass over the passages or vectors.
Questions are a table like passages and vectors; none of them goes through the driver.

Words: the passages of each word lie in blocks. A question can score in a block at most the sum
of the weights of its words that occur there. The blocks that promise most give a question its
k-th score, blocks that cannot reach it are left out, and only the postings of the others are
added up. All of this is joins and aggregates.

Vectors: every vector belongs to the cell of its nearest pivot. A question meets its own cell
first; by the triangle inequality it then leaves out the cells that hold nothing as near as its
k-th neighbour so far. Cells and their questions meet block by block, as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import is_blank, strip, text_or_empty
from ..session import cut_lineage, written

HEADING = r"(?m)^## +"
# Passages of a block share all but this many bits of their number; blocks searched first.
BLOCK_BITS, FIRST_BLOCKS = 8, 2
# Scores and bounds are sums in another order: what rounding can make of them.
ROOM = 1e-9
# Pivots at most, vectors of a cell on average, numbers in one block of vectors or questions.
PIVOTS, CELL_ROWS, BLOCK_FLOATS = 256, 4096, 1 << 19
# Numbers in one tile of scores or distances.
TILE = 2_000_000
SCORE_DIGITS = 12


# --- passages ------------------------------------------------------------------------------
def chunk_sections(docs: DataFrame, source: str = "source", text: str = "text",
                   min_chars: int | None = None, heading: str = HEADING) -> DataFrame:
    """One row per section: the document's columns plus chunk_pos, chunk_id, section, text.

    Without ``min_chars`` every non-blank part is kept and the part before the first
    heading is titled by its first line ('intro' when that is only marks). With it, parts
    whose trimmed length does not exceed it are dropped.
    """
    parts = F.transform(
        F.split(text_or_empty(text), heading, -1),
        lambda p, i: F.struct((i == 0).alias("intro"), strip(p).alias("text")))
    keep = F.filter(parts, lambda p: (
        F.length(p["text"]) > min_chars if min_chars is not None else p["text"] != ""))
    rest = [c for c in docs.columns if c != text]
    exploded = docs.select(*rest, F.posexplode(F.coalesce(keep, F.array())).alias(
        "chunk_pos", "__part"))
    body = F.regexp_replace(F.col("__part")["text"], r"\R", "\n")
    first_line = F.split_part(body, F.lit("\n"), F.lit(1))
    unmarked = strip(F.regexp_replace(first_line, r"^[# ]+", ""))
    intro_title = F.when(unmarked == "", F.lit("intro")).otherwise(unmarked)
    title = unmarked if min_chars is not None else F.when(
        F.col("__part")["intro"], intro_title).otherwise(strip(first_line))
    return exploded.select(
        *rest, "chunk_pos",
        F.concat(F.col(source).cast("string"), F.lit("-"), F.col("chunk_pos").cast("string"))
        .alias("chunk_id"),
        title.alias("section"), body.alias(text))


# --- terms ---------------------------------------------------------------------------------
def terms(text: Column | str) -> Column:
    """Distinct words of five letters and more, lower-case, without stop words."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(V.TERM), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in V.STOP_WORDS]))


def document_frequency(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Number of passages per term."""
    return (chunks.select(F.explode(terms(text)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _ranked(hits: DataFrame, query_id: str, order: list[str], k: int,
            best_first: Column) -> DataFrame:
    """k best per question; the rank filter keeps k rows per task before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(best_first, *order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _place(batch: pa.RecordBatch, order: list[str]) -> np.ndarray:
    """Place of each row in corpus order, nulls first."""
    ranked = pc.sort_indices(batch.select(order), sort_keys=[(c, "ascending") for c in order],
                             null_placement="at_start").to_numpy()
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.arange(len(ranked))
    return place


def _first_k(group: np.ndarray, *keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group by the keys."""
    by = np.lexsort((*keys[::-1], group))
    ordered = group[by]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(by) else by
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return by[nth < k]


def _same_type(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int = V.TOP_K,
                 query_id: str = "query_id", query: str = "text",
                 order: tuple[str, ...] = ("doc_id", "chunk_pos"), text: str = "text",
                 block_bits: int = BLOCK_BITS, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(query_id, order columns, score, rank): the k passages sharing most rare words.

    The score adds 1 / (1 + df / n) over the shared terms; equal scores keep corpus order,
    passages without a shared term never appear. Ids and order columns may be numbers or
    texts. Document frequencies are counted for the questions' terms only.
    """
    order = list(order)
    passages = written(chunks.select(*order, terms(text).alias("__terms")).withColumn(
        "__p", F.monotonically_increasing_id()), "passages")
    asked = written(queries.where(F.col(query_id).isNotNull()).select(
        query_id, terms(query).alias("__terms")).withColumn(
        "__q", F.monotonically_increasing_id()), "questions")
    words = asked.select("__q", F.explode("__terms").alias("term"))

    block = F.shiftright("__p", block_bits).alias("block")
    postings = written(
        passages.select(F.explode("__terms").alias("term"), "__p").join(
            words.select("term").distinct(), "term")
        .groupBy("term", block).agg(F.collect_list("__p").alias("ps")), "postings")
    held = postings.groupBy("term").agg(F.sum(F.size("ps")).alias("df"))
    weight = 1 / (1 + F.col("df") / F.lit(max(passages.count(), 1)))
    weights = written(words.join(held, "term").select("__q", "term", weight.alias("w")), "weights")

    promises = written(
        weights.join(postings.select("term", "block"), "term").groupBy("__q", "block").agg(
            F.sum("w").alias("promise")), "promises")
    most = Window.partitionBy("__q").orderBy(F.desc("promise"), "block")
    first = written(promises.withColumn("r", F.row_number().over(most)).where(
        F.col("r") <= first_blocks).select("__q", "block"), "first-blocks")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(weights, "__q").join(postings, ["term", "block"]).select(
            "__q", F.explode("ps").alias("__p"), "w").groupBy("__q", "__p").agg(
            F.round(F.sum("w"), SCORE_DIGITS).alias("score"))

    hits = written(scored(first), "first-scores")
    best = Window.partitionBy("__q").orderBy(F.desc("score"))
    kth = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(
        "__q", F.col("score").alias("kth"))
    open_blocks = promises.join(first, ["__q", "block"], "left_anti").join(kth, "__q", "left").where(
        F.col("kth").isNull() | (F.col("promise") >= F.col("kth") - ROOM)).select("__q", "block")
    hits = hits.unionByName(scored(open_blocks))
    # ties of the k-th score stay until corpus order has decided
    hits = hits.withColumn("r", F.rank().over(best)).where(F.col("r") <= k)
    named = hits.join(passages.select("__p", *order), "__p").join(
        asked.select("__q", query_id), "__q").select(query_id, *order, "score")
    return _ranked(named, query_id, order, k, F.desc("score"))


# --- vectors -------------------------------------------------------------------------------
def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nearest_in(batch: pa.RecordBatch, key: str, asked: np.ndarray, own: list | None, k: int):
    """(questions, rows, distances) of the k nearest rows of a batch, tile by tile.

    One matrix product finds all rows near the k-th distance, with room for its rounding;
    their distances are then taken from the differences themselves.
    """
    rows = _matrix(batch.column("__vector"))
    place = _place(batch, [key])
    norms = (rows ** 2).sum(axis=1)
    step = max(1, TILE // max(len(rows), 1))
    index = {v: i for i, v in enumerate(batch.column(key).to_pylist())} if own is not None else {}
    for at in range(0, len(asked), step):
        q = asked[at:at + step]
        size = (q ** 2).sum(axis=1)
        near = size[:, None] + norms[None, :] - 2.0 * q @ rows.T
        if own is not None:
            for i, v in enumerate(own[at:at + step]):
                if v in index:
                    near[i, index[v]] = np.inf
        room = 1e-9 * (1.0 + size[:, None] + norms.max(initial=0.0))
        limit = (np.partition(near, k - 1, axis=1)[:, k - 1:k] if near.shape[1] > k
                 else np.full((len(q), 1), np.finfo(float).max))
        question, row = np.nonzero((near <= limit + room) & np.isfinite(near))
        distance = np.round(((rows[row] - q[question]) ** 2).sum(axis=1), SCORE_DIGITS)
        first = _first_k(question, distance, place[row], k=k)
        yield question[first] + at, row[first], distance[first]


def _usable(vector: str, dimension: int) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) == dimension) & ~F.exists(
        F.col(vector), lambda x: x.isNull() | F.isnan(x))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = V.TOP_K,
                query_id: str = "query_id", query: str = "embedding", key: str = "vec_id",
                vector: str = "embedding", exclude_self: bool = False,
                cell_rows: int = CELL_ROWS, block_floats: int = BLOCK_FLOATS) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest vectors by squared distance, exactly.

    The dimension is that of the first usable question; vectors that are null, hold nulls or
    NaN, or have another dimension take no part.
    """
    base = vectors.select(key, F.col(vector).cast("array<double>").alias("__vector"))
    asked = queries.where(F.col(query).isNotNull() & F.col(query_id).isNotNull()).select(
        query_id, F.col(query).cast("array<double>").alias("__query"))
    first = asked.where(F.size("__query") > 0).select(F.size("__query")).first()
    dimension = first[0] if first else 0
    base = written(base.where(_usable("__vector", dimension)), "vectors")
    asked = asked.where(_usable("__query", dimension)).withColumn(
        "__q", F.monotonically_increasing_id())
    cells = Cells(base, key, cell_rows)
    size = max(1, block_floats // max(dimension, 1))
    placed = written(base.mapInArrow(cells.assign("__vector"), _with(base, "cell int, away double")),
                     "placed-vectors")
    asked = written(asked.mapInArrow(cells.assign("__query"), _with(asked, "cell int, away double")),
                    "placed-questions")
    cells.measure(placed)

    nearest = _Meeting(queries.schema[query_id], vectors.schema[key], k, exclude_self, size)
    hits = written(nearest.meet(placed, asked.withColumn("limit", F.lit(float("inf")))), "own-cells")
    best = Window.partitionBy("__q").orderBy("distance")
    kth = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(
        "__q", F.col("distance").alias("limit"))
    asked = asked.join(kth, "__q", "left").withColumn(
        "limit", F.coalesce("limit", F.lit(float("inf"))))
    others = written(asked.mapInArrow(cells.others, asked.schema), "other-cells")
    hits = hits.unionByName(nearest.meet(placed, others)).drop("__q")
    return _ranked(hits, query_id, [key], k, F.asc("distance"))


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


class Cells:
    """Pivots, which are some of the vectors, and how near and far the vectors of each lie."""

    def __init__(self, base: DataFrame, key: str, cell_rows: int):
        many = min(PIVOTS, 1 + base.count() // cell_rows)
        some = base.orderBy(F.xxhash64("__vector"), key).limit(many).select("__vector").collect()
        self.pivots = np.unique(np.array([r[0] for r in some], np.float64), axis=0)
        self.near = self.far = None

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def assign(self, column: str):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                if batch.num_rows and len(self.pivots):
                    apart = self._distances(_matrix(batch.column(column)))
                    cell = apart.argmin(axis=1).astype(np.int32)
                    away = apart.min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(away)],
                    [*batch.schema.names, "cell", "away"])
        return assign

    def measure(self, placed: DataFrame) -> None:
        """Least and largest distance from the pivot in every cell: one row for each pivot."""
        rows = placed.groupBy("cell").agg(F.min("away").alias("a"), F.max("away").alias("b")).collect()
        self.near, self.far = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        for r in rows:
            self.near[r["cell"]], self.far[r["cell"]] = r["a"], r["b"]

    def others(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The questions once more for each other cell that can hold a vector within the limit."""
        for batch in batches:
            if not batch.num_rows or not len(self.pivots):
                continue
            apart = self._distances(_matrix(batch.column("__query")))
            limit = np.sqrt(batch.column("limit").to_numpy() + 10.0 ** -SCORE_DIGITS)[:, None]
            gap = np.maximum(apart - self.far, self.near - apart)
            room = ROOM * (1 + apart + np.where(np.isfinite(self.far), self.far, 0))
            reached = gap <= limit + room
            reached[np.arange(batch.num_rows), batch.column("cell").to_numpy()] = False
            question, cell = np.nonzero(reached)
            again = batch.take(pa.array(question))
            yield again.set_column(again.schema.get_field_index("cell"), "cell",
                                   pa.array(cell.astype(np.int32)))


class _Meeting:
    """Questions and vectors of one cell, block against block."""

    def __init__(self, query_id: T.StructField, key: T.StructField, k: int, exclude_self: bool, size: int):
        self.query_id, self.key, self.k, self.exclude_self = query_id.name, key.name, k, exclude_self
        self.size = size
        self.schema = T.StructType([
            T.StructField("__q", T.LongType()), T.StructField(query_id.name, query_id.dataType),
            T.StructField(key.name, key.dataType), T.StructField("distance", T.DoubleType())])

    def meet(self, vectors: DataFrame, asked: DataFrame) -> DataFrame:
        """(__q, query id, key, distance) of the k nearest of each question in a block of vectors,
        as far as they lie within its limit. Large cells are cut into blocks by hash, and so are
        their questions, so a cell that holds most vectors is spread over many tasks."""
        rows = F.ceil(F.count(F.lit(1)) / self.size)
        load = vectors.groupBy("cell").agg(rows.alias("vb")).join(
            asked.groupBy("cell").agg(rows.alias("qb")), "cell")
        load = written(load, "cells")
        left = vectors.join(load, "cell").withColumn("v", F.pmod(F.xxhash64(self.key), "vb")).withColumn(
            "w", F.explode(F.expr("sequence(0L, qb - 1)"))).select(
            F.col("cell").alias("c"), "v", F.col("w").alias("w"), self.key, "__vector")
        right = asked.join(load, "cell").withColumn("w", F.pmod(F.xxhash64("__q"), "qb")).withColumn(
            "v", F.explode(F.expr("sequence(0L, vb - 1)"))).select(
            "cell", "v", "w", "__q", self.query_id, "__query", "limit")
        return left.groupBy("c", "v", "w").cogroup(right.groupBy("cell", "v", "w")).applyInArrow(
            lambda vectors, asked: self._nearest(vectors, asked), self.schema)

    def _nearest(self, left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema
        out = [to_arrow_schema(self.schema).empty_table()]
        if left.num_rows and right.num_rows:
            batch, asked = left.combine_chunks().to_batches()[0], right.combine_chunks()
            own = asked.column(self.query_id).to_pylist() if self.exclude_self else None
            limit = asked.column("limit").to_numpy()
            x = _matrix(asked.column("__query").chunk(0))
            for question, row, distance in _nearest_in(batch, self.key, x, own, self.k):
                keep = distance <= limit[question]
                question, row = pa.array(question[keep]), pa.array(row[keep])
                out.append(pa.table({
                    "__q": asked.column("__q").take(question),
                    self.query_id: asked.column(self.query_id).take(question),
                    self.key: batch.column(self.key).take(row),
                    "distance": pa.array(distance[keep])}).cast(out[0].schema))
        return pa.concat_tables(out)


def vector_topk_approx(queries: DataFrame, vectors: DataFrame, max_distance: float,
                       k: int = V.TOP_K, query_id: str = "query_id", query: str = "embedding",
                       key: str = "vec_id", vector: str = "embedding", bucket_length: float = 2.0,
                       tables: int = 4, seed: int = 1) -> DataFrame:
    """(query_id, key, distance, rank) among vectors that share a hash bucket with the question
    and lie within ``max_distance`` of it; some neighbours may be missed. A join on buckets
    in place of a comparison with every vector, for those who ask for it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def side(df: DataFrame, name: str, column: str) -> DataFrame:
        usable = F.col(column).isNotNull() & (F.size(column) > 0)
        return df.where(usable).select(F.col(name).alias("__id"), array_to_vector(
            F.col(column).cast("array<double>")).alias("__v"))
    base, asked = side(vectors, key, vector), side(queries, query_id, query)
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", numHashTables=tables,
                                        bucketLength=bucket_length, seed=seed).fit(base)
    pairs = model.approxSimilarityJoin(asked, base, max_distance, "__d").select(
        F.col("datasetA.__id").alias(query_id), F.col("datasetB.__id").alias(key),
        (F.col("__d") * F.col("__d")).alias("distance"))
    return _ranked(pairs, query_id, [key], k, F.asc("distance"))


# --- both ----------------------------------------------------------------------------------
def query_text(subject: Column | str, resume: Column | str, body: Column | str) -> Column:
    """Search text of a message: masked subject, summary and start of the masked body."""
    return strip(F.concat_ws(
        " ", text_or_empty(subject), text_or_empty(resume),
        F.substring(text_or_empty(body), 1, V.QUERY_BODY_CHARS)))


def render(source: Column | str, text: Column | str) -> Column:
    s = F.col(source) if isinstance(source, str) else source
    return F.concat(F.lit("["), s, F.lit("] "), strip(text))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, k: int = V.TOP_K,
             query_id: str = "query_id", query: str = "text", embedding: str = "embedding",
             order: tuple[str, ...] = ("doc_id", "chunk_pos")) -> DataFrame:
    """(query_id, rank, context): vector hits where there are any, else lexical ones.

    ``vectors`` holds the order columns, a ``vec_id`` and ``embedding`` of passages; vectors
    without a passage are left out before ranking, so they take no passage's place. A blank
    question gets nothing.
    """
    order = list(order)
    asked = queries.where(~is_blank(query))
    passages = chunks.select(*order, render("source", "text").alias("context"))
    if vectors is None or embedding not in queries.columns:
        rest, by_vector = asked, None
    else:
        vectors = vectors.join(chunks.select(*order), order, "left_semi")
        by_vector = vector_topk(asked, vectors, k, query_id, embedding).join(
            vectors.select("vec_id", *order), "vec_id").select(query_id, *order, "rank")
        by_vector = cut_lineage(by_vector)
        rest = asked.join(by_vector.select(query_id).distinct(), query_id, "left_anti")
    hits = lexical_topk(rest, chunks, k, query_id, query, tuple(order)).select(
        query_id, *order, "rank")
    if by_vector is not None:
        hits = hits.unionByName(by_vector)
    # few winners: adaptive execution sends them to the passages where they are small
    return passages.join(hits, order).select(query_id, "rank", "context")


def contexts(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rendered passages per question in rank order: at most k of them."""
    pair = F.struct("rank", "context")
    return hits.groupBy(query_id).agg(
        F.sort_array(F.collect_list(pair))["context"].alias("contexts"))


def kb_search(questions: DataFrame, chunks: DataFrame, k: int = V.TOP_K,
              vectors: DataFrame | None = None, query_id: str = "query_id",
              query: str = "text") -> DataFrame:
    """Passages for a table of questions of at least three characters, k from 1 to 10."""
    if not 1 <= k <= 10:
        raise ValueError("k must lie between 1 and 10")
    return retrieve(questions.where(F.length(query) >= 3), chunks, vectors, k, query_id, query)


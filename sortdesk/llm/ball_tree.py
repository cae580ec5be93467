"""Exact ranked lexical search by inner products over ball trees of sparse document vectors.

A document is a sparse vector of whole numbers, one for each term that any question holds; a
question is a vector of term weights; the score is their inner product. Documents are sorted by
length and least term hashes, so that like ones lie together, and cut into blocks. In each block a
binary tree halves the documents along the line between two far ones, down to leaves of LEAF. A
node keeps a centre of whole numbers and, for every group of terms, the largest distance of its
documents from the centre in that group. By Cauchy-Schwarz in each group, no document below a node
scores more than question * centre + sum over groups of |question| * radius. Radii are rounded up
and bounds are raised by more than doubles can lose, so a bound is never too low.

The search is best first twice. The blocks whose roots promise most are searched first, for a
k-th score of every question. Then the blocks whose roots can reach it are searched, the most
promising node first, and subtrees that cannot reach the k-th score are left out. Leaves are scored
in exact 64-bit integers, and nodes that can tie are visited.

Only words that may be terms of a question leave the texts: a table of 2 ** BITMAP_BITS bits (1 MB,
whatever the number of questions) passes all of them and few others, and terms are compared as
texts afterwards. Questions are a table throughout. They meet blocks in groups of bounded size;
neither goes through the driver, and the only broadcast is the bit table.

Defined results. Null or term-less texts: never found, not counted as documents. Every row counts
as a document, so repeated rows rank one after the other. Null ids rank after others of equal
score. Items that share an id: the least text counts; a null item id is an item. Empty tables: no
rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import as_long, small_batches, written
from .words import LETTERS_DIGITS, Words, cut, mix, slices

BITMAP_BITS = 23
#: Documents and entries of one block, documents of one leaf, groups of terms with a radius each.
BLOCK, BLOCK_ENTRIES, LEAF, GROUPS = 512, 1 << 19, 8, 256
#: Documents of one range partition, blocks whose roots lie together, entries of a question group.
RANGE_ROWS, ROOTS_TOGETHER, GROUP_ENTRIES = 1 << 16, 64, 200_000
#: Blocks that are searched first for each question.
FIRST_BLOCKS = 4
#: Raises a bound by far more than the rounding of its sums.
RAISED = 1 + 1e-9
_EXACT = 2.0 ** 53
_U = np.uint64


# --- terms ---------------------------------------------------------------------------------
def _places(words: Words) -> np.ndarray:
    return (words.hash >> _U(64 - BITMAP_BITS)).astype(np.int64)


def _texts(words: Words, at: np.ndarray) -> pa.Array:
    size = words.end[at] - words.start[at]
    offsets = np.append(0, np.cumsum(size))
    data = words.data[np.repeat(words.start[at] - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(
        len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    """One list for each row, of values in row order."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _counter(bitmap: np.ndarray | None):
    """(id, n, terms, counts, h1, h2) of texts: all words counted, those of the bitmap kept."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bitmap is None else np.unpackbits(bitmap, bitorder="little").astype(bool)
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"), LETTERS_DIGITS, lower=True)
            rows, of = batch.num_rows, words.row
            at = (np.arange(len(words.start)) if wanted is None
                  else np.flatnonzero(wanted[_places(words)]))
            coded = _texts(words, at).dictionary_encode()
            kinds = max(len(coded.dictionary), 1)
            cell, many = np.unique(of[at] * kinds + coded.indices.to_numpy().astype(np.int64),
                                   return_counts=True)
            row, code = cell // kinds, cell % kinds
            first = np.full(max(len(coded.dictionary), 1), 0, _U)
            first[coded.indices.to_numpy()] = words.hash[at]
            least = []
            for turn in (1, 2):
                best = np.full(rows, np.iinfo(np.uint64).max, _U)
                np.minimum.at(best, row, mix(first[code] + _U(turn)))
                least.append(pa.array((best >> _U(1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words.counts.astype(np.int64)),
                 _lists(row, coded.dictionary.cast(pa.string()).take(pa.array(code)), rows),
                 _lists(row, pa.array(many.astype(np.int64)), rows), *least],
                ["id", "n", "terms", "counts", "h1", "h2"])
    return count


def _counted(texts: DataFrame, bitmap: np.ndarray | None) -> DataFrame:
    return texts.mapInArrow(_counter(bitmap), "id long, n long, terms array<string>, "
                                              "counts array<long>, h1 long, h2 long")


def _bitmap(asked: DataFrame) -> np.ndarray:
    """Bits of all terms in (text): at most 256 rows of 4 kB come to the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.unique(_places(cut(batch.column("text"), LETTERS_DIGITS, lower=True)))
            yield pa.RecordBatch.from_arrays([pa.array(found + 1)], ["place"])

    parts = asked.select("text").mapInArrow(places, "place long").groupBy(
        F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["part"] - 1) * len(bits):r["part"] * len(bits)] = bits
    return out


# --- the tree ------------------------------------------------------------------------------
def tree_depth(documents: int) -> int:
    return max(0, math.ceil(math.log2(max(documents, 1) / LEAF)))


def node_spans(documents: int) -> list[tuple[int, int]]:
    """(first, end) of the documents below each node; node i has children 2 i + 1, 2 i + 2."""
    spans = [(0, documents)]
    for i in range((1 << tree_depth(documents)) - 1):
        a, b = spans[i]
        spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return spans


class Rows:
    """Sparse vectors, row by row; every row has an entry."""

    def __init__(self, start: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.start, self.cols, self.vals = start, cols, vals

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        start = np.append(0, np.cumsum(size))
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.cols[at], self.vals[at])

    def times(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.vals * vector[self.cols], self.start[:-1])

    def row(self, i: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        span = slice(self.start[i], self.start[i + 1])
        out[self.cols[span]] = self.vals[span]
        return out


def tree_order(rows: Rows, size: int) -> np.ndarray:
    """The order of the rows in which every node's documents lie together."""
    order = np.arange(len(rows.start) - 1)
    squares = np.add.reduceat(rows.vals.astype(float) ** 2, rows.start[:-1])
    spans = node_spans(len(order))
    for a, b in spans[:len(spans) // 2]:
        mine = order[a:b]
        part = rows.take(mine)
        centre = np.bincount(part.cols, part.vals, size) / len(mine)
        one = int(np.argmax(squares[mine] - 2 * part.times(centre)))
        left = part.row(one, size)
        two = int(np.argmax(squares[mine] - 2 * part.times(left)))
        along = part.times(part.row(two, size) - left)
        order[a:b] = mine[np.argsort(along, kind="stable")]
    return order


def term_groups(rows: Rows, size: int) -> np.ndarray:
    """Group of each term: the strongest terms have one of their own, the others share."""
    by = np.argsort(-np.bincount(rows.cols, rows.vals.astype(float) ** 2, size), kind="stable")
    own = min(size, GROUPS // 2)
    out = np.empty(size, np.int32)
    out[by[:own]] = np.arange(own)
    out[by[own:]] = own + np.arange(size - own) * (GROUPS - own) // max(size - own, 1)
    return out


def balls(rows: Rows, size: int, group: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(centres, radii) of all nodes of rows in tree order: centres are (node, term, whole number)
    by term, without zeros; radii are whole numbers for each node and group, rounded up."""
    centres, radii = [], []
    many = np.bincount(group, minlength=GROUPS).max()
    for node, (a, b) in enumerate(node_spans(len(rows.start) - 1)):
        span = slice(rows.start[a], rows.start[b])
        cols, vals = rows.cols[span], rows.vals[span]
        centre = np.rint(np.bincount(cols, vals, size) / max(b - a, 1)).astype(np.int64)
        row = np.repeat(np.arange(b - a), np.diff(rows.start[a:b + 1]))
        cell, value = row * GROUPS + group[cols], vals * (vals - 2 * centre[cols])
        if 3e12 * many < _EXACT:               # entries lie below 10 ** 6: sums are exact
            apart = np.bincount(cell, value, (b - a) * GROUPS)
            base = np.bincount(group, centre.astype(float) ** 2, GROUPS)
        else:
            apart, base = np.zeros((b - a) * GROUPS, np.int64), np.zeros(GROUPS, np.int64)
            np.add.at(apart, cell, value)
            np.add.at(base, group, centre ** 2)
        far = (apart.reshape(b - a, GROUPS) + base).max(axis=0).astype(float)
        some = np.flatnonzero(centre)
        centres.append((np.full(len(some), node), some, centre[some]))
        radii.append(np.ceil(np.sqrt(np.maximum(far, 0)) * RAISED))
    parts = [np.concatenate(x) for x in zip(*centres)]
    by = np.argsort(parts[1], kind="stable")
    return [x[by] for x in parts], np.array(radii)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows in order, one tree each."""
    held: list[pa.RecordBatch] = []
    number = 0

    def blocks(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, number
        table = pa.Table.from_batches(held).combine_chunks()
        entries = np.cumsum(pc.list_value_length(table.column("terms")).to_numpy())
        at = 0
        while at < len(entries):
            used = entries[at - 1] if at else 0
            end = min(at + BLOCK, max(at + 1, int(np.searchsorted(entries, used + BLOCK_ENTRIES, "right"))))
            if end == len(entries) and not last:
                break
            yield _block(table.slice(at, end - at), (TaskContext.get().partitionId() << 32) + number)
            number, at = number + 1, end
        held = table.slice(at).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) > 2 * BLOCK:
                yield from blocks(last=False)
    if held:
        yield from blocks(last=True)


def _block(table: pa.Table, name: int) -> pa.RecordBatch:
    table = table.combine_chunks()
    terms, values = (table.column(c).chunk(0) for c in ("terms", "values"))
    coded = terms.flatten().dictionary_encode()
    size = len(coded.dictionary)
    start = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy()))
    rows = Rows(start, coded.indices.to_numpy().astype(np.int64), values.flatten().to_numpy())
    order = tree_order(rows, size)
    rows = rows.take(order)
    group = term_groups(rows, size)
    (node, col, centre), radii = balls(rows, size, group)
    root = np.zeros(size, np.int64)
    root[col[node == 0]] = centre[node == 0]
    arrays = {
        "ids": table.column("id").take(pa.array(order)), "vocabulary": coded.dictionary.cast(pa.string()),
        "start": rows.start, "cols": rows.cols, "vals": rows.vals,
        "centre_start": np.searchsorted(col, np.arange(size + 1)), "centre_node": node,
        "centre": centre, "radius": radii.reshape(-1), "term_group": group, "root": root}
    kinds = {"ids": pa.int64(), "vocabulary": pa.string(), "radius": pa.float64(),
             "vals": pa.int32(), "centre": pa.int32(), "root": pa.int32()}
    out = [pa.array([name], pa.int64())]
    for key, values in arrays.items():
        kind = kinds.get(key, pa.int32())
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        values = values if isinstance(values, pa.Array) else pa.array(values)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
    return pa.RecordBatch.from_arrays(out, ["block", *arrays])


_INDEX = ("block long, ids array<long>, vocabulary array<string>, start array<int>, cols array<int>, "
          "vals array<int>, centre_start array<int>, centre_node array<int>, centre array<int>, "
          "radius array<double>, term_group array<int>, root array<int>")


# --- the search ----------------------------------------------------------------------------
class Questions:
    """Questions of a group: who asks, which terms, which weights."""

    def __init__(self, table: pa.Table):
        terms = table.column("terms").combine_chunks()
        self.q = table.column("q").to_numpy()
        self.row = np.repeat(np.arange(len(self.q)), pc.list_value_length(terms).to_numpy())
        self.terms = terms.flatten()
        self.weights = table.column("weights").combine_chunks().flatten().to_numpy()

    def within(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, column, weight) of the terms that a block knows."""
        col = pc.fill_null(pc.index_in(self.terms, value_set=vocabulary), -1).to_numpy()
        known = col >= 0
        return self.row[known], col[known].astype(np.int64), self.weights[known]

    def norms(self, row: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(questions x groups) lengths of the questions in each group."""
        cells = np.bincount(row * GROUPS + group, weight.astype(float) ** 2, len(self.q) * GROUPS)
        return np.sqrt(cells).reshape(-1, GROUPS)


def root_bounds(questions: Questions, vocabulary: pa.Array, group: np.ndarray, root: np.ndarray,
                radius: np.ndarray) -> np.ndarray:
    """What each question can score in a block at most."""
    row, col, weight = questions.within(vocabulary)
    middle = np.bincount(row, weight * root[col].astype(float), len(questions.q))
    return (middle + questions.norms(row, group[col], weight) @ radius) * RAISED


class Block:
    """One tree, read back from its row."""

    def __init__(self, table: pa.Table):
        def column(name):
            return table.column(name).combine_chunks().flatten()
        self.ids, self.vocabulary = column("ids"), column("vocabulary")
        numbers = {c: column(c).to_numpy() for c in (
            "start", "cols", "vals", "centre_start", "centre_node", "centre", "radius", "term_group")}
        self.rows = Rows(numbers["start"], numbers["cols"], numbers["vals"].astype(np.int64))
        self.centre_start, self.node = numbers["centre_start"], numbers["centre_node"]
        self.centre, self.group = numbers["centre"].astype(float), numbers["term_group"]
        self.radius = numbers["radius"].reshape(-1, GROUPS)
        self.spans = node_spans(len(self.ids))

    def bounds(self, questions: Questions, row, col, weight) -> np.ndarray:
        """(questions x nodes): no document below a node scores more."""
        nodes = len(self.spans)
        many = np.diff(self.centre_start)[col]
        each = np.repeat(np.arange(len(col)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.centre_start[col][each]
        middle = np.bincount(row[each] * nodes + self.node[at], weight[each] * self.centre[at],
                             len(questions.q) * nodes).reshape(-1, nodes)
        return (middle + questions.norms(row, self.group[col], weight) @ self.radius.T) * RAISED

    def search(self, questions: Questions, least: np.ndarray, k: int):
        """(question, document, score) of the k best of each question that score `least` or more,
        with ties of the k-th; and the number of documents scored."""
        row, col, weight = questions.within(self.vocabulary)
        bounds = self.bounds(questions, row, col, weight)
        weights = np.zeros(len(self.vocabulary), np.int64)
        first = np.searchsorted(row, np.arange(len(questions.q) + 1))
        scored, found = 0, []
        for q in range(len(questions.q)):
            mine = slice(first[q], first[q + 1])
            if bounds[q, 0] < least[q] or first[q] == first[q + 1]:
                continue
            np.add.at(weights, col[mine], weight[mine])
            places, scores, below = self._best_first(bounds[q], weights, int(least[q]), k)
            weights[col[mine]] = 0
            scored += below
            found.append((np.full(len(places), q), places, scores))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), scored
        return *(np.concatenate(x) for x in zip(*found)), scored

    def _best_first(self, bounds: np.ndarray, weights: np.ndarray, least: int, k: int):
        inner = len(self.spans) // 2
        nodes, kth, below = [(-bounds[0], 0)], [], 0
        places, scores = [], []
        while nodes and -nodes[0][0] >= least:
            bound, node = heapq.heappop(nodes)
            if node < inner:
                for child in (2 * node + 1, 2 * node + 2):
                    value = min(-bound, bounds[child])
                    if value >= least:
                        heapq.heappush(nodes, (-value, child))
                continue
            a, b = self.spans[node]
            if a == b:
                continue
            s = self.rows.start[a]
            span = slice(s, self.rows.start[b])
            score = np.add.reduceat(self.rows.vals[span] * weights[self.rows.cols[span]],
                                    self.rows.start[a:b] - s)
            below += b - a
            good = np.flatnonzero(score >= least)
            places.append(a + good)
            scores.append(score[good])
            for x in score[good].tolist():
                if len(kth) < k:
                    heapq.heappush(kth, x)
                elif x > kth[0]:
                    heapq.heapreplace(kth, x)
            if len(kth) == k:
                least = max(least, kth[0])
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        keep = scores >= least
        return places[keep], scores[keep], below


def _searched(k: int):
    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
               "score": pa.array([], pa.int64())}
        if blocks.num_rows and asked.num_rows:
            block, questions = Block(blocks), Questions(asked)
            q, place, score, _ = block.search(questions, asked.column("least").to_numpy(), k)
            last = np.iinfo(np.int64).max
            ids = pc.fill_null(block.ids, last).to_numpy()
            by = np.lexsort((ids[place], -score, q))
            first = np.searchsorted(q[by], np.arange(len(questions.q)))
            by = by[np.arange(len(by)) - first[q[by]] < k]   # ids decide among ties
            out = {"q": questions.q[q[by]], "id": block.ids.take(pa.array(place[by])),
                   "score": score[by]}
        return pa.table(out)
    return search


def _promised(roots: pa.Table, asked: pa.Table) -> pa.Table:
    out = [pa.table({"q": pa.array([], pa.int64()), "block": pa.array([], pa.int64()),
                     "bound": pa.array([], pa.float64())})]
    if roots.num_rows and asked.num_rows:
        questions = Questions(asked)
        for i in range(roots.num_rows):
            one = {c: roots.column(c).combine_chunks().slice(i, 1).flatten()
                   for c in ("vocabulary", "term_group", "root", "root_radius")}
            bound = root_bounds(questions, one["vocabulary"], one["term_group"].to_numpy(),
                                one["root"].to_numpy(), one["root_radius"].to_numpy())
            some = np.flatnonzero(bound >= 1)
            out.append(pa.table({"q": questions.q[some], "bound": bound[some], "block": pa.array(
                np.full(len(some), roots.column("block")[i].as_py()))}).select(out[0].column_names))
    return pa.concat_tables(out)


class Index:
    """Blocks of a table of documents, and the questions they are searched for."""

    def __init__(self, blocks: DataFrame, asked: DataFrame, groups: int, k: int):
        self.blocks, self.asked, self.groups, self.k = blocks, asked, groups, k

    def promises(self) -> DataFrame:
        """(q, block, bound) for the blocks in which a question can score at all."""
        roots = self.blocks.select(
            "block", F.pmod(F.xxhash64("block"), F.lit(self._tiles())).alias("tile"),
            "vocabulary", "term_group", "root",
            F.slice("radius", 1, GROUPS).alias("root_radius"),
            F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("g"))
        asked = self.asked.withColumn("tile", F.explode(F.expr(f"sequence(0L, {self._tiles() - 1}L)")))
        return roots.groupBy("tile", "g").cogroup(asked.groupBy("tile", "g")).applyInArrow(
            _promised, "q long, block long, bound double")

    def _tiles(self) -> int:
        if not hasattr(self, "_tile_count"):
            self._tile_count = max(1, math.ceil(self.blocks.count() / ROOTS_TOGETHER))
        return self._tile_count

    def search(self, pairs: DataFrame) -> DataFrame:
        """(q, id, score): of each pair (q, block, least), the k best of `least` or more."""
        right = pairs.join(self.asked, "q").select("block", "g", "q", "terms", "weights", "least")
        wanted = pairs.join(self.asked.select("q", "g"), "q").select(
            F.col("block").alias("b"), F.col("g").alias("of")).distinct()
        left = self.blocks.join(wanted, F.col("block") == F.col("b"))
        return left.groupBy("b", "of").cogroup(right.groupBy("block", "g")).applyInArrow(
            _searched(self.k), "q long, id long, score long")


def weighted_questions(asked: DataFrame, counted: DataFrame, documents: int) -> DataFrame:
    """(q, terms, weights): counts times the weight of each term that a document holds."""
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    terms = asked.select("q", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "q", F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    return terms.join(held, "term").select("q", F.struct(
        "term", (F.col("c") * weight).alias("w")).alias("t")).groupBy("q").agg(
        F.array_sort(F.collect_list("t")).alias("t")).select(
        "q", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))


def index_blocks(counted: DataFrame, documents: int, terms: int) -> DataFrame:
    """One row for each block of documents: its tree."""
    m = f"25 + cast(75 * cast(n as decimal(20,0)) * {documents} div {terms} as bigint)"
    rows = counted.where("size(terms) > 0").withColumn("m", F.expr(m))
    value = "transform(counts, c -> (1000000000 * c) div (1000 * c + 8 * m))"
    rows = rows.select("id", "terms", F.expr(value).alias("values"),
                       F.floor(F.log2("n")).alias("band"), "h1", "h2", F.rand(11).alias("salt"))
    by = ["band", "h1", "h2", "salt"]
    spark = counted.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                math.ceil(documents / RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return written(dealt.select("id", "terms", "values").mapInArrow(_build, _INDEX), "ball-trees")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest positive score of each item.

    Terms are runs of 0-9, letters A-Z as a-z, and characters from U+0080 on. With N documents of
    L terms in all, df documents that hold a term, tf occurrences among the n terms of one, and
    m = 25 + (75 n N) div L, a term of weight w = floor(1000 ln((2 N + 2) / (2 df + 1))) adds
    w ((10^9 tf) div (1000 tf + 8 m)) for each of its occurrences in the item.
    """
    small_batches(docs)
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    texts = written(texts.groupBy("item_id").agg(F.min("text").alias("text")).withColumn(
        "id", F.monotonically_increasing_id()), "items")
    asked = _counted(texts.select("id", "text"), None).select(F.col("id").alias("q"), "terms", "counts")
    source = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = written(_counted(source, _bitmap(texts)), "term-counts")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    weighted = written(weighted_questions(asked, counted, total["documents"]), "questions")
    size = weighted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = 1 + size // GROUP_ENTRIES
    weighted = weighted.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
    index = Index(index_blocks(counted, total["documents"], max(total["terms"], 1)),
                  weighted, groups, k)

    promises = written(index.promises(), "promises")
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    placed = promises.withColumn("r", F.row_number().over(best))
    first = placed.where(F.col("r") <= FIRST_BLOCKS).select("q", "block")
    hits = written(index.search(first.withColumn("least", F.lit(1).cast("long"))), "first-hits")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    kth = hits.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select(
        "q", F.col("score").alias("kth"))
    rest = promises.join(first, ["q", "block"], "left_anti").join(kth, "q", "left").withColumn(
        "least", F.coalesce("kth", F.lit(1))).where("bound >= least").select("q", "block", "least")
    hits = hits.unionByName(index.search(written(rest, "open-blocks")))
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).join(
        texts.select(F.col("id").alias("q"), "item_id"), "q").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")

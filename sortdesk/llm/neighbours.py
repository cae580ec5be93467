"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are brought to length one, so the largest cosine is the least distance. Each table
hashes a vector to floor((a . x + b) / width) for a few random normal directions. A query visits
its own bucket and, in order of estimated success, those reached by moving single hash values
to the next one: a set of moves is scored by the squared distances to the edges it crosses.
Candidates of all tables are ranked by exact cosine on the original vectors.

Buckets are cut into blocks of bounded size by a hash of the id, and so are the queries that
visit them. A block of vectors meets a block of queries as one matrix product in one task, and
only the best k of each query leave it: no candidate pairs are built, a bucket that holds a third
of all vectors is spread over many tasks, and no bucket is cut short.

Equal vectors take part as one row with their k + 1 least ids, more than any query can use. The
matrix product only sorts out: all vectors within MARGIN of a query's k-th score stay, and the
cosine that ranks them is summed in one order for every pair.

Queries that meet fewer than k candidates in their buckets meet all vectors, in the same blocks.

How many hashes, tables and probes, and how wide, is fitted: the true neighbours of FIT_QUERIES
vectors are found exactly, and of a grid of settings the cheapest is taken with which FIT_RECALL of
them are met. What a setting costs follows from the share of FIT_ROWS sampled vectors that its probes
meet, and from the number of vectors: in larger tables more hashes pay, so the candidates of a query
grow more slowly than the table, as far as its vectors lie in clusters. Where no setting of the grid
is met by enough neighbours, the one of best recall is taken. Settings can be given instead.

The directions come from a seed, so results do not change.

Defined results. Vectors that are null, of another dimension than most, zero, or hold null or
non-finite numbers take no part. Rows with a null id are left out. Repeated ids: the first of
equal ids by content is taken. Ties go to the smaller id. Fewer other vectors than k: all of them.
Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import as_long, written

TABLES, HASHES, WIDTH, PROBES = 6, 4, 1.5, 16
#: Bounded samples for fitting, and the recall that is fitted for (0.9 is what is promised).
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 2048, 64, 0.95
#: The grid: widths are shares of the mean distance of the true neighbours.
GRID_HASHES, GRID_WIDTHS, GRID_TABLES, GRID_PROBES = (
    (2, 3, 4, 6, 8, 11, 14), (1.0, 2.0, 3.0), (1, 2, 3, 4, 6, 8), (1, 2, 4, 8, 16, 32, 64))
#: Costs in candidates: a row of the index, a probe.
ROW_COST, PROBE_COST = 150.0, 100.0
#: Single moves of a query that are combined in a table.
MOVES = 10
BLOCK_VECTORS, BLOCK_QUERIES = 512, 256
#: Far above the rounding of a matrix product.
MARGIN = 1e-9


class Hashing:
    """Random normal directions of all tables, and the probing order of queries."""

    def __init__(self, dimension: int, tables: int, hashes: int, width: float, probes: int,
                 seed: int):
        draw = np.random.default_rng(seed)
        self.directions = draw.standard_normal((tables, dimension, hashes))
        self.offsets = draw.uniform(0, width, (tables, 1, hashes))
        self.width, self.probes = width, probes
        self.some = min(MOVES, 2 * hashes)
        #: (sets x moves) which of the cheapest single moves a set makes
        self.sets = (np.arange(1 << self.some)[:, None] >> np.arange(self.some) & 1).astype(bool)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(tables x rows x hashes), before rounding down."""
        return (np.einsum("nd,tdh->tnh", unit, self.directions) + self.offsets) / self.width

    def probe(self, places: np.ndarray) -> np.ndarray:
        """(tables x rows x probes x hashes) bucket values, likeliest first: sets of the cheapest
        moves of one value to the next, none of a value both ways, by summed squared distance.
        Where there are fewer sets than probes, the own bucket takes the places left."""
        low = np.floor(places)
        h = places.shape[2]
        cost = np.concatenate([(places - low) ** 2, (low + 1 - places) ** 2], axis=2)
        move = np.argsort(cost, axis=2, kind="stable")[:, :, :self.some]
        cost = np.take_along_axis(cost, move, axis=2)
        total = cost @ self.sets.T.astype(float)
        value, step = move % h, np.where(move < h, -1, 1)
        both = np.triu(value[..., :, None] == value[..., None, :], 1)
        for i, j in np.argwhere(np.triu(np.ones((self.some, self.some), bool), 1)):
            clash = both[..., i, j]
            if clash.any():
                total[clash[..., None] & (self.sets[:, i] & self.sets[:, j])] = np.inf
        many = min(self.probes, total.shape[2])
        best = np.argsort(total, axis=2, kind="stable")[:, :, :many]
        best = np.where(np.isinf(np.take_along_axis(total, best, axis=2)), 0, best)
        out = np.repeat(low[:, :, None, :], many, axis=2)
        for i in range(self.some):
            used = self.sets[best, i]
            np.put_along_axis(out, np.broadcast_to(value[:, :, None, i, None], (*best.shape, 1)), np.where(
                used, step[:, :, None, i], 0)[..., None] + np.take_along_axis(
                out, np.broadcast_to(value[:, :, None, i, None], (*best.shape, 1)), axis=3), axis=3)
        return out


def _bucket(values: np.ndarray) -> np.ndarray:
    """One number for the table and its hash values; equal values, equal number."""
    tables = np.arange(values.shape[0]).reshape(-1, *[1] * (values.ndim - 2))
    out = np.broadcast_to(tables, values.shape[:-1]).astype(np.int64)
    with np.errstate(over="ignore"):
        for h in range(values.shape[-1]):       # modulo 2 ** 64; equal numbers only add candidates
            out = out * 6364136223846793005 + (values[..., h].astype(np.int64) + 2046)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles): vectors that take part."""
    rows = vectors.select(as_long(id_col).alias("id"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where("id is not null and vector is not null and size(vector) > 0").where(
        "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").where(
        "exists(vector, x -> x <> 0)")
    return good.groupBy("id").agg(F.min("vector").alias("vector"))


def distinct_vectors(base: DataFrame, n: int) -> DataFrame:
    """(id, vector, ids): equal vectors once, with their n least ids, id the least."""
    least = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = base.withColumn("r", least).where(F.col("r") <= n)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("id"), "vector", "ids")


# --- settings ------------------------------------------------------------------------------
class Setting:
    """Hashes, width, tables and probes, with what the samples say of them."""

    def __init__(self, hashes: int = HASHES, width: float = WIDTH, tables: int = TABLES,
                 probes: int = PROBES, recall: float | None = None, share: float | None = None):
        self.hashes, self.width, self.tables, self.probes = hashes, width, tables, probes
        self.recall, self.share = recall, share


def _first_probe(probes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the keys, the first of the probes that is it; len(probes) if none is."""
    order = np.argsort(probes, kind="stable")
    at = np.searchsorted(probes[order], keys)
    found = order[np.minimum(at, len(order) - 1)]
    return np.where(probes[found] == keys, found, len(probes))


def fitted(sample: np.ndarray, queries: np.ndarray, neighbours: list[np.ndarray], n: int, asked: int,
           seed: int) -> Setting:
    """The cheapest setting of the grid for `asked` queries among n vectors.

    sample: unit vectors; neighbours: the unit vectors that each of the queries should find.
    """
    owner = np.repeat(np.arange(len(queries)), [len(x) for x in neighbours])
    true = np.concatenate(neighbours) if len(owner) else np.zeros((0, sample.shape[1]))
    if not len(true):
        return Setting()
    apart = float(np.linalg.norm(true - queries[owner], axis=1).mean()) or WIDTH
    found: list[tuple] = []
    for hashes in GRID_HASHES:
        for width in GRID_WIDTHS:
            hashing = Hashing(sample.shape[1], max(GRID_TABLES), hashes, width * apart, max(GRID_PROBES), seed)
            probes = _bucket(hashing.probe(hashing.places(queries)))
            rows, goals = (_bucket(np.floor(hashing.places(x))) for x in (sample, true))
            met = np.stack([[_first_probe(probes[t, q], rows[t]) for q in range(len(queries))]
                            for t in range(max(GRID_TABLES))])
            hit = np.stack([[_first_probe(probes[t, owner[i]], goals[t, i:i + 1])[0] for i in range(len(true))]
                            for t in range(max(GRID_TABLES))])
            for tables in GRID_TABLES:
                for many in GRID_PROBES:
                    recall = float((hit[:tables].min(axis=0) < many).mean())
                    share = float((met[:tables] < many).mean() * tables)
                    cost = asked * (n * share + PROBE_COST * tables * many) + ROW_COST * n * tables
                    found.append((recall < FIT_RECALL, cost if recall >= FIT_RECALL else -recall, cost,
                                  len(found), Setting(hashes, width * apart, tables, many, recall, share)))
    return min(found)[4]


def _setting(base: DataFrame, asked: DataFrame, k: int, seed: int) -> Setting:
    """Fitted on bounded samples: rows of least hash."""
    def some(df: DataFrame, many: int) -> DataFrame:
        return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(many)
    n, m = base.count(), asked.count()
    if not n or not m:
        return Setting()
    few = written(some(asked, FIT_QUERIES), "fit-queries")
    everywhere = (x.select("id", F.lit(0).cast("long").alias("bucket")) for x in (base, few))
    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id")
    near = _met(base, few, *everywhere, k).withColumn("r", F.row_number().over(best)).where(
        F.col("r") <= k).join(base.select(F.col("id").alias("vec_id"), "vector"), "vec_id")
    by: dict[int, list] = {}
    for r in near.select("query_id", "vector").collect():      # FIT_QUERIES * k rows
        by.setdefault(r["query_id"], []).append(r["vector"])
    rows = {r["id"]: r["vector"] for r in few.select("id", "vector").collect()}
    queries = [i for i in rows if i in by]
    if not queries:
        return Setting()
    sample = np.array([r["vector"] for r in some(base, FIT_ROWS).select("vector").collect()])
    return fitted(_unit(sample), _unit(np.array([rows[i] for i in queries])),
                  [_unit(np.array(by[i])) for i in queries], n, m, seed)


# --- tables --------------------------------------------------------------------------------
def _index(hashing: Hashing):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _bucket(np.floor(hashing.places(_unit(_matrix(batch.column("vector"))))))
            yield _flat(batch, keys.reshape(len(keys), batch.num_rows, 1))
    return index


def _visits(hashing: Hashing):
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                places = hashing.places(_unit(_matrix(batch.column("vector"))))
                rows = _flat(batch, _bucket(hashing.probe(places)))
                yield pa.Table.from_batches([rows]).group_by(["id", "bucket"]).aggregate(
                    []).combine_chunks().to_batches()[0].select(["id", "bucket"])
    return visits


def _flat(batch: pa.RecordBatch, keys: np.ndarray) -> pa.RecordBatch:
    """(id, bucket) rows of keys (tables x rows x probes)."""
    ids = np.broadcast_to(batch.column("id").to_numpy()[None, :, None], keys.shape)
    return pa.RecordBatch.from_arrays([pa.array(ids.reshape(-1)), pa.array(keys.reshape(-1))],
                                      ["id", "bucket"])


def _best(k: int):
    """Vectors of each query block and vector block that can be among a query's best k."""
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            x, q = (_matrix(t.column("vector").combine_chunks()) for t in (left, right))
            ids, qids = (t.column("id").to_numpy() for t in (left, right))
            alone = left.column("alone").to_numpy()
            score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
            score[(qids[:, None] == ids[None, :]) & alone] = -np.inf
            n = min(k, len(ids))
            kth = -np.partition(-score, n - 1, axis=1)[:, n - 1:n]
            row, at = np.nonzero((score >= kth - MARGIN) & np.isfinite(score))
            out.append(pa.table({"query_id": qids[row], "vec_id": ids[at], "score": score[row, at]}))
        return pa.concat_tables(out)
    return best


def _met(base: DataFrame, asked: DataFrame, rows: DataFrame, visits: DataFrame,
         k: int) -> DataFrame:
    """(query_id, vec_id, rough): vectors of the buckets that a query visits which can be among
    its best k. rows and visits: (id, bucket)."""
    load = rows.groupBy("bucket").agg(F.count("*").alias("n")).join(
        visits.groupBy("bucket").agg(F.count("*").alias("q")), "bucket")
    load = written(load.select("bucket", F.ceil(F.col("n") / BLOCK_VECTORS).alias("vb"),
                               F.ceil(F.col("q") / BLOCK_QUERIES).alias("qb")), "buckets")
    left = rows.join(load, "bucket").withColumn("v", F.pmod(F.xxhash64("id"), "vb")).withColumn(
        "q", F.explode(F.expr("sequence(0L, qb - 1)")))
    right = visits.join(load, "bucket").withColumn("q", F.pmod(F.xxhash64("id"), "qb")).withColumn(
        "v", F.explode(F.expr("sequence(0L, vb - 1)")))
    side = ["bucket", "v", "q"]
    left = left.select(*side, "id").join(base, "id").select(
        *side, "id", "vector", (F.size("ids") == 1).alias("alone"))
    right = right.select(*side, "id").join(asked, "id").select(*side, "id", "vector")
    found = left.groupBy(*side).cogroup(right.groupBy(*side)).applyInArrow(
        _best(k), "query_id long, vec_id long, score double")
    return written(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("rough")), "found")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", setting: Setting | None = None, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine of each query row.

    A vector is no candidate of a query with its own id. Without a setting, one is fitted.
    """
    base, asked = (usable_vectors(df, id_col, vector_col) for df in (vectors, queries))
    sizes = base.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    dimension = common["d"] if common else 1
    base, asked = (df.where(F.size("vector") == dimension) for df in (base, asked))
    base = written(distinct_vectors(base, k + 1), "vectors")
    asked = written(asked, "queries")
    setting = setting or _setting(base, asked, k, seed)
    hashing = Hashing(dimension, setting.tables, setting.hashes, setting.width, setting.probes, seed)

    found = _met(base, asked, base.mapInArrow(_index(hashing), "id long, bucket long"),
                 asked.mapInArrow(_visits(hashing), "id long, bucket long"), k)
    others = F.size(F.array_remove("ids", F.col("query_id")))
    enough = found.join(base.select(F.col("id").alias("vec_id"), "ids"), "vec_id").groupBy(
        "query_id").agg(F.sum(others).alias("n")).where(F.col("n") >= k)
    short = written(asked.select("id").join(
        enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if not short.isEmpty():
        everywhere = (x.select("id", F.lit(0).cast("long").alias("bucket")) for x in (base, short))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti"
                           ).unionByName(_met(base, asked, *everywhere, k))

    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id")
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(
        "query_id").agg(F.count("*").alias("n"), F.min("rough").alias("kth"))
    near = found.join(kth, "query_id").where(
        (F.col("n") < k) | (F.col("rough") >= F.col("kth") - MARGIN))
    # the contract's measure, summed in one order for every pair
    pairs = near.join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("x")),
                      "query_id").join(base.select(F.col("id").alias("vec_id"), "ids",
                                                   F.col("vector").alias("y")), "vec_id")
    pairs = pairs.select("query_id", "ids", F.expr("""
        aggregate(zip_with(x, y, (a, b) -> a * b), 0d, (s, v) -> s + v)
        / (sqrt(aggregate(x, 0d, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0d, (s, v) -> s + v * v)))
        """).alias("score"))
    pairs = pairs.select("query_id", F.explode("ids").alias("vec_id"), "score").where(
        "query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

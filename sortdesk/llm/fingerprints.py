"""Near duplicates by 64-bit simhash and the generalised pigeonhole principle.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Two
documents are linked if their fingerprints differ in at most `distance` bits.

Fingerprints are met once each. Their bits are grouped into a few partitions, correlated bits
together, and every fingerprint gets one threshold for each partition. If the thresholds of a
fingerprint sum to distance - partitions + 1 (a threshold of -1 leaves the partition out), each
fingerprint within the distance agrees with it in one partition up to that partition's threshold.
Thresholds are allocated by dynamic programming on the candidates they would meet: counts of
partition values at every distance, from a bounded table of value counts (partitions wider than
SUB_BITS are estimated from narrower ones, as if these were independent). The number of partitions
follows the number of fingerprints in the same way: few wide ones in large tables.

Every fingerprint lies in the bucket of its value in each partition and probes the buckets within
its thresholds. A bucket's probes meet its members in numpy, every candidate is verified on all
bits, and a task emits a spanning forest of the links it finds instead of all of them. Larger
buckets are cut into blocks of at most BLOCK rows on average, and each block of probes meets each
block of members, so no task holds a whole hot bucket and no pair is dropped.

Defined results. Null or word-less texts: fingerprint zero, linked like any other. Null id: no
component, and no part in links. Rows of one id are one document: what links one row links all
of them. Repeated rows: each gets the same result. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import roots
from .store import as_long, small_batches, written
from .words import SPACED, Words, cut, slices

BITS = 64
SUB_BITS = 16
#: Rows of each role in one block of a bucket.
BLOCK = 1024
#: Bits counted, and candidates verified, at once.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 21
#: What a probe costs in candidates: it is shuffled and sorted, a candidate is one operation.
PROBE_COST = 16.0
_U = np.uint64
#: Roles of a row in its bucket.
MEMBER, PROBE = 1, 2


# --- fingerprints --------------------------------------------------------------------------
def shingle_hashes(words: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64) of every shingle of k words joined by one space, in order; a row of fewer
    words has its whole sequence as its one shingle, a row without words none."""
    size = words.end - words.start
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = (
        words.data[SPACED[words.data]])
    counts = words.counts
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][row]
    last = first + np.minimum(counts, k)[row] - 1
    view = memoryview(joined)
    spans = zip(begin[first].tolist(), (begin[last] + size[last]).tolist())
    return row, np.fromiter((xxh64_intdigest(view[a:b], seed) for a, b in spans), _U, len(row))


def majority_bits(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of each row: bits set in over half of its hashes, rows in order."""
    ones = np.zeros((rows, BITS), np.int64)
    for at in range(0, len(row), SHINGLES_AT_ONCE):
        some = row[at:at + SHINGLES_AT_ONCE]
        starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        bits = bits_of(hashes[at:at + SHINGLES_AT_ONCE])
        ones[some[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = 2 * ones > np.bincount(row, minlength=rows)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(_U).reshape(-1)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(values x 64) bits, least significant first."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")


def _signer(k: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, hashes = shingle_hashes(cut(batch.column("text"), lower=True), k, seed)
            prints = majority_bits(row, hashes, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])
    return sign


# --- partitions and thresholds -------------------------------------------------------------
def grouped_bits(correlation: np.ndarray, partitions: int) -> list[np.ndarray]:
    """Bits in groups of nearly equal size; each next bit is the one of largest mean absolute
    correlation with its group, the first bit of a group the least correlated one left."""
    strength = np.abs(correlation)
    left, out = list(range(len(correlation))), []
    for i in range(partitions):
        size = len(left) // (partitions - i)
        group = [left.pop(int(np.argmin(strength[np.ix_(left, left)].sum(axis=1))))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(strength[np.ix_(left, group)].sum(axis=1)))))
        out.append(np.array(sorted(group)))
    return out


def sub_groups(group: np.ndarray) -> list[np.ndarray]:
    return np.array_split(group, math.ceil(len(group) / SUB_BITS))


def values_in(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number that the given bits of each fingerprint form."""
    out = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(bits):
        out |= ((fps >> _U(bit)) & _U(1)).astype(np.int64) << place
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, e) for e in range(radius + 1))


def shells(counts: np.ndarray, distance: int) -> np.ndarray:
    """(distance + 1 x values): how many lie at exactly each distance from each value."""
    out = np.zeros((distance + 1, len(counts)))
    out[0] = counts
    at = np.arange(len(counts))
    for bit in range(int(math.log2(len(counts)))):
        out[1:] += out[:-1, at ^ (1 << bit)]
    return out


def allocated(costs: np.ndarray, total: int) -> np.ndarray:
    """(rows x partitions) thresholds that sum to `total` at the least summed cost.

    costs: (partitions x thresholds from -1 on x rows)."""
    parts, options, rows = costs.shape
    spare = total + parts                      # thresholds counted from -1
    best = np.full((spare + 1, rows), np.inf)
    best[0] = 0
    taken = np.zeros((parts, spare + 1, rows), np.int8)
    for p in range(parts):
        new = np.full_like(best, np.inf)
        for used in range(spare + 1):
            for option in range(min(options, used + 1)):
                cost = best[used - option] + costs[p, option]
                less = cost < new[used]
                new[used][less] = cost[less]
                taken[p, used][less] = option
        best = new
    out = np.zeros((rows, parts), np.int64)
    used = np.full(rows, spare)
    for p in range(parts - 1, -1, -1):
        option = taken[p, used, np.arange(rows)].astype(np.int64)
        out[:, p] = option - 1
        used = used - option
    return out


def partitions_for(n: int, distance: int) -> int:
    """The number of partitions of least cost, were the values of n fingerprints uniform."""
    def cost(parts: int) -> float:
        widths = [len(x) for x in np.array_split(np.arange(BITS), parts)]
        costs = np.array([[[0.0], *([ball(w, e) * (PROBE_COST + n / 2 ** w)]
                                    for e in range(distance + 1))] for w in widths])
        used = allocated(costs, distance - parts + 1)[0]
        return sum(costs[p, e + 1, 0] for p, e in enumerate(used))
    return min(range(2, distance + 4), key=cost)


class Allocation:
    """Partitions, and the thresholds of any fingerprint in them."""

    def __init__(self, groups: list[np.ndarray], n: int, distance: int,
                 counted: dict[tuple[int, int], np.ndarray]):
        self.groups, self.n, self.distance = groups, n, distance
        self.subs = [sub_groups(g) for g in groups]
        self.shells = {key: shells(c, distance) for key, c in counted.items()}

    def met(self, fps: np.ndarray) -> np.ndarray:
        """(partitions x distances x fingerprints): estimated members within each distance."""
        out = []
        for p, subs in enumerate(self.subs):
            exact = None
            for s, bits in enumerate(subs):
                part = self.shells[p, s][:, values_in(fps, bits)]
                exact = part if exact is None else np.array([
                    sum(exact[a] * part[e - a] for a in range(e + 1)) / max(self.n, 1)
                    for e in range(self.distance + 1)])
            out.append(np.cumsum(exact, axis=0))
        return np.array(out)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        probes = np.array([[ball(len(g), e) for e in range(self.distance + 1)]
                           for g in self.groups])
        costs = self.met(fps) + PROBE_COST * probes[:, :, None]
        none = np.zeros((len(self.groups), 1, len(fps)))
        return allocated(np.concatenate([none, costs], axis=1),
                         self.distance - len(self.groups) + 1)

    def rows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, fingerprint, roles): members of their own buckets, probes within thresholds."""
        allowed = self.thresholds(fps)
        out = []
        for p, bits in enumerate(self.groups):
            own = values_in(fps, bits)
            roles = np.where(allowed[:, p] >= 0, MEMBER | PROBE, MEMBER)
            out.append((own, fps, roles, p))
            for radius in range(1, self.distance + 1):
                far = allowed[:, p] >= radius
                if far.any():
                    moves = _moves(len(bits), radius)
                    out.append(((own[far][:, None] ^ moves).reshape(-1),
                                np.repeat(fps[far], len(moves)),
                                np.full(int(far.sum()) * len(moves), PROBE), p))
        bucket = np.concatenate([value | (p << 48) for value, _, _, p in out])
        return bucket, np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])


def _moves(width: int, radius: int) -> np.ndarray:
    """Every number of `radius` bits among `width`."""
    moves = np.zeros(1, np.int64)
    highest = np.full(1, -1)
    for _ in range(radius):
        bit = np.arange(width)
        later = bit[None, :] > highest[:, None]
        moves = (moves[:, None] | (1 << bit)[None, :])[later]
        highest = np.broadcast_to(bit, later.shape)[later]
    return moves


# --- links ---------------------------------------------------------------------------------
def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the edges (u, v) join, at most one for each end."""
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    moved = np.flatnonzero(label != np.arange(len(ends)))
    return ends[moved], ends[label[moved]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, fingerprint, role) of whole buckets, as many as a batch ends."""
    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("bucket", "i", "j", "fp", "role")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        new = np.zeros(len(rows[0]), bool)
        for x in rows[:3]:
            new[1:] |= x[1:] != x[:-1]
        if new.any():
            last = int(np.flatnonzero(new)[-1])
            yield np.cumsum(new[:last]), rows[3][:last], rows[4][:last]
            rows = [x[last:] for x in rows]
        held = rows
    if held is not None and len(held[0]):
        yield np.zeros(len(held[0]), np.int64), held[3], held[4]


def _verified(distance: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, fp, role in _runs(batches):
            fp = fp.view(_U)
            members, probes = np.flatnonzero(role & MEMBER), np.flatnonzero(role & PROBE)
            first = np.searchsorted(run[members], run[probes])
            many = np.searchsorted(run[members], run[probes], side="right") - first
            found = []
            done = np.append(0, np.cumsum(many))
            at = 0
            while at < len(probes):
                to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
                n = many[at:to]
                left = np.repeat(fp[probes[at:to]], n)
                place = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
                right = fp[members[place]]
                apart = np.bitwise_count(left ^ right)
                ok = (apart > 0) & (apart <= distance)
                found.append((left[ok], right[ok]))
                at = to
            u, v = forest(*(np.concatenate(x) for x in zip(*found))) if found else (fp[:0], fp[:0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return verify


def _correlation(fps: DataFrame, n: int) -> np.ndarray:
    """64 x 64 correlations of the bits, counted in one pass."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = bits_of(batch.column("fp").to_numpy()).astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS)), pa.array(total.reshape(-1).astype(np.int64))],
            ["cell", "n"])

    counted = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for r in counted.collect():                # 4,096 rows
        both[r["cell"]] = r["n"]
    both = both.reshape(BITS, BITS) / max(n, 1)
    mean = np.diag(both)
    spread = np.sqrt(mean * (1 - mean))
    return (both - np.outer(mean, mean)) / np.maximum(np.outer(spread, spread), 1e-9)


def _counted(fps: DataFrame, groups: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """How many fingerprints have each value of each sub-partition: at most 64 / SUB_BITS + 2
    tables of 2 ** SUB_BITS numbers."""
    subs = [(p, s, bits) for p, g in enumerate(groups) for s, bits in enumerate(sub_groups(g))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("fp").to_numpy().view(_U)
            for at, (_, _, bits) in enumerate(subs):
                value, n = np.unique(values_in(found, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), at)), pa.array(value), pa.array(n)],
                    ["sub", "value", "n"])

    table = fps.select("fp").mapInArrow(count, "sub long, value long, n long").groupBy(
        "sub", "value").agg(F.sum("n").alias("n")).toArrow()
    sub, value, n = (table.column(c).to_numpy() for c in ("sub", "value", "n"))
    out = {}
    for at, (p, s, bits) in enumerate(subs):
        out[p, s] = np.zeros(1 << len(bits))
        out[p, s][value[sub == at]] = n[sub == at]
    return out


def allocation(fps: DataFrame, distance: int = 3) -> Allocation:
    """Partitions and threshold costs for a table of distinct fingerprints (fp)."""
    n = fps.count()
    groups = grouped_bits(_correlation(fps, n), partitions_for(n, distance))
    return Allocation(groups, n, distance, _counted(fps, groups))


def hamming_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): pairs of the distinct fingerprints (fp) that differ in 1 to `distance` bits, as
    many of them as it takes to join all that such pairs join."""
    if not 1 <= distance <= 8:
        raise ValueError("distance must lie between 1 and 8")
    plan = fps.sparkSession.sparkContext.broadcast(allocation(fps, distance))  # at most 20 MB

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(_U)
            for at in range(0, len(fp), 4096):
                bucket, found, role = plan.value.rows(fp[at:at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(found.view(np.int64)),
                     pa.array(role.astype(np.int8))], ["bucket", "fp", "role"])

    rows = written(fps.select("fp").mapInArrow(place, "bucket long, fp long, role byte"), "probes")
    member, probe = F.expr(f"role & {MEMBER}") > 0, F.expr(f"role & {PROBE}") > 0
    hot = rows.groupBy("bucket").agg(
        F.ceil(F.count_if(member) / BLOCK).alias("ib"), F.ceil(F.count_if(probe) / BLOCK).alias("jb")
    ).where("ib > 1 or jb > 1")
    hot = written(hot.where("ib > 0 and jb > 0"), "hot-buckets")
    all_rows = rows.join(hot, "bucket", "left")
    some = all_rows.where("ib is null").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"),
                                               "fp", "role")
    large = all_rows.where("ib is not null").withColumn("at", F.xxhash64("fp"))
    own_i, own_j = F.pmod("at", "ib").cast("int"), F.pmod("at", "jb").cast("int")
    members = large.where(member).select(
        "bucket", own_i.alias("i"), F.explode(F.expr("sequence(0, cast(jb as int) - 1)")).alias("j"),
        "fp", F.lit(MEMBER).cast("byte").alias("role"))
    probes = large.where(probe).select(
        "bucket", F.explode(F.expr("sequence(0, cast(ib as int) - 1)")).alias("i"), own_j.alias("j"),
        "fp", F.lit(PROBE).cast("byte").alias("role"))
    dealt = some.unionByName(members).unionByName(probes).repartition("bucket", "i", "j")
    return dealt.sortWithinPartitions("bucket", "i", "j").mapInArrow(
        _verified(distance), "u long, v long").distinct()


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 5, distance: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Words are runs without ASCII white space, A-Z as a-z; shingles of `shingle` words count as
    often as they occur. The component is named by the least id reachable over links.
    """
    small_batches(docs)
    source = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(source.mapInArrow(_signer(shingle, seed), "id long, fp long"), "fingerprints")
    known = signed.where("id is not null")
    classes = written(known.groupBy("fp").agg(F.min("id").alias("node")), "classes")

    several = known.groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("w")).where(
        "u < w").select("id", "u")
    same_id = known.join(several, "id").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    labels = roots(hamming_links(classes, distance).unionByName(same_id))

    placed = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = written(placed.groupBy("root").agg(F.min("node").alias("component_id")), "least")
    named = written(placed.join(least, "root").select("fp", "component_id"), "components")
    component = F.expr("if(id is null, null, component_id)")
    return signed.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"))

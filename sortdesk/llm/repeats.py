"""Exact repeated passages by seed and extend.

Seeds: of every window of 20 words, the 6-word run of least hash is its anchor (winnowing), so
equal windows have equal anchors at equal places, and about every eighth word starts one. An
anchor carries the windows it stands for, [lo, hi], and a hash of their whole extent: the seed
extended to both sides as far as its windows reach.

Join: anchors that occur once are gone after one aggregation. If all occurrences of an anchor
agree in their whole extent, every occurrence but the first repeats it. Where extents differ,
the first of each extent stands for the others, and only these few are extended word by word:
their windows are hashed from the text and compared one by one. Neighbouring repeated windows
are joined to maximal spans.

Per anchor there is one row, never a pair: a passage shared by a third of all documents is
aggregated before the shuffle, and its rows meet one row per anchor in a join that adaptive
execution can split. Window and anchor hashes together make 128 bits.

Defined results. Order is by id, then start. Null or word-less text: no words, nothing removed.
Null ids come after all others. Rows that share an id are the same document: each is judged
against smaller ids and against itself, not against the others; repeated rows get equal
results. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import as_long, small_batches, written
from .words import Spans, Words, cut, mix, signed, slices

ANCHOR_WORDS = 6
_LAST = (1 << 63) - 1
#: place = lo * 2048 + (hi - lo) * 2 + (1 if the same document holds it before)
_ANCHORS = "id long, sub long, h long, u long, place long"
_WINDOWS = "id long, sub long, h long, w long, place long"


def _anchors(words: Words, window: int):
    """(row, anchor hash, extent hash, lo, hi) of the anchors; lo and hi are window starts."""
    n, reach = len(words.hash), window - ANCHOR_WORDS + 1
    row = words.row
    start = np.flatnonzero(words.first[1:][row] - np.arange(n) >= window)
    empty = np.zeros(0, np.int64)
    if not len(start):
        return empty, empty, empty, empty, empty
    spans = Spans(words.hash)
    grams = spans.hash(np.arange(n - ANCHOR_WORDS + 1), ANCHOR_WORDS)
    views = np.lib.stride_tricks.sliding_window_view(grams, reach)
    place = np.empty(len(start), np.int64)
    for a in range(0, len(start), 1 << 15):
        part = start[a:a + (1 << 15)]
        place[a:a + len(part)] = part + views[part].argmin(axis=1)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    place = place[new]
    extent = spans.hash(lo, hi - lo + window)
    extent = mix(extent ^ mix(((place - lo) * 4096 + hi - lo).astype(np.uint64)))
    return row[lo], signed(grams[place]), signed(extent), lo, hi


def _again(*keys: np.ndarray) -> np.ndarray:
    """Whether equal keys stand at an earlier position."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(order), np.int64)
    out[order[1:][same]] = 1
    return out


def _find_anchors(window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"))
            row, h, u, lo, hi = _anchors(words, window)
            taken = pa.array(row)
            place = (lo - words.first[row]) * 2048 + (hi - lo) * 2 + _again(u, h, row)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(taken), batch.column("sub").take(taken),
                pa.array(h, pa.int64()), pa.array(u, pa.int64()), pa.array(place, pa.int64())],
                ["id", "sub", "h", "u", "place"])
    return find


def _extend(window: int):
    """Windows (id, sub, h, w, place) of the requested anchors of each text."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"))
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            asked = asked.flatten()
            h, place = (asked.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            lo, many = place >> 11, (place >> 1 & 1023) + 1
            each = np.repeat(np.arange(len(lo)), many)
            start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            inside = start + window <= words.counts[row[each]]
            each, start = each[inside], start[inside]
            w = signed(Spans(words.hash).hash(start + words.first[row[each]], window))
            order = np.argsort(start, kind="stable")   # so that _again means an earlier start
            each, start, w = each[order], start[order], w[order]
            taken = pa.array(row[each])
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(taken), batch.column("sub").take(taken),
                pa.array(h[each]), pa.array(w),
                pa.array(start * 2048 + _again(w, h[each], row[each]))],
                ["id", "sub", "h", "w", "place"])
    return extend


def _is_again():
    return F.col("place") % 2 == 1


def _span(window: int) -> list:
    lo = F.shiftright("place", 11)
    more = F.shiftright("place", 1) % 1024
    return [lo.cast("int").alias("start"), (lo + more + window).cast("int").alias("end")]


def repeated_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, sub, text, spans) for every row: spans are the [start, end) word ranges covered by
    windows whose words also start earlier in the corpus; sub tells texts of one id apart."""
    if not ANCHOR_WORDS < window < 1000:
        raise ValueError(f"the window must lie between {ANCHOR_WORDS} and 1000 words")
    small_batches(docs)
    source = docs.select(F.coalesce(as_long(id_col), F.lit(_LAST)).alias("id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         as_long(id_col).isNull().alias("no_id"))
    # texts without id are told apart by this mark alone: 64 bits; others share few ids
    mark = F.when(F.col("no_id"), F.xxhash64("text")).otherwise(F.hash("text").cast("long"))
    source = source.select("id", mark.alias("sub"), "text", "no_id")
    anchors = source.select("id", "sub", "text").mapInArrow(_find_anchors(window), _ANCHORS)

    shared = written(
        anchors.groupBy("h").agg(
            F.count("*").alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"),
            F.min("id").alias("first")).where("n > 1").select(
            "h", "first", (F.col("u0") == F.col("u1")).alias("alike")), "shared-anchors")
    seeds = written(anchors.join(shared, "h").where(
        ~F.col("alike") | (F.col("id") > F.col("first")) | _is_again()), "seeds")
    mixed = seeds.where("not alike").drop("first")
    firsts = written(mixed.groupBy("h", "u").agg(F.min("id").alias("first")), "extents")
    placed = mixed.join(firsts, ["h", "u"])
    later = (F.col("id") > F.col("first")) | _is_again()
    sure = seeds.where("alike").select("id", "sub", *_span(window)).unionByName(
        placed.where(later).select("id", "sub", *_span(window)))
    sure = written(sure.distinct(), "repeats")
    asked = written(
        placed.where(~later).select("id", "sub", "h", "place").distinct()
        .groupBy("id", "sub").agg(F.collect_list(F.struct("h", "place")).alias("asked")), "asked")

    texts = source.select("id", "sub", "text")
    windows = texts.join(asked, ["id", "sub"]).mapInArrow(_extend(window), _WINDOWS)
    earliest = windows.groupBy("h", "w").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("place") % 2).alias("twice"))
    repeated = windows.join(earliest.where("first < last or twice = 1").select("h", "w", "first"),
                            ["h", "w"]).where(later)
    found = sure.unionByName(repeated.select("id", "sub", *_span(window)))
    spans = found.groupBy("id", "sub").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    return source.join(spans, ["id", "sub"], "left")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.string()).to_pylist()
        spans = batch.column("spans")
        offsets = spans.offsets.to_numpy()
        flat = spans.flatten()
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        offsets = offsets - offsets[0]
        n_words, n_removed, kept = [], [], []
        for r, text in enumerate(texts):
            words = text.encode().split()   # bytes: splits at \x20 and \x09-\x0D only
            total, (a, b) = len(words), offsets[r:r + 2]
            if b > a:
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, np.minimum(begin[a:b], total), 1)
                np.add.at(edge, np.minimum(end[a:b], total), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            n_words.append(total)
            n_removed.append(total - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("no_id"), pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["id", "no_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: the text without repeated words, the
    words left joined by one space."""
    spans = repeated_spans(docs, window, id_col, text_col).withColumn(
        "spans", F.expr("coalesce(spans, array())"))
    out = spans.select("id", "no_id", "text", "spans").mapInArrow(
        _strip, "id long, no_id boolean, n_words long, n_removed long, kept string")
    return out.select(F.expr("if(no_id, null, id)").alias("doc_id"), "n_words", "n_removed", "kept")

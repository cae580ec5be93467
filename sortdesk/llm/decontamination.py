"""Remove benchmark passages from training text with a generalised suffix automaton.

The automaton holds all normalised test items, as sequences of words. A document's words are
streamed through it; after each word it knows the longest ending that occurs in some item. Where
that length reaches the window (or a whole shorter item), the state of the window names the
items, and the window's words are hit. Hit spans are removed, and documents of which too large
a share is hit are dropped.

Only runs of words that occur in items, in pairs that occur in items, can match; the rest is
passed over in numpy before the automaton sees it. Items are counted and measured first. They are
cut into pieces that overlap by a window less one word, and pieces are dealt into waves of
bounded size; each wave is one pass over the documents, so neither driver nor worker ever
holds more than a wave, however large the benchmark is. Documents are not shuffled.

Defined results. Null or word-less texts: no hits; such items: no windows. Items that share an
id count once; a null id counts as the empty text. Repeated documents: equal results. Empty
tables: no hits, or no rows. All columns of the documents are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, small_batches, written
from .words import LETTERS_DIGITS, cut, mix, slices

#: Words are runs of 0-9, a-z and characters from U+0080 on, A-Z as a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of item text in one wave, and words in one piece of a long item.
WAVE_BYTES = 4 << 20
PIECE_WORDS = 20_000


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                sequences.append((name, ids))
                self._add(ids)
        self.names: dict[int, set[str]] = {}   # state of a window: items that hold it
        self.sizes: dict[int, set[int]] = {}   # state: lengths of the windows it stands for
        for name, ids in sequences:
            size = min(window, len(ids))
            state = matched = 0
            for w in ids:
                state, matched = self._step(state, matched, w)
                if matched >= size:
                    at = self._suffix(state, size)
                    self.names.setdefault((at, size), set()).add(name)
                    self.sizes.setdefault(at, set()).add(size)
        self.shortest = min((s for v in self.sizes.values() for s in v), default=0)
        self.marked = self._marked()

    def _add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            to = self.next[last].get(w)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, to, w)
                continue
            new = self._state(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
            last = new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the endings that come by p."""
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last `size` words of a match at `state`."""
        while self.length[self.link[state]] >= size and state:
            state = self.link[state]
        return state

    def _marked(self) -> list[int]:
        """By state: the nearest state on its chain of suffixes that stands for a window."""
        out = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            out[state] = state if state in self.sizes else out[self.link[state]]
        return out

    def windows(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, size, items) of each window occurrence in a run of words."""
        state = matched = 0
        for i, w in enumerate(ids):
            state, matched = self._step(state, matched, w)
            at = self.marked[state]
            while at > 0:
                for size in self.sizes[at]:
                    if size <= matched:
                        yield i + 1, size, self.names[at, size]
                at = self.marked[self.link[at]]


class Finder:
    """Hits of one wave of items in texts."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.automaton = Automaton(items, window)
        self.ready = False

    def _prepare(self) -> None:
        words = list(self.automaton.vocabulary)
        joined = cut(pa.array([w.decode() for w in words]), LETTERS_DIGITS)
        self.known = np.sort(joined.hash)
        code = dict(zip(self.automaton.vocabulary.values(), joined.hash.tolist()))
        pairs = {(code[a], code[b]) for a, b in self._pairs()}
        self.pairs = np.sort(_pair(*(np.array(x, np.uint64) for x in zip(*pairs)))) if pairs \
            else np.zeros(0, np.uint64)
        self.ready = True

    def _pairs(self) -> Iterator[tuple[int, int]]:
        a = self.automaton
        for first, state in a.next[0].items():
            for second in a.next[state]:
                yield first, second

    def runs(self, words) -> np.ndarray:
        """(start, end) of the word runs that may hold a window."""
        if not self.ready:
            self._prepare()
        if not len(self.known) or not len(words.hash):
            return np.zeros((0, 2), np.int64)
        known = _within(words.hash, self.known)
        joined = np.zeros(len(known) + 1, bool)
        joined[1:-1] = known[1:] & known[:-1] & _within(
            _pair(words.hash[:-1], words.hash[1:]), self.pairs)
        joined[words.first] = False
        start = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - start >= self.automaton.shortest
        return np.stack([start[long], end[long]], axis=1)

    def hits(self, words, row_of: np.ndarray, spans: list[list], items: list[set]) -> None:
        """Add [start, end) word spans and item names of each row."""
        ids = self.automaton.vocabulary
        for a, b in self.runs(words).tolist():
            coded = [ids.get(words.word(i), -1) for i in range(a, b)]
            r = int(row_of[a])
            base = a - int(words.first[r])
            for end, size, names in self.automaton.windows(coded):
                spans[r].append((base + end - size, base + end))
                items[r] |= names


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    return ordered[np.minimum(at, len(ordered) - 1)] == x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_waves(items: DataFrame, id_col: str, text_col: str,
               window: int) -> Iterator[tuple[list, bool]]:
    """([(id, words)], whether more follow): pieces of the items, dealt by hash into waves of
    bounded size, one at a time."""
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                         F.col(text_col).cast("string").alias("text"))
    words = F.regexp_extract_all(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(f"({WORD})"), F.lit(1))
    step = PIECE_WORDS - window + 1
    pieces = texts.select("id", words.alias("words")).where("size(words) > 0").select(
        "id", "words", F.explode(F.expr(
            f"sequence(0, greatest(size(words) - {window}, 0), {step})")).alias("at")).select(
        "id", F.expr(f"slice(words, at + 1, {PIECE_WORDS})").alias("words"))
    size = pieces.agg(F.sum(F.length(F.array_join("words", " ")) * 2)).first()[0] or 0
    waves = 1 + size // WAVE_BYTES
    dealt = pieces.withColumn("wave", F.pmod(F.xxhash64("id", "words"), F.lit(waves)))
    for wave in range(waves):
        rows = dealt.where(F.col("wave") == wave).select("id", "words").collect()
        yield (sorted((r["id"], [w.encode() for w in r["words"]]) for r in rows),
               wave < waves - 1)


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_MARK = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def _up_to_last_wave(docs: DataFrame, items: DataFrame, window: int, text_col: str, item_id: str,
                     item_text: str, result: str) -> tuple[DataFrame, Finder, bool]:
    """(docs, marked by all waves but the last; the last wave's finder; whether it is the only
    one). Earlier waves are written, so that the driver, too, holds one wave at a time."""
    small_batches(docs)
    for i, (wave, more) in enumerate(item_waves(items, item_id, item_text, window)):
        finder = Finder(wave, window)
        if not more:
            break
        docs = written(_marked(docs, finder, text_col, result, i == 0), "wave")
    return docs, finder, i == 0


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  result: str = "contamination") -> DataFrame:
    """docs with a column <n_words, n_hit, spans, items> of the item windows in their texts.

    A window is `window` consecutive words of an item, or a whole shorter item. spans are
    [start, end) in words, joined where they meet; items are the ids, in order.
    """
    result = free_name(docs, result)
    marked, finder, only = _up_to_last_wave(docs, items, window, text_col, item_id, item_text, result)
    return _marked(marked, finder, text_col, result, only)


def _found(finder: Finder, batch: pa.RecordBatch, text_col: str, old: pa.Array | None):
    """(word counts, joined spans, item names) of each row, with those of earlier waves."""
    words = cut(batch.column(text_col), LETTERS_DIGITS, lower=True)
    spans: list[list] = [[] for _ in range(batch.num_rows)]
    items: list[set] = [set() for _ in range(batch.num_rows)]
    finder.hits(words, words.row, spans, items)
    if old is not None:
        for r, mark in enumerate(old.to_pylist()):
            spans[r] += [(s["start"], s["end"]) for s in mark["spans"]]
            items[r] |= set(mark["items"])
    return words.counts, [merged(s) for s in spans], items


def _marked(docs: DataFrame, finder: Finder, text_col: str, result: str, first: bool) -> DataFrame:
    names = [c for c in docs.columns if first or c != result]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            old = None if first else batch.column(result)
            counts, spans, items = _found(finder, batch, text_col, old)
            column = pa.array([{
                "n_words": int(c), "n_hit": sum(b - a for a, b in s),
                "spans": [{"start": a, "end": b} for a, b in s], "items": sorted(found)}
                for c, s, found in zip(counts, spans, items)],
                pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                           ("spans", pa.list_(pa.struct([("start", pa.int64()),
                                                         ("end", pa.int64())]))),
                           ("items", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], column], [*names, result])

    fields = [docs.schema[c] for c in names]
    return docs.mapInArrow(mark, T.StructType([*fields, T.StructField(result, _MARK)]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.8,
                  text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """docs without item passages: hit spans leave the text, and documents of which more than
    max_share of the words is hit are dropped. Untouched texts stay as they are, byte by byte.

    A removed span runs from its first word's first to its last word's last byte. Windows are
    judged on the text as it came in, not on words that meet where a span was cut out.
    """
    names, schema = docs.columns, docs.schema
    at, result = names.index(text_col), free_name(docs, "contamination")
    marked, finder, only = _up_to_last_wave(docs, items, window, text_col, item_id, item_text, result)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            old = None if only else batch.column(result)
            counts, spans, _ = _found(finder, batch, text_col, old)
            hit = np.array([sum(b - a for a, b in s) for s in spans])
            texts = [without(t, s) if s else t
                     for t, s in zip(batch.column(at).to_pylist(), spans)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(
                pa.array(hit <= max_share * counts))

    return marked.mapInArrow(strip, schema)


_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    words = [m.span() for m in re.finditer(WORD, text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The fixed result of the registered query, from the operator's own columns."""
    found = contamination(docs.select("doc_id", "text"), items)
    mark = F.col(found.columns[-1])
    return found.select(
        "doc_id", mark["n_words"].alias("n_words"), mark["n_hit"].alias("n_hit"),
        F.size(mark["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(mark["items"], ","), 256).alias("items_sha256"),
        (mark["n_hit"] > 0).alias("contaminated"))

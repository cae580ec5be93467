"""Exact BPE piece encoding by backtracking, and decoding.

The encoder walks a word from the left. It takes the longest piece that starts at the current
byte (an Aho-Corasick automaton gives all pieces that occur in the word, with their ends),
accepts it if it is compatible with the piece before, and goes on. Two neighbouring pieces are
compatible if merging their joined text anew gives exactly these two; by the locality of
score-ordered merging, a sequence whose neighbours are all compatible is the merge result, and
there is only one. If no piece fits, the walk steps back to a shorter piece; a bit field marks
positions from which no continuation exists, so none is tried twice.

Merges never cross between two characters that no piece holds side by side. So a text is cut
before a run of space marks, around line breaks, and between a letter and such marks of
punctuation as no piece has after a letter; all this is read off the vocabulary. Parts are
encoded one by one, and each worker remembers the ids of those it has met, up to a fixed number.

Defined results. A null or empty text: only begin and end ids, empty decoded text. Repeated rows:
equal results. Texts are taken whole; one part is encoded at a time, so memory follows the
longest part. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import sys
from collections.abc import Iterator
from types import ModuleType

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import free_name, small_batches

SPACE = "▁"
LETTER = r"[^\W\d_]"
#: Parts remembered by one worker, about 45 MB. When they are too many, the first ones stay:
#: parts that are met early are the frequent ones.
REMEMBERED, FREQUENT = 200_000, 60_000
_PAIRS = 150_000


class Pieces:
    """The vocabulary of a piece model and the exact encoder over it."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i)
                   or model.is_byte(i) or model.is_unused(i)]
        texts = [model.id_to_piece(i) for i in range(n)]
        skip = set(special)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.ids = {t: i for i, t in enumerate(texts) if i not in skip}
        self.score = {t: model.get_score(i) for t, i in self.ids.items()}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(texts) if model.is_byte(i)}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            raise ValueError("a piece spans two words; words cannot be encoded one by one")
        if len(self.bytes) != 256 or any(c not in self.ids for t in self.ids for c in t):
            raise ValueError("every character of a piece must be a piece, every byte a byte piece")
        if model.normalize("  ﬁ x ") != f"{SPACE}{SPACE}{SPACE}ﬁ{SPACE}x{SPACE}":
            raise ValueError("only models without normalisation, with a leading space, are read")
        if any("\n" in t for t in self.ids) or n > 1 << 16:
            raise ValueError("line breaks must be byte pieces, ids must fit 16 bits")
        after = {m for t in self.ids for m in re.findall(f"{LETTER}([!-/:-@\\[-`{{-~])", t)}
        safe = "".join(re.escape(c) for c in string.punctuation if c not in after)
        self.parts = re.compile(f" *{LETTER}+(?=[ \n{safe}]|$)| +[^ \n]*|[^ \n]+|\n+")
        raw = {i: t.replace(SPACE, " ").encode() for t, i in self.ids.items()}
        raw.update({i: bytes([b]) for b, i in self.bytes.items()})
        raw = [raw.get(i, b"") for i in range(n)]
        self._size = np.array([len(r) for r in raw], np.int64)
        self._from = np.cumsum(self._size) - self._size
        self._raw = np.frombuffer(b"".join(raw), np.uint8)
        self.texts = texts
        self.found, self.longest = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or self.merge(t) == [t]:   # else the piece is never a merge result
                self.found.add_word(t, (len(t), i))
                self.longest.add_word(t, i)
        self.found.make_automaton()
        self.longest.make_automaton()
        known = "".join(re.escape(t) for t in self.ids if len(t) == 1)
        self.unknown = re.compile(f"[^{known}]")
        self._pairs: dict[int, bool] = {}   # left << 16 | right
        self._memory = _Memory(self)

    def merge(self, text: str) -> list[str]:
        """Merge from single characters, best score first, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text anew gives these two pieces."""
        ok = self._pairs.get(left << 16 | right)
        if ok is None:
            if len(self._pairs) >= _PAIRS:
                self._pairs.clear()
            pair = [self.texts[left], self.texts[right]]
            ok = self._pairs[left << 16 | right] = self.merge("".join(pair)) == pair
        return ok

    def split(self, run: str) -> list[int]:
        """Ids of the pieces of a run of known characters."""
        out = [piece for _, piece in self.longest.iter_long(run)]
        known = self._pairs
        for i in range(1, len(out)):
            ok = known.get(out[i - 1] << 16 | out[i])
            if not (self.compatible(out[i - 1], out[i]) if ok is None else ok):
                return self._walk(run, out[:i])
        return out

    def _walk(self, run: str, out: list[int]) -> list[int]:
        """Go on after the longest pieces `out`, whose next longest piece does not fit."""
        fits: list[list[tuple[int, int]]] = [[] for _ in run]   # (size, piece) from each place, rising
        for last, piece in self.found.iter(run):
            fits[last + 1 - piece[0]].append(piece)
        left, at = [], 0    # left: how many pieces of each place are untried
        for piece in out:
            left.append(len(fits[at]) - 1)
            at += len(self.texts[piece])
        left.append(len(fits[at]) - 1)
        failed, known = 0, self._pairs
        while at < len(run):
            i, here = left[-1], fits[at]
            while i:
                i -= 1
                size, piece = here[i]
                if failed >> (at + size) & 1:
                    continue
                if out:
                    ok = known.get(out[-1] << 16 | piece)
                    if not (self.compatible(out[-1], piece) if ok is None else ok):
                        continue
                left[-1] = i
                out.append(piece)
                at += size
                left.append(len(fits[at]) if at < len(run) else 0)
                break
            else:
                if not out:
                    raise ValueError("no sequence of pieces fits")
                failed |= 1 << at
                left.pop()
                at -= len(self.texts[out.pop()])
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one part; characters outside the vocabulary become their bytes."""
        word = word.replace(" ", SPACE)
        ids, at = [], 0
        for other in [*self.unknown.finditer(word), None]:
            end = other.start() if other else len(word)
            if end > at:
                ids += self.split(word[at:end])
            if other:
                ids += [self.bytes[b] for b in other[0].encode()]
                at = other.end()
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end
        parts = self.parts.findall(" " + text.replace(SPACE, " "))
        return b"".join([begin, *map(self._memory.__getitem__, parts), end])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the leading space that encoding adds goes."""
        at = np.frombuffer(ids, "<u4")
        size = self._size[at]
        total = np.cumsum(size)
        index = np.arange(total[-1] if len(total) else 0) + np.repeat(
            self._from[at] - total + size, size)
        text = self._raw[index].tobytes()
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        return text[1:] if text[:1] == b" " else text


class _Memory(dict):
    """Ids of the parts met so far; keeps the first ones when it is full."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self._pieces = pieces

    def __missing__(self, part: str) -> bytes:
        ids = self._pieces.encode_word(part)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            if len(self) >= REMEMBERED:
                for old in list(self)[FREQUENT:]:
                    del self[old]
            self[part] = packed
        return packed


def loaded(model_file: str) -> Pieces:
    """One vocabulary, with its memory, for the lifetime of a worker process.

    Code travels with each task, so what outlives a task is kept in a module of the process.
    """
    home = sys.modules.setdefault("sortdesk_piece_models", ModuleType("sortdesk_piece_models"))
    if model_file not in vars(home):
        vars(home)[model_file] = Pieces(model_file)
    return vars(home)[model_file]


def _id_lists(ids: list[bytes]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(edges, pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text",
                  result: str = "pieces") -> DataFrame:
    """docs with a column <n_tokens, ids, ids_sha256, decoded, decoded_sha256> of whole texts.

    model_file is read by each worker; it must be present on every executor. The result column
    is called `result`, with underscores added while docs has a column of that name.
    """
    small_batches(docs)
    result = free_name(docs, result)
    kind = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = [pieces.encode(t) for t in batch.column(at).cast(pa.string()).to_pylist()]
                plain = [pieces.decode(i) for i in ids]
                sha = [[hashlib.sha256(b).hexdigest() for b in part] for part in (ids, plain)]
                column = pa.StructArray.from_arrays([
                    pa.array(np.array([len(i) // 4 for i in ids], np.int64)),
                    _id_lists(ids), pa.array(sha[0], pa.string()),
                    pa.array(plain, pa.binary()).cast(pa.string()), pa.array(sha[1], pa.string())],
                    ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])
                yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                                 [*batch.schema.names, result])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(result, kind)]))

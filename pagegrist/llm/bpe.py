"""Byte-level BPE encoding and decoding by a pair occurrence index.

A task reads its texts in slices. The words of a slice that the task hasn't met yet lie end to end in one array of symbols,
and an index maps each pair of neighbours that the vocabulary can merge to all its positions. Active ranks are applied in
ascending order: all positions of a pair are merged at once, and the pairs that arise beside them join the lists of their
own ranks, which are always higher (checked of the vocabulary). A word's ids are kept for the rest of the task, in bounded number.
No row leaves its partition: no shuffle, no state outside of a task.

Defined results: a null text is an empty one and has no ids; equal rows are encoded alike, each for itself; a null doc_id and all other
columns pass through; an empty table gives no row. Ids outside of the vocabulary decode to nothing, a null list to the empty text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import fresh, release, texts

#: Rows and bytes of text of a slice; words with their ids that a task keeps at most before it begins anew.
ROWS, BYTES, KEPT = 2048, 4 << 20, 250_000
#: Characters below it are of the same class in all versions of Unicode; texts with others are split by the tokenizer's own splitter.
SETTLED = 0x250
_UNSETTLED = re.compile(f"[^\x00-{chr(SETTLED - 1)}]")
_LOADED: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


class Memo(dict):
    """Numbers the units of text that a task meets, and keeps their ids end to end."""

    def __init__(self):
        super().__init__()
        self.new: list = []  # numbered, their ids not yet known
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, unit):
        self[unit] = n = len(self)
        self.new.append(unit)
        return n

    def numbers(self, units: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, units), np.int64, len(units))

    def enter(self, ids: np.ndarray, at: np.ndarray) -> None:
        """The ids of the new units end to end, and where each begins (one more than units)."""
        self.ids, self.at, self.new = np.concatenate((self.ids, ids)), np.concatenate((self.at, self.at[-1] + at[1:])), []

    def gathered(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of unit numbers end to end, and how many each row has."""
        units = np.concatenate([np.zeros(0, np.int64), *rows])
        first, n = self.at[units], self.at[units + 1] - self.at[units]
        place = np.append(0, np.cumsum(n))
        bounds = place[np.cumsum([0, *map(len, rows)])]
        return self.ids[np.repeat(first - place[:-1], n) + np.arange(place[-1])], np.diff(bounds)


def splitter() -> re.Pattern:
    """The published pattern of such vocabularies (packing.PATTERN) for settled characters, its classes spelt out, its likeliest branch first."""
    import regex

    def named(cls: str) -> str:
        found = [c for c in map(chr, range(SETTLED)) if regex.match(cls, c)]
        return "".join(map(re.escape, found))

    letter, number, space = map(named, (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Bpe:
    """A byte-level BPE vocabulary; special: strings of its added tokens are tokens of their own."""

    def __init__(self, path: str, special: bool = True):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        added = [x for x in spec.get("added_tokens", ()) if special]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        vocab, stand_in = model["vocab"], byte_alphabet()
        self.added = {x["content"]: x["id"] for x in added}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.base = np.array([vocab[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right, self.made = (np.array([vocab[f(m)] for m in merges], np.int32) for f in (lambda m: m[0], lambda m: m[1], "".join))
        born = {int(i): -1 for i in self.base} | {int(c): r for r, c in reversed([*enumerate(self.made)])}
        if any(max(born[int(a)], born[int(b)]) >= r for r, (a, b) in enumerate(zip(self.left, self.right))):
            raise ValueError(f"{path}: merges that come before their parts")
        keys = self._key(self.left, self.right)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.size = 1 + max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens", ()))])
        self.token_bytes = [b""] * (self.size + 1)  # the last is of ids that there aren't
        for token, i in chain(vocab.items(), ((x["content"], x["id"]) for x in spec.get("added_tokens", ()))):
            self.token_bytes[i] = bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()
        self.pattern, self.path, self.memo, self._own = splitter(), path, Memo(), None

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not _UNSETTLED.search(text):
            return self.pattern.findall(text)
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._own.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str | int]:
        """The words of a text; the id of an added token where its string stands."""
        if not self.marks or not self.marks.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._words(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return out + self._words(text[at:])

    def _active(self, starts: np.ndarray, sym: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at these positions those that can be merged: their ranks in ascending order, and positions."""
        key = self._key(sym[starts], sym[nxt[starts]])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        rank = self.ranks[at[hit]]
        order = np.argsort(rank, kind="stable")
        return rank[order], starts[hit[order]]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's begin (one more than words)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        bounds = np.cumsum([0, *map(len, words)])
        sym = np.append(self.base[data], np.int32(-1))  # at n stands what neighbours nothing
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        full = bounds[:-1] < bounds[1:]
        nxt[bounds[1:][full] - 1] = n
        prv[bounds[:-1][full]] = n
        nxt[n] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(rank: np.ndarray, starts: np.ndarray) -> None:
            if not len(rank):
                return
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(rank)]):
                r = int(rank[a])
                if r in index:
                    index[r].append(starts[a:b])
                else:
                    index[r] = [starts[a:b]]
                    heapq.heappush(heap, r)

        enter(*self._active(np.arange(n, dtype=np.int32), sym, nxt))
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            a, b, c = self.left[r], self.right[r], self.made[r]
            if a == b:
                at = np.sort(at)
            second = nxt[at]
            still = (sym[at] == a) & (sym[second] == b)  # a neighbour may have been merged away
            at, second = at[still], second[still]
            if a == b and len(at) > 1:
                keep = _alternate(second[:-1] == at[1:])
                at, second = at[keep], second[keep]
            if not len(at):
                continue
            after = nxt[second]
            sym[at], sym[second] = c, -2
            nxt[at], prv[after] = after, at
            before = prv[at]
            enter(*self._active(np.concatenate((before[sym[before] != c], at)), sym, nxt))
        live = sym[:n] >= 0
        return sym[:n][live], np.append(0, np.cumsum(live))[bounds]

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if len(self.memo) > KEPT:
            self.memo = Memo()
        rows = [self.memo.numbers(self.words(x)) for x in found]
        ids, at = self.merged([b"" if isinstance(w, int) else w.encode() for w in self.memo.new])
        if any(isinstance(w, int) for w in self.memo.new):  # an added token is its own id
            own = np.array([isinstance(w, int) for w in self.memo.new])
            ids = np.insert(ids, at[:-1][own], [w for w in self.memo.new if isinstance(w, int)])
            at = at + np.append(0, np.cumsum(own))
        self.memo.enter(ids, at)
        return self.memo.gathered(rows)

    def decode(self, ids: np.ndarray) -> str:
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size).tolist()
        return b"".join(map(self.token_bytes.__getitem__, known)).decode("utf-8", "replace")


def _alternate(chained: np.ndarray) -> np.ndarray:
    """Of positions of which each next one may overlap the one before, the first, third, ... of each run."""
    i = np.arange(len(chained) + 1)
    first = np.maximum.accumulate(np.where(np.append(True, ~chained), i, 0))
    return (i - first) % 2 == 0


def loaded(path: str, special: bool = True) -> Bpe:
    """The vocabulary of a file; read once per worker."""
    if (path, special) not in _LOADED:
        _LOADED[path, special] = Bpe(path, special)
    return _LOADED[path, special]


def slices(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of bounded rows and bytes of text (a longer text alone), each with its texts."""
    found = texts(batch.column(column))
    i = 0
    while i < len(found):
        j, size = i, 0
        while j < len(found) and j - i < ROWS and (j == i or size + len(found[j]) <= most):
            size += len(found[j])
            j += 1
        yield batch.slice(i, j - i), found[i:j]
        i = j


def lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Values end to end as an Arrow list column of rows of n values."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(values))


def _encoder(path: str, special: bool):
    def run(it: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        bpe = loaded(path, special)
        for batch in it:
            for part, found in slices(batch, at):
                yield part, lists(*bpe.encode(found))
        bpe.memo = Memo()  # an idle worker holds no words

    return run


def _decoder(path: str):
    def run(it: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        bpe = loaded(path)
        for batch in it:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = part.column(at)
                each, to = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
                yield part, pa.array([bpe.decode(each[a:b]) for a, b in pairwise(to)], pa.string())

    return run


def _with(df: DataFrame, column: str, run, name: str, kind: str) -> DataFrame:
    """The columns of df and one more, made in Arrow from a column; passed by position, whatever their names."""
    ship(df.sparkSession)
    at = df.columns.index(column)
    slim = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made in run(it, at):
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*(f"c{i}" for i in range(part.num_columns)), "made"])
        release()

    schema = T.StructType([*slim.schema.fields, T.StructField("made", T._parse_datatype_string(kind))])
    return slim.mapInArrow(each, schema).toDF(*df.columns, fresh(name, df.columns))


def encode(docs: DataFrame, path: str, column: str = "text", special: bool = True) -> DataFrame:
    """The columns of docs and ids, array<int>; special: added tokens' strings in a text are those tokens."""
    return _with(docs.withColumn(column, F.col(column).cast("string")), column, _encoder(path, special), "ids", "array<int>")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The columns of encoded and decoded, the text of the ids, added tokens included; bytes that aren't UTF-8 become U+FFFD."""
    return _with(encoded.withColumn(column, F.col(column).cast("array<int>")), column, _decoder(path), "decoded", "string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's text, encoded and decoded again."""
    out = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).select("doc_id", "ids"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

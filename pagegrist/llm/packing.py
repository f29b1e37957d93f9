"""Best-fit packing of token pieces into sequences by minimum bin slack.

Documents are tokenised once into a slim table of pieces (ids of the text, then an end id; a longer document
is cut into pieces of the sequence length, the first taking the remainder). How well pieces pack depends on
their lengths alone, and those are at most as many as the sequence length: one grouped count per length goes to
the driver, where each bin is the fullest subset of the remaining lengths that holds the longest of them, found by
a bitset subset sum. A bin's pattern is repeated while the counts allow it. Pieces are then numbered within
their length and looked up in the patterns.

Defined results: a null text is an empty one, one end id long; equal rows are packed as often as given; a null
doc_id is kept; an empty table gives no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, texts

#: Words that a task keeps with their ids, in each of two generations; bounds its memory.
CACHED_WORDS = 100_000
_TOKENIZERS: dict[str, tuple] = {}
#: A word with the space before it: printable characters of Latin scripts, single line ends between them.
_PLAIN = re.compile(r" ?[\x21-\x7E\xA1-\xAC\xAE-\u024F]+(?:\n[\x21-\x7E\xA1-\xAC\xAE-\u024F]+)*\Z")
#: A word without marks, with the white space before it, or one mark; and what must not meet for it to stand alone.
_STEM = re.compile(r"[ \n]?[0-9A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+\Z|[.,]\Z")
_MEETING = [a + b for a in " \n.," for b in ".,"]
#: Fixed value: the published pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _word_encoder(path: str):
    """A faster encoder of the same vocabulary for plain words; None where its ids don't follow its merges."""
    import tiktoken

    model = json.loads(open(path, encoding="utf-8").read())["model"]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand_in = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    ranks = {bytes(stand_in[c] for c in token): i for token, i in vocab.items() if all(c in stand_in for c in token)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str) -> tuple:
    """The tokenizer of a file, its word encoder's cached words, and the strings that it takes for tokens of their own; one per worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        words = _word_encoder(path)
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        _TOKENIZERS[path] = (t, [_Words(words, {}, _STEM), _Words(words, {}, _PLAIN)] if words else [], re.compile("|".join(map(re.escape, added))) if added else None)
    return _TOKENIZERS[path]


class _Odd(Exception):
    """A word that isn't plain: its text is tokenised as a whole."""


class _Words(dict):
    """Ids of words, each with the white space before it; a word that is missing is tokenised and kept."""

    def __init__(self, encoding, old: dict, plain: re.Pattern):
        super().__init__()
        self.encoding, self.old, self.plain = encoding, old, plain
        self.piece = encoding._core_bpe.encode_single_piece  # of a single pre-token

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            letters = word[:1] == " " and word[1:].isalpha()
            if not (letters and word.isascii()) and not self.plain.match(word):
                raise _Odd
            found = array("I", self.piece(word.encode()) if letters else self.encoding.encode_ordinary(word)).tobytes()
        self[word] = found
        return found

    def emptied(self) -> _Words:
        return _Words(self.encoding, {}, self.plain)

    def aged(self) -> _Words:
        return self if len(self) < CACHED_WORDS else _Words(self.encoding, dict(self), self.plain)


def encode(found: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    A byte-level BPE never joins across the gap before a space that a non-space follows, nor between a letter and
    a punctuation mark, so a plain text is the sequence of its words, each with the space before it, and words
    repeat: a worker tokenises each once. Texts of other characters or spacing, or with a string that the vocabulary
    has as a special token, are tokenised whole.
    """
    t, kept, special = tokenizer(path)
    out = []
    for text in found:
        kept[:] = [x.aged() for x in kept]
        ids = None
        if kept and text and not (special and special.search(text)):
            try:
                if not any(x in text for x in _MEETING):
                    marked = text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n")
                    ids = b"".join(map(kept[0].__getitem__, marked.split("\0")))
            except _Odd:
                pass
            try:
                if ids is None:
                    ids = b"".join(map(kept[1].__getitem__, text.replace(" ", "\0 ").split("\0")))
            except _Odd:
                pass
        if ids is None:
            ids = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out.append(ids)
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("serial", pa.int64())])


def pieces(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids; the remainder comes first."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    cuts = [0, *range(first, n + 1, size)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def _cut(path: str, end_id: int, size: int):
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        serial = 0
        for batch in it:
            rows = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts(part.column("text")), path)):
                    rows += [(doc, k, *p) for k, p in enumerate(pieces(ids + end, size))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, PIECES)), pa.array(np.arange(serial, serial + len(rows)))], schema=PIECES)
            serial += len(rows)
        kept = tokenizer(path)[1]
        kept[:] = [x.emptied() for x in kept]  # an idle worker holds no words
        release()

    return cut


def fullest(counts: dict[int, int], longest: int, size: int) -> dict[int, int]:
    """The subset of the counted lengths with this longest one that fills a bin of this size best: {length: times}."""
    room = size - longest
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        n = min(counts[length] - (length == longest), room // length)
        k = 1
        while n > 0:  # times 1, 2, 4, ... of a length reach every number of times
            take = min(k, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n -= take
            k *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    out = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + take
            left -= length * take
    return out


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, pattern) in order; all pieces of the counted lengths are placed.

    Every pattern uses up what some length can give to it, so their number is bounded by the sequence length,
    whatever the counts.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        pattern = fullest(left, max(left), size)
        bins = min(left[k] // n for k, n in pattern.items())
        out.append((bins, pattern))
        for k, n in pattern.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


PLACED = pa.schema([(n, pa.int64()) if n != "piece" else (n, pa.int32()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])


def lookup(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length its runs in rank order: first rank, first bin, times in a bin, offset there."""
    runs: dict[int, list] = {}
    rank: dict[int, int] = {}
    first = 0
    for bins, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            runs.setdefault(length, []).append((rank.get(length, 0), first, n, offset))
            rank[length] = rank.get(length, 0) + n * bins
            offset += n * length
        first += bins
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def _place(runs: dict[int, np.ndarray]):
    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                r = runs[int(k)]
                x = r[np.searchsorted(r[:, 0], rank[own], side="right") - 1]
                within = rank[own] - x[:, 0]
                seq[own] = x[:, 1] + within // x[:, 2]
                off[own] = x[:, 3] + within % x[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACED.names[:5]), pa.array(seq), pa.array(off)], schema=PLACED)

    return place


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    scratch = Scratch(spark, "packing")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = slim.mapInArrow(_cut(path, end_id, size), "doc_id long, piece int, start long, length long, ids_crc32 long, serial long")
    every = scratch.save(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", "serial"), F.lit(1 << 20)).cast("int")))
    total = every.count()
    salts = max(16, total // 200_000)
    dealt = every.withColumn("salt", F.pmod("salt", F.lit(salts)))
    counts = scratch.save(dealt.groupBy("length", "salt").agg(F.count("*").alias("m")))
    by_length = {r["length"]: r["m"] for r in counts.groupBy("length").agg(F.sum("m").alias("m")).collect()}  # at most `size` rows
    runs = lookup(patterns(by_length, size))
    before = counts.selectExpr("length", "salt", "sum(m) over (partition by length order by salt rows unbounded preceding) - m as before")
    ranked = dealt.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, ids_crc32, serial) - 1 as within")
    ranked = ranked.join(before, ["length", "salt"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + within as rank")
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

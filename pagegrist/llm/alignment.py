"""Alignment of two tokenizers' tokens over the same bytes, and a corpus-wide table of which ids stand for each other.

Texts are parted into chunks, words with the white space before them, which no token of either tokenizer reaches across. A task tokenises
each chunk once; the new chunks of a slice of texts lie end to end in rows: the ids of both tokenizers and the byte offsets where their
tokens end. Spark's array functions align them. The offsets that both have (array_intersect) cut a row into groups: sorted among a
tokenizer's tokens, the cuts part its ids into groups. Tokens that end at one cut are linked: the last ones of its two groups. A document
is a row of chunk numbers that follows its chunks' rows within the partition, and takes groups and links from them: a chunk's end
is a cut, so a document's groups are those of its chunks in order. Links are counted by pair of ids, and each document's links look
their counts up.

The table of counts is broadcast. Its size is bounded by the vocabularies, whatever the corpus: linked tokens end together, so the
shorter one's bytes are the end of the other's, and a vocabulary offers at most as many ends as it has bytes (both together
under 600,000 pairs for the vocabularies here).

Defined results: texts that are null, empty, or that a tokenizer doesn't give back byte by byte have no tokens, zeros and an empty digest; equal
rows are aligned each for itself and count each; a null doc_id is kept; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import bpe
from .common import Scratch, release

#: Chunks that a task keeps at most before it begins anew, and their bytes.
KEPT, KEPT_BYTES = 200_000, 32 << 20
#: New chunks of a row that is aligned.
TOGETHER = 4_096
#: Documents put together at a time; chunks encoded in one call.
ROWS, CALL = 512, 20_000
#: What no token reaches across. A chunk begins at a space or line end after a character that isn't white space: words of the byte-level
#: vocabulary's pattern don't go on there, and pieces of a vocabulary with word starts neither.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_LOADED: dict = {}


class Pieces:
    """A sentencepiece vocabulary with byte fallback, which sets a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.line = self.model.encode("\n")  # a space and the token of a line end
        self.apart = not any(re.search("[^▁]▁|\n", p) for p in pieces) and len(self.line) == 2 and self._joined(self.line) == b" \n"

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def _whole(self, text: str) -> np.ndarray:
        ids = self.model.encode(text) if text else []
        return np.array(ids if self._joined(ids) == b" " + text.encode() else [], np.int32)

    def chunks(self, text: str) -> list[str]:
        """A space and the text, in chunks; as one, where pieces may reach across."""
        return CHUNK.findall(" " + text) if self.apart else [" " + text]

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, how many each has, and whether they aren't its bytes. A chunk begins with a space or a line end.

        The space that is set before a text is the chunk's own, or a piece of its own before a line end.
        """
        out = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))]
        for at in range(0, len(chunks), CALL):
            part = chunks[at : at + CALL]
            found = self.model.encode([c[1:] if c[0] == " " else c for c in part], num_threads=1)
            for i, c in enumerate(part):
                if c[0] != " ":
                    del found[i][0]
                elif len(c) == 1:
                    found[i] = self.line[:1]
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
            odd = np.zeros(len(found), bool)
            if self._joined(ids.tolist()) != "".join(part).encode():
                odd[:] = [self._joined(x) != c.encode() for c, x in zip(part, found)]
            out.append((ids, n, odd))
        return tuple(map(np.concatenate, zip(*out)))

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; none where their bytes aren't a space and the text."""
        parts = []
        for x in found:
            ids, _, odd = self.of_chunks(self.chunks(x) if x else [])
            parts.append(self._whole(x) if odd.any() else ids)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)


def pieces(path: str) -> Pieces:
    """The vocabulary of a file; read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def ends(ids: np.ndarray, n: np.ndarray, token_bytes: list[bytes]) -> np.ndarray:
    """Where each token ends in its text's bytes; ids of all texts end to end, n of each."""
    each = np.array([len(x) for x in token_bytes], np.int64)[ids]
    if not (each > 0).all():
        raise ValueError("a token without bytes")
    total = np.append(0, np.cumsum(each))
    first = np.append(0, np.cumsum(n))[:-1]
    return total[1:] - np.repeat(total[first], n)


#: A token is one number: the byte offset where it ends, and its id in the last ID_BITS; an end has MARK there, which is no id.
ID_BITS = 20
MARK = (1 << ID_BITS) - 1
#: Without nulls, so that Spark sorts and intersects plain numbers.
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("a", "a_ends", "b", "b_ends"))])
#: Besides, of new chunks: the number of the first one (null: a document), and where each ends; of a document: how many tokens it has, its chunks' numbers.
CHUNKED = T.StructType([*TOKENS, T.StructField("first", T.IntegerType()), T.StructField("chunk_ends", T.ArrayType(T.LongType(), False)), T.StructField("of_a", T.LongType()), T.StructField("of_b", T.LongType()), T.StructField("chunks", T.ArrayType(T.IntegerType(), False))])
#: Bytes of text tokenised at a time.
BYTES = 2 << 20


class Chunks:
    """Numbers the chunks that a task meets; how many tokens of each vocabulary each has, and whether its pieces aren't its bytes."""

    def __init__(self):
        self.memo, self.size = bpe.Memo(), 0
        self.n_a, self.n_b, self.odd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, a: bpe.Bpe, b: Pieces) -> Iterator[pa.RecordBatch]:
        """Rows of the new chunks, each tokenised alone. Odd ones have no tokens."""
        new, first, self.memo.new = self.memo.new, len(self.n_a), []
        if not new:
            return
        ids_b, n_b, odd = b.of_chunks(new)
        ids_a, n_a = a.encode(new)
        size = np.array([len(c.encode()) for c in new], np.int64)
        self.size += int(size.sum())
        if odd.any():
            ids_a, ids_b = ids_a[np.repeat(~odd, n_a)], ids_b[np.repeat(~odd, n_b)]
            n_a[odd] = n_b[odd] = size[odd] = 0
        starts = np.arange(0, len(new), TOGETHER)
        tokens = []
        for ids, each, known in ((ids_a, n_a, a.token_bytes), (ids_b, n_b, b.token_bytes)):
            n = np.add.reduceat(each, starts)
            at = ends(ids, n, known) << ID_BITS
            tokens += [bpe.lists(at | ids, n), bpe.lists(at | MARK, n)]
        self.n_a, self.n_b, self.odd = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.odd, odd)
        chunk_ends = pa.array([np.cumsum(size[i : i + TOGETHER]) for i in starts], pa.list_(pa.int64()))
        zeros = np.zeros(len(starts), np.int64)
        columns = [pa.nulls(len(starts), pa.int64()), *tokens, pa.array(first + starts, pa.int32()), chunk_ends]
        columns += [pa.array(zeros)] * 2 + [bpe.lists(np.zeros(0, np.int32), zeros)]
        yield pa.RecordBatch.from_arrays(columns, names=CHUNKED.names)

    def documents(self, doc_id: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        """Rows of documents, from their chunks' numbers."""
        flat, n = np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64)
        bounds = np.append(0, np.cumsum(n))
        sums = [pa.array(np.diff(np.append(0, np.cumsum(x[flat]))[bounds])) for x in (self.n_a, self.n_b)]
        empty, none = bpe.lists(np.zeros(0, np.int64), np.zeros(len(rows), np.int64)), pa.nulls(len(rows), pa.int32())
        return pa.RecordBatch.from_arrays([doc_id, *[empty] * 4, none, empty, *sums, bpe.lists(flat.astype(np.int32), n)], names=CHUNKED.names)


def _tokenised(a_path: str, b_path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = bpe.loaded(a_path, special=False), pieces(b_path)
        if max(len(a.token_bytes), len(b.token_bytes)) > MARK:
            raise ValueError("a vocabulary of too many ids")
        known = Chunks()
        for batch in it:
            for part, found in bpe.slices(batch, 1, BYTES):
                if len(known.memo) > KEPT or known.size > KEPT_BYTES:
                    known = Chunks()
                rows = [known.memo.numbers(b.chunks(x) if x else []) for x in found]
                yield from known.learn(a, b)
                if known.odd.any():  # such a text is a chunk by itself, or has no tokens
                    strange = [i for i, r in enumerate(rows) if known.odd[r].any()]
                    for i in strange:
                        rows[i] = known.memo.numbers([" " + found[i]])
                    yield from known.learn(a, b)
                    for i in strange:
                        rows[i] = rows[i][~known.odd[rows[i]]]
                yield known.documents(part.column(0), rows)
            release()
        a.memo, known = bpe.Memo(), None
        release()

    return run


def tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of distinct chunks with their tokens of the byte-level BPE vocabulary a and the sentencepiece vocabulary b and where they end, end to end;
    after them, in the same partition, rows of documents that have them: doc_id, the numbers of tokens, and its chunks."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenised(a_path, b_path), CHUNKED)


def grouped(tokens: DataFrame) -> DataFrame:
    """The token columns, and: cuts, the ends that tokens of both have; a_groups and b_groups, the ids up to each cut, 'a1,a2'.

    Sorted together, each cut follows the tokens that end at it; without their offsets, tokens and cuts joined are the groups. What is
    sorted is a column of its own, and used twice, so that it is compiled apart from the lambda, which isn't.
    """
    out = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    out = out.withColumns({f"{x}_sorted": F.sort_array(F.concat(x, "cuts")) for x in "ab"})
    for x in "ab":
        joined = f"concat(array_join(cast(transform({x}_sorted, t -> t & {MARK}L) as array<string>), ','), ',')"
        out = out.withColumn(f"{x}_groups", F.expr(f"slice(split({joined}, ',{MARK},'), 1, size({x}_sorted) - size({x}))"))  # a mark ends each group
    return out.drop("a_sorted", "b_sorted")


def linked(tokens: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups ('a1,a2|b1;...'), and the links' ids a_link and b_link in order: the last of each group; more columns."""
    last = "transform({0}_groups, g -> cast(substring_index(g, ',', -1) as int))"
    return grouped(tokens).select(
        "doc_id",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.size("cuts").cast("long").alias("n_groups"),
        F.size("a_groups").cast("long").alias("n_links"),
        F.expr("array_join(zip_with(a_groups, b_groups, (x, y) -> concat(x, '|', y)), ';')").alias("groups"),
        F.expr(last.format("a")).alias("a_link"),
        F.expr(last.format("b")).alias("b_link"),
        *more,
    )


DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, a_link array<int>, b_link array<int>, groups_sha256 string"


class Aligned:
    """The groups and links of the chunks of a task, by number."""

    def __init__(self):
        self.groups: list[str] = []
        self.links = bpe.Memo()  # a << 32 | b

    def enter(self, first: int, chunk_ends: np.ndarray, cuts: np.ndarray, groups: str, a: np.ndarray, b: np.ndarray) -> None:
        if first != len(self.groups):
            raise ValueError("chunks out of order")
        at = np.append(0, np.searchsorted(cuts, chunk_ends << ID_BITS | MARK, side="right"))
        each, bounds = groups.split(";"), at.tolist()
        self.groups += [each[i] if j == i + 1 else ";".join(each[i:j]) for i, j in zip(bounds, bounds[1:])]
        self.links.enter(a.astype(np.int64) << 32 | b, at)

    def documents(self, part: pa.RecordBatch) -> pa.RecordBatch:
        chunks = part.column("chunks")
        rows = np.split(chunks.flatten().to_numpy(), np.cumsum(chunks.value_lengths().to_numpy())[:-1])
        links, n = self.links.gathered(rows)
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, r.tolist())).encode()).hexdigest() if len(r) else "" for r in rows]
        ab = [bpe.lists(x.astype(np.int32), n) for x in (links >> 32, links & 0xFFFFFFFF)]
        columns = [part.column(c) for c in ("doc_id", "of_a", "of_b")] + [pa.array(n, pa.int64())] * 2 + [*ab, pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "a_link", "b_link", "groups_sha256"])


def _assembled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as ``tokenised`` gave them, aligned; the documents come out."""
    known = Aligned()
    for batch in it:
        firsts, i = batch.column("first").to_pylist(), 0
        while i < len(firsts):
            if firsts[i] is not None:
                known = known if firsts[i] else Aligned()
                of_chunks, cuts, a, b = (batch.column(c)[i].values.to_numpy() for c in ("chunk_ends", "cuts", "a_link", "b_link"))
                known.enter(firsts[i], of_chunks, cuts, batch.column("groups")[i].as_py(), a, b)
                i += 1
                continue
            j = i
            while j < len(firsts) and j - i < ROWS and firsts[j] is None:
                j += 1
            yield known.documents(batch.slice(i, j - i))
            i = j
        release()


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n, best of each pair of linked ids: how many links hold it, and whether no other pair of its b has more."""
    counts = links.selectExpr("inline(arrays_zip(a_link, b_link))").groupBy(F.col("a_link").alias("a"), F.col("b_link").alias("b")).agg(F.count("*").alias("n"))
    return counts.selectExpr("a", "b", "n", "n = max(n) over (partition by b) as best")


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(spark, "alignment")
    chunks = linked(tokenised(docs, a_path, b_path), "first", "chunk_ends", "cuts", "of_a", "of_b", "chunks").drop("n_a", "n_b", "n_groups", "n_links")
    rows = scratch.save(chunks.mapInArrow(_assembled, DOCUMENTS).withColumn("row", F.monotonically_increasing_id()))
    pairs = scratch.save(pair_counts(rows))
    each = rows.selectExpr("row", "inline(arrays_zip(a_link, b_link))").withColumnsRenamed({"a_link": "a", "b_link": "b"})
    sums = each.join(F.broadcast(pairs), ["a", "b"]).groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    out = rows.drop("a_link", "b_link").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

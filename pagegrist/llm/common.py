"""Shared plumbing of the training-data operators: table reading, scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import math
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: A word, where a contract says so: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a slim key table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables that cut lineage: they outlive lost executors and are computed once.

    What a result still reads stays; ``keep`` gives back the rest, ``sweep`` everything that was made since a ``mark``.
    """

    _roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = ship(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        Scratch._roots.append(self.root)

    def save(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.root}/t{len(self.paths) + 1}"
        self.paths.append(path)
        with swept_shuffles(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Give back the disk of all tables but these, once nothing else will read them."""
        kept = {t._scratch_path for t in tables}
        _delete(self.spark, [p for p in self.paths if p not in kept])

    @classmethod
    def mark(cls) -> int:
        return len(cls._roots)

    @classmethod
    def sweep(cls, spark: SparkSession, since: int) -> None:
        """Give back all tables of operators that were begun since the mark and whose results are written elsewhere."""
        _delete(spark, cls._roots[since:])
        del cls._roots[since:]


@contextmanager
def swept_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written go when it is written, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Hand free memory of a Python worker back to the system, before its next stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, *taken: list[str]) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    used = {x.lower() for names in taken for x in names}
    while name.lower() in used:
        name += "_"
    return name


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side of a counted size; unhinted beyond the bound, where the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Slices of a slim table that may be broadcast beside each other; beyond so many the join shuffles.
SLICES = 32
#: Slices up to which a table is read again for each of them rather than shuffled.
AGAIN = 3


def sliced_join(big: DataFrame, small: DataFrame, rows: float, key: str, how: str = "inner") -> DataFrame:
    """Join of a table with a slim one of a counted size, whose keys are distinct; the table isn't shuffled.

    Beyond what may be broadcast the slim side goes in slices by hash of the key, each held against the rows that it can meet: the
    table is read once a slice.
    """
    k = math.ceil(rows / BROADCAST_ROWS)
    if k <= 1 or k > SLICES:
        return big.join(sized_broadcast(small, rows), key, how)
    slot = F.pmod(F.xxhash64(key), F.lit(k))
    return reduce(DataFrame.unionByName, [big.where(slot == i).join(F.broadcast(small.where(slot == i)), key, how) for i in range(k)])


def slim_join(big: DataFrame, small: DataFrame, rows: float, key: str, how: str = "inner", again: int = AGAIN) -> DataFrame:
    """Join of two slim tables, of which the second has a counted size and distinct keys.

    Up to so many slices the first isn't shuffled; beyond, both are, once, and the second's parts are hash tables: nothing is sorted or read again.
    """
    if rows <= again * BROADCAST_ROWS:
        return sliced_join(big, small, rows, key, how)
    return big.join(small.hint("shuffle_hash"), key, how)


def ranged(small: DataFrame, rows: float, key: str) -> list:
    """Tests of a long key that part a slim table of a counted size into ranges that may be broadcast, and any other table with it.

    A null key is in the first range. Readers of Parquet leave out what a range doesn't need. One test that holds for all: the slim table
    goes as a whole, as it is small, or as one key has too much of it, or there would be too many ranges.
    """
    k = math.ceil(rows / BROADCAST_ROWS)
    whole = [F.lit(True)]
    if k <= 1 or k > SLICES:
        return whole
    cuts = sorted({int(x) for x in small.approxQuantile(key, [i / k for i in range(1, k)], 0.1 / k)})
    if not cuts:
        return whole
    slot = reduce(lambda a, b: a + b, [(F.col(key) > c).cast("int") for c in cuts])
    most = small.groupBy(slot.alias("slot")).count().agg(F.max("count"), F.sum("count")).first()
    if most[0] * k > 3 * most[1]:
        return whole
    x = F.col(key).cast("long")
    return [x.isNull() | (x <= cuts[0]), *((x > a) & (x <= b) for a, b in zip(cuts, cuts[1:])), x > cuts[-1]]


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and its n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def batches(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in zip(schema, (out[f.name] for f in schema))], schema=schema)


def lists(flat: np.ndarray, width: int) -> pa.Array:
    """Rows of equal width as an Arrow list column."""
    n = len(flat) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-D uint8 array as an Arrow binary column."""
    n, width = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def gathered(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches joined up to about so many rows."""
    held, n = [], 0
    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)

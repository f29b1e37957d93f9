"""Sinks: JSON envelopes, Markdown files, files of any content, canonical JSON with a content hash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship


def envelopes(df: DataFrame) -> DataFrame:
    """One JSON envelope per row in column value, as a text writer takes it."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown_files(df: DataFrame, title: str, url: str, markdown: str, path: str) -> None:
    """One directory per article under a name that stays apart for equal titles."""
    out = df.select(T.batch_slug(F.col(title), F.col(url)).alias("slug"), F.col(markdown).alias("value"))
    out.write.mode("overwrite").partitionBy("slug").text(path)


def content_hash(key: Column, payload: Column) -> Column:
    """A hash of a set of records in order of key: equal content gives equal versions. Of many records take it of blocks, then of these."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), payload.alias("v")))), lambda x: x["v"]), "\n"), 256)


def write_files(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Each row's content as a file of its name in a folder that all executors share; the number of files.

    Tasks write through Arrow's file systems, each file whole under a name of its own first, so a task that runs again leaves none broken.
    """
    ship(spark)

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder) if ":" in folder else (LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for b in it:
            for name, content in zip(b.column("name").to_pylist(), b.column("content")):
                part = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    return files.select("name", "content").mapInArrow(written, "name string").count()

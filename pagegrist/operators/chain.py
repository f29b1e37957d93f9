"""A chain of candidates for each request, with early exit: only requests that are still open go on to the next candidate.

A stage is a function of the open requests that gives attempts; it is run over no other rows, so what a later candidate costs is paid for
unresolved requests alone. Between stages stand written tables in the shared folder: the attempts of a stage, and who is still
open. They cut lineage, outlive lost executors, and are what the outcome is summed up from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..session import shared_dir
from .attempts import failure_class, known_code, priority

#: Codes after which no other candidate of the request is tried.
TERMINAL = ("SSRF_BLOCKED",)
#: Of an attempt, besides the request's key.
ATTEMPT = {"place": "int", "engine": "string", "status": "int", "elapsed_ms": "long", "error_code": "string"}


@dataclass
class Resolution:
    """outcomes: a row a request; attempts: all that were made; stages: (name, requests that came in, attempts made, requests that ended)."""

    outcomes: DataFrame
    attempts: DataFrame
    stages: list[tuple[str, int, int, int]]


def _ends(code) -> F.Column:
    return (blank(code) == "") | code.isin(*TERMINAL)


def until_end(made: DataFrame, key: str) -> DataFrame:
    """The attempts of a stage up to each request's first success or terminal failure, in order of place."""
    end = made.where(_ends(F.col("error_code"))).groupBy(F.col(key).alias("_k")).agg(F.min("place").alias("_end"))
    return made.join(end, made[key] == F.col("_k"), "left").where(F.col("_end").isNull() | (F.col("place") <= F.col("_end"))).drop("_k", "_end")


def resolve(spark: SparkSession, requests: DataFrame, key: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> Resolution:
    """Tries the stages in order for each request until one succeeds, or fails in a way that ends the chain.

    A stage gets the open requests with all their columns and gives attempts: the key, place (the order within the stage) and the columns
    of ATTEMPT. Attempts after a stage's first success or terminal failure are left out, and a request for which a stage gives no
    attempt goes on. Requests of one key are one request (any of the rows); those without a key are left out. The outcome's
    failure is that of the highest priority, the last of equals; a request without any attempt has NO_STRATEGY.
    """
    root = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    every = kept(requests.where(F.col(key).isNotNull()).dropDuplicates([key]), "requests")
    kind = every.schema[key].dataType.simpleString()
    opened, counts, tables = every, [], []
    n_open = every.count()
    for number, (name, stage) in enumerate(stages):
        if not n_open:  # all have ended: later stages don't run
            counts.append((name, 0, 0, 0))
            continue
        made = stage(opened).select(F.col(key).cast(kind).alias(key), *(F.col(c).cast(t).alias(c) for c, t in ATTEMPT.items()))
        made = kept(made, f"stage{number}")  # a stage runs once
        made = kept(until_end(made, key).withColumns({"stage": F.lit(name), "stage_seq": F.lit(number)}), f"attempts{number}")
        ended = made.where(_ends(F.col("error_code"))).select(key).distinct()
        n_in, opened = n_open, kept(opened.join(ended, key, "left_anti"), f"open{number}")
        n_open = opened.count()
        counts.append((name, n_in, made.count(), n_in - n_open))
        tables.append(made)
    ddl = f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in ATTEMPT.items()) + ", stage string, stage_seq int"
    attempts = spark.createDataFrame([], ddl)
    for t in tables:
        attempts = attempts.unionByName(t)
    return Resolution(outcomes(every.select(key), attempts, key), attempts, counts)


def outcomes(requests: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """key, ok, stage, engine, status, error_code, failure_class, n_attempts, n_stages, elapsed_ms of each request."""
    ok, code = blank(F.col("error_code")) == "", known_code(F.col("error_code"))
    what = F.struct("stage", "engine", "status", F.when(ok, "").otherwise(code).alias("code"))
    rank = F.struct(F.when(ok, 1000).otherwise(priority(code)).alias("p"), "stage_seq", "place")
    each = attempts.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(what, rank).alias("b"), F.count("*").alias("n_attempts"), F.max("stage_seq").alias("last"), F.sum(F.greatest(F.coalesce("elapsed_ms", F.lit(0)), F.lit(0))).alias("elapsed_ms")
    )
    out = requests.join(each, requests[key] == F.col("_k"), "left")
    code = F.coalesce("b.code", F.lit("NO_STRATEGY"))
    return out.select(
        key, (code == "").alias("ok"), F.when(code == "", F.col("b.stage")).otherwise("").alias("stage"), F.coalesce("b.engine", F.lit("")).alias("engine"), F.coalesce("b.status", F.lit(0)).alias("status"),
        code.alias("error_code"), F.when(code == "", "").otherwise(failure_class(code)).alias("failure_class"), F.coalesce("n_attempts", F.lit(0)).cast("long").alias("n_attempts"),
        (F.coalesce("last", F.lit(-1)) + 1).alias("n_stages"), F.coalesce("elapsed_ms", F.lit(0)).cast("long").alias("elapsed_ms"),
    )

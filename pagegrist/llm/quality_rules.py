"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its failure is a bit of ``fail_bits`` and what it measured is kept
beside it. The ledger is written; a policy is a version name and a mask, and applying or changing one, or asking what a rule
costs, reads only the ledger. Ablations aggregate bitwise over the counts of distinct masks, at most 2 ** rules rows.
Policy "1" leaves two rules to other operators: repeated lines to line dedup, and great length to packing, which cuts.

Defined results: a null or empty text has no words and fails ``few_words``; equal rows are judged as often as
given; a null doc_id is kept; an empty table gives no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .common import Scratch

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letterless_words", "n_adjacent_repeats", "n_bullets")

#: The rules by bit; each says where it fails, in whole numbers.
RULES: tuple[tuple[str, Callable[[dict], np.ndarray]], ...] = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("many_words", lambda m: m["n_words"] > 1_000_000),
    ("short_mean_word", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_mean_word", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("letterless_words", lambda m: 2 * m["n_letterless_words"] > m["n_words"]),
    ("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ("adjacent_repeats", lambda m: 10 * m["n_adjacent_repeats"] > m["n_words"] + 30),
    ("bullets", lambda m: 10 * m["n_bullets"] > 9 * m["n_lines"]),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[x] for x in names)


BASE = mask("few_words", "repeated_windows")
#: Policies by version.
POLICIES = {"base": BASE, "1": BASE | mask("short_mean_word", "long_mean_word", "symbols", "letterless_words", "adjacent_repeats", "bullets"), "2-strict": (1 << len(RULES)) - 1}
CURRENT = "1"


def _measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in MEASURES), ("fail_bits", pa.int64())])
    for batch in it:
        for part in docstats.slices(batch):
            m = docstats.measure(part)
            bits = np.zeros(part.num_rows, np.int64)
            for i, (_, fails) in enumerate(RULES):
                bits |= fails(m).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(m[k]) for k in MEASURES), pa.array(bits)], schema=schema)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", fail_bits long")


def judged(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept (no rule of the policy fails) and the policy's version."""
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return ledger.withColumns({"base_failed": failed(BASE), "kept": ~failed(POLICIES[policy] | BASE), "policy": F.lit(policy)})


def ablations(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """By rule of the policy: documents that fail it, fail only it, and are kept if it goes."""
    whole = POLICIES[policy]
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BIT.items() if b & whole])
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(count(fails).alias("n_failing"), count(fails & (rest == 0)).alias("n_only"), count(rest == 0).alias("n_kept_without"))


#: The ledger in SQL.
LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT k, unnest(list_transform(range(1, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i:i + 4], ' '))) AS win, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM p),
c AS (SELECT k, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM g, range(5) AS r(o) WHERE n > 1 GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letterless,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS adjacent,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS bullets
  FROM w LEFT JOIN c USING (k)),
f AS (SELECT *, (n_words < 10)::BIGINT * 1 + (100 * n_repeat_words > 20 * n_words)::BIGINT * 2 + (n_words > 1000000)::BIGINT * 4 + (word_chars < 2 * n_words)::BIGINT * 8 + (word_chars > 20 * n_words)::BIGINT * 16
    + (10 * n_symbols > n_words)::BIGINT * 32 + (2 * letterless > n_words)::BIGINT * 64 + (10 * n_dup_lines > 3 * n_lines)::BIGINT * 128 + (10 * adjacent > n_words + 30)::BIGINT * 256 + (10 * bullets > 9 * n_lines)::BIGINT * 512 AS fail_bits FROM m)
"""
#: op1's rows in SQL.
SQL = LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
            OR 2 * letterless > n_words OR 10 * adjacent > n_words + 30 OR 10 * bullets > 9 * n_lines) AS kept,
       fail_bits, '1' AS policy
FROM f
"""
#: What each rule of the strictest policy costs, in SQL.
ABLATIONS_SQL = LEDGER_SQL + f""", r(rule, bit) AS (VALUES {", ".join(f"('{k}', {b}::BIGINT)" for k, b in BIT.items())})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failing, count(*) FILTER (fail_bits = bit)::BIGINT AS n_only, count(*) FILTER (fail_bits & ~bit = 0)::BIGINT AS n_kept_without
FROM r LEFT JOIN f ON true GROUP BY rule HAVING count(f.fail_bits) > 0
"""


def verdicts(spark: SparkSession, docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits, policy; the ledger is written once."""
    written = Scratch(spark, "ledger").save(ledger(docs))
    return judged(written, policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")
